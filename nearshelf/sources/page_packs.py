"""Pages in packs: files of many pages each, sorted by path, in place of one small file per page.

Millions of small files are listed by the driver at every read, and every task opens
hundreds. A pack holds the same columns as Spark's binary files, so that pages are read
from either. Paths are a column of their own: to find out which pages are first or still
to do, no body is read, and a bound on the path skips row groups.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from nearshelf import fixed_values as V
from nearshelf.sources.pages import page_columns

PAGE_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
#: Bytes of pages in a pack on average, and pages in one at most.
PACK_BYTES, PACK_PAGES = 256 << 20, 20_000
#: New paths that may be sent to every executor.
BROADCAST_PATHS = 200_000
#: Row groups of 16 MB of pages, looked at after every row, as a page may have some MB itself.
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "compression": "zstd"}


def packed_files(spark: SparkSession, packs: str) -> DataFrame:
    """The rows of all packs, as binary files; none where nothing was packed yet."""
    try:
        return spark.read.schema(PAGE_FILE).parquet(packs)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAGE_FILE)


def pack_pages(spark: SparkSession, folder: str, packs: str, glob: str = V.PAGE_FILE_GLOB, *,
               pack_bytes: int = PACK_BYTES, pack_pages: int = PACK_PAGES) -> int:
    """Packs the folder's pages whose path is in no pack yet; how many there were.

    A path is packed once: a page that changes later stays as it was packed, as it would
    stay in the manifest. A run that died leaves whole packs only, and the next one goes
    on with the paths that are missing. One run at a time. Bodies are read once and
    written by the task that read them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    done = packed_files(spark, packs).select("path")
    # Names and lengths alone: no body is read to find out what is new.
    new = files.select("path", "length").join(done, "path", "left_anti")
    found = new.agg(F.count("*").alias("pages"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if not found.pages:
        return 0
    tasks = int(max(-(-found.bytes // pack_bytes), -(-found.pages // pack_pages)))
    bodies = to_pack(files, None if done.isEmpty() else new.select("path"), found.pages, tasks)
    bodies.sortWithinPartitions("path").select(*files.columns).write.mode("append").options(
        maxRecordsPerFile=pack_pages, **ROW_GROUPS).parquet(packs)
    return found.pages


def to_pack(files: DataFrame, paths: DataFrame | None, pages: int, tasks: int) -> DataFrame:
    """Files of the paths, all without, in so many partitions. Paths that travel meet partitions that are coalesced already:
    otherwise a task holds them once for every partition that it takes. A semi join would be planned below the coalesce."""
    if paths is None:
        return files.coalesce(tasks)
    if pages <= BROADCAST_PATHS:
        return files.coalesce(tasks).join(F.broadcast(paths.distinct()), "path").select(*files.columns)
    return files.join(paths, "path", "left_semi").coalesce(tasks)


def read_packed(spark: SparkSession, packs: str) -> DataFrame:
    """path, file_name, html of all packed pages, in no particular order; large packs are split by row groups."""
    return page_columns(packed_files(spark, packs))


def stream_packed(spark: SparkSession, packs: str, max_packs: int = 64) -> DataFrame:
    """path, html of packed pages as a stream, pack by pack: it goes on after the last pack of a finished batch."""
    files = spark.readStream.schema(PAGE_FILE).option("maxFilesPerTrigger", max_packs).parquet(packs)
    return page_columns(files).select("path", "html")
