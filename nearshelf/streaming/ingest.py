"""Resumable ingest as a file stream: the stream's own checkpoint remembers
which pages are done, `availableNow` drains what is new and stops."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from nearshelf import fixed_values as V
from nearshelf.operators.extract import classify_pages, page_key
from nearshelf.plans.ingest import make_records, manifest_rows
from nearshelf.sources.pages import decode_text
from nearshelf.sources.vector_log import append_batch, read_current

PAGE_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_pages(spark: SparkSession, folder: str, glob: str = V.PAGE_FILE_GLOB,
                 max_files: int = 100_000) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile").schema(PAGE_FILE)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)
    )
    return files.select("path", decode_text(F.col("content")).alias("html"))


def stream_ingest(pages: DataFrame, *, out: str, checkpoint: str, id_prefix: str, source: str,
                  embed=None) -> StreamingQuery:
    """Start the stream over pages: path, html. Each micro-batch replaces its
    own folder out/pages/batch_no=<n>, so a batch repeated after a failure leaves the
    same files, and goes to the table out/table under the stream's id and its number, by
    which a repeated batch is recognised. `embed` adds vectors to a batch of records."""

    def write(batch: DataFrame, batch_no: int) -> None:
        stage = f"{out}/pages/batch_no={batch_no}"
        classify_pages(batch.withColumn("key", page_key(F.col("path"))), keep=["key", "path"]) \
            .write.mode("overwrite").parquet(stage)
        classified = batch.sparkSession.read.parquet(stage)
        # Of several pages of one item in a batch, the one with the last path counts.
        one = classified.where("status = 'ok'").groupBy("sku").agg(F.max("path").alias("path"))
        records = make_records(classified.join(one, ["sku", "path"], "left_semi"), id_prefix, source)
        records = embed(records) if embed else records
        # The id is the checkpoint's: a stream that starts anew without one is another stream.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_batch(records.withColumn("batch_no", F.lit(batch_no).cast("bigint")), f"{out}/table", batch_id=f"{stream}:{batch_no}")

    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_records(spark: SparkSession, out: str) -> DataFrame:
    """Latest record per id over all batches."""
    return read_current(spark, f"{out}/table")


def stream_manifest(spark: SparkSession, out: str) -> DataFrame:
    return manifest_rows(spark.read.parquet(f"{out}/pages"))
