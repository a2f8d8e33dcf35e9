"""Written intermediate tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearshelf.session import work_folder

#: Rows of a few numbers each that may be sent to every executor.
BROADCAST_ROWS = 500_000


#: Sizes of pages and row groups are looked at after every row, as a hundred rows of some MB would be one page;
#: and a codec that works in a stream, as others hold a whole page outside of the heap.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "compression": "zstd"}


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df, written to the shared folder with these options and read from there."""
    folder = work_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its count allows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
