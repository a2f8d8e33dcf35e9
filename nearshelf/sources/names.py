"""The list of item names."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def distinct_names(rows: DataFrame) -> DataFrame:
    """Distinct non-empty names in order."""
    return rows.select("name").where(F.col("name").isNotNull() & (F.col("name") != "")).distinct().orderBy("name")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Name list from CSV with a `name` column; quoted names may contain line
    breaks and doubled quotes."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return distinct_names(rows)


def write_names(names: DataFrame, path: str) -> None:
    names.select("name").write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def names_by_id(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Names of the items whose id is listed."""
    return distinct_names(catalog.join(ids.select("id"), "id", "left_semi"))
