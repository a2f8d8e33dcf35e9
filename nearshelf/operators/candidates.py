"""Candidate lists: union of several searches, one row per item, ordered."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearshelf.functions.vectors import weighted_sum


def combine_vectors(rows: DataFrame, weights: dict[str, float], out: str = "vector") -> DataFrame:
    """Weighted sum of vector columns. The first column is required, the others
    may be null."""
    return rows.withColumn(out, weighted_sum([(F.col(c), w) for c, w in weights.items()]))


def union_matches(*matches: DataFrame) -> DataFrame:
    """Results of separately run searches as one table."""
    first, *rest = matches
    for m in rest:
        first = first.unionByName(m)
    return first


def merge_candidates(matches: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per (query, id) with its best score, ordered by score; equal
    scores keep the order of first sight (variant, then rank).

    The payload depends on the id alone, so it is part of the grouping key, and
    what is left to aggregate has fixed width: a hash aggregate without a sort,
    partial before any exchange. After cosine_topk the rows already sit together
    by query_id and nothing moves.
    """
    seen = F.shiftleft(F.col("variant_no").cast("bigint"), 32) + F.col("rank")
    per_id = (
        matches.where(F.col("id").isNotNull() & (F.col("id").cast("string") != ""))
        .groupBy("query_id", "id", *payload)
        .agg(F.max("score").alias("score"), F.min(seen).alias("seen"))
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "seen")
    return per_id.select(
        "query_id", F.row_number().over(order).alias("cand_rank"), "id", "score", *payload
    )


def without_base(matches: DataFrame, base: DataFrame) -> DataFrame:
    """Drop matches named like the query's base item, letter case aside.
    base: query_id, base_name."""
    lower = lambda c: F.coalesce(F.lower(F.col(c)), F.lit(""))
    return (
        matches.join(base.select("query_id", "base_name"), "query_id")
        .where(lower("name") != lower("base_name"))
        .drop("base_name")
    )


def top_per_query(matches: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """First k rows per query, renumbered."""
    order = order or [F.col("score").desc(), F.col("rank")]
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return matches.withColumn("place", place).where(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")


def first_per_key(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Window form of the constraint pass without producer caps: the first row
    of every item key, minus the base item's key and name; rows with a blank
    key all stay. candidates: query_id, cand_rank, name, item_key;
    base: query_id, base_name, base_key."""
    place = F.row_number().over(W.partitionBy("query_id", "item_key").orderBy("cand_rank"))
    lower = lambda c: F.coalesce(F.lower(F.col(c)), F.lit(""))
    key = F.coalesce(F.col("item_key"), F.lit(""))
    return (
        candidates.join(base.select("query_id", "base_name", "base_key"), "query_id")
        .where(lower("name") != lower("base_name"))
        .withColumn("place", place)
        .where((key == "") | ((key != F.coalesce("base_key", F.lit(""))) & (F.col("place") == 1)))
        .drop("place", "base_name", "base_key")
    )


def cap_per_group(candidates: DataFrame, group_col: str, k: int, cap: int = 2) -> DataFrame:
    """At most `cap` rows per query and group, a blank group uncapped, then the
    first k rows. candidates: query_id, rank, ..."""
    in_group = F.row_number().over(W.partitionBy("query_id", group_col).orderBy("rank"))
    kept = candidates.withColumn("in_group", in_group).where(
        (F.coalesce(F.col(group_col), F.lit("")) == "") | (F.col("in_group") <= cap)
    ).drop("in_group")
    return top_per_query(kept, k, [F.col("rank")])


def fill_up(chosen: DataFrame, candidates: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Append, up to k rows per query, candidates that were not chosen, in
    candidate order; only the base item's name is excluded. `phase` tells
    chosen (1) from appended (2)."""
    base_name = F.coalesce(F.lower("base_name"), F.lit(""))
    name = F.coalesce(F.lower(F.trim("name")), F.lit(""))
    spare = (
        candidates.join(chosen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        .join(base.select("query_id", "base_name"), "query_id")
        .where((name == "") | (name != base_name))
        .select("query_id", F.lit(2).alias("phase"), F.col("cand_rank").alias("pos"), "id", "score")
    )
    both = chosen.select(
        "query_id", F.lit(1).alias("phase"), F.col("rank").alias("pos"), "id", "score"
    ).unionByName(spare)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("phase", "pos"))
    return both.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", "rank", "phase", "id", "score"
    )
