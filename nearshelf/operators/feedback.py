"""Session signals as tables, list shaping for display."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearshelf import fixed_values as V
from nearshelf.functions.text import brand_key, strip
from nearshelf.functions.variant import is_object, parse_twice
from nearshelf.operators.ranges import in_ranges, with_places
from nearshelf.session import work_folder


def dislikes(events: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hidden items, blocked producers) for events: user_id, id of disliked
    items; a producer is blocked with its item unless its name is blank."""
    hidden = events.where(F.coalesce(F.col("id"), F.lit("")) != "").select("user_id", "id").distinct()
    blocked = (
        hidden.join(catalog.select("id", "brand"), "id")
        .select("user_id", brand_key(F.col("brand")).alias("brand_key"))
        .where(F.col("brand_key") != "")
        .distinct()
    )
    return hidden, blocked


def apply_feedback(recs: DataFrame, hidden: DataFrame, blocked: DataFrame) -> DataFrame:
    """Drop hidden items and items of blocked producers from the users' lists.
    Blank ids and brands match nothing: both tables hold no blanks."""
    return (
        recs.withColumn("brand_key", brand_key(F.col("brand")))
        .join(hidden, ["user_id", "id"], "left_anti")
        .join(blocked, ["user_id", "brand_key"], "left_anti")
        .drop("brand_key")
    )


def hide_shown(recs: DataFrame, disliked: DataFrame) -> DataFrame:
    """A list already shown loses the disliked item only; the producer block
    acts from the next search."""
    return recs.join(disliked.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti")


def liked_queries(likes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every liked item is the next request of its user:
    query_id, user_id, typed_name. likes: like_id, user_id, id."""
    name = strip(F.col("name"))
    return (
        likes.join(catalog.select("id", "name"), "id")
        .where(F.coalesce(name, F.lit("")) != "")
        .select(F.col("like_id").alias("query_id"), "user_id", name.alias("typed_name"))
    )


def recent_likes(likes: DataFrame, n: int = V.RECENT_LIKES) -> DataFrame:
    """Last n likes per user, newest first. likes: user_id, ts, event_id, name."""
    newest = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return likes.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def assign_tiers(recs: DataFrame, list_key: str = "query_id", cuts: tuple[int, int] = V.TIER_CUTS) -> DataFrame:
    """Tier by position in the filtered list."""
    pos = F.row_number().over(W.partitionBy(list_key).orderBy("rank"))
    rows = recs.withColumn("position", pos)
    tier_no = F.when(F.col("position") <= cuts[0], 1).when(F.col("position") <= cuts[1], 2).otherwise(3)
    core, explore, wildcard = V.TIER_NAMES
    return rows.withColumn("tier_no", tier_no).withColumn(
        "tier", F.when(F.col("tier_no") == 1, core).when(F.col("tier_no") == 2, explore).otherwise(wildcard)
    )


def suggest_names(names: DataFrame, typed: str, limit: int | None = V.SUGGESTIONS) -> DataFrame:
    """Names containing the typed text, letter case aside, in name order. A
    blank text suggests every name."""
    typed = typed.strip().lower()
    hits = names.where(F.lower("name").contains(typed)).orderBy("name")
    return hits.limit(limit) if typed and limit else hits


GRAM = 3


def _pieces(text: Column, n: int) -> Column:
    """Substrings of n letters (the text itself when it is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def autocomplete(names: DataFrame, typed: DataFrame, limit: int | None = V.SUGGESTIONS,
                 salts: int | None = None) -> DataFrame:
    """suggest_names for a table of typed texts (query_id, typed): query_id,
    place, name. names: name, distinct.

    Substring search becomes an equi-join: a text of three or more letters can
    only occur in names that share each of its three-letter pieces, so it is
    joined on its rarest piece and then verified; pieces nobody asks for are left
    out of the index. Names are spread over `salts` ranges of their order (as many as a
    shuffle has partitions, if not told), because one piece may occur in a third
    of all names. A text's hits are numbered range by range, so that a text that
    all names contain does not end in one task either.
    """
    spark = names.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.lower(strip("typed")) if limit else F.lower("typed")
    own = F.when(F.length("text") <= GRAM, F.array("text")).otherwise(_pieces(F.col("text"), GRAM))
    asked = typed.select("query_id", text.alias("text")).select(
        "query_id", "text", F.explode(F.array_distinct(own)).alias("piece")
    )
    pieces = F.array_distinct(F.concat(
        F.array(F.lit("")), *[_pieces(F.lower("name"), n) for n in range(1, GRAM + 1)]
    ))
    folder = work_folder(spark, "pieces")
    in_ranges(names.select("name"), "name", salts).select("name", "slice", F.explode(pieces).alias("piece")).join(
        asked.select("piece").distinct(), "piece", "left_semi"
    ).write.parquet(folder)
    index = spark.read.schema("piece STRING, name STRING, slice BIGINT").parquet(folder)
    frequency = index.groupBy("piece", "slice").agg(F.count("*").alias("n"))
    held = frequency.groupBy("piece").agg(F.sum("n").alias("n"), F.collect_list("slice").alias("slices"))
    rarest = (
        asked.join(held, "piece")
        .groupBy("query_id", "text")
        .agg(F.min_by(F.struct("piece", "slices"), F.struct("n", "piece")).alias("r"))
        .select("query_id", "text", "r.piece", F.explode("r.slices").alias("slice"))
    )
    hits = index.join(rarest, ["piece", "slice"]).where(F.lower("name").contains(F.col("text")))
    return with_places(hits, "query_id", "name", limit=limit, unlimited="text = ''").select("query_id", "place", "name")


def review_rows(items: DataFrame, first: int = 3) -> DataFrame:
    """First reviews of a JSON list as rows: id, pos, author, rating, review,
    line. Elements that are no objects are left out."""
    listed = F.try_variant_get(F.try_parse_json("reviews_json"), "$", "array<variant>")
    rows = items.select("id", F.posexplode(F.slice(listed, 1, first)).alias("pos", "r"))
    get = lambda path: F.try_variant_get(F.col("r"), path, "string")
    rating = get("$.rating")
    shaped = rows.where(is_object(F.col("r"))).select(
        "id", "pos",
        F.coalesce(get("$.author"), F.lit(V.DEFAULT_REVIEW_AUTHOR)).alias("author"),
        rating.alias("rating"),
        F.coalesce(get("$.review"), F.lit("")).alias("review"),
    )
    return shaped.withColumn("line", F.concat(
        F.lit("**"), F.col("author"), F.lit("**"),
        F.coalesce(F.concat(F.lit(" (Rating: "), F.col("rating"), F.lit(")")), F.lit("")),
        F.lit(": "), F.col("review"),
    ))


def rating_value(rating_json: Column) -> Column:
    """ratingValue of a rating object that may be encoded once or twice."""
    parsed = parse_twice(rating_json)
    value = F.try_variant_get(parsed, "$.ratingValue", "string")
    return F.coalesce(F.when(is_object(parsed), value), F.lit(V.MISSING))


def chart_rows(recs: DataFrame, base: DataFrame) -> DataFrame:
    """Recommendations plus the base item (score 1.0) with a readable price:
    query_id, name, price, similarity_percentage, is_base."""
    price = F.col("price").cast("string").try_cast("double").alias("price")
    cols = lambda score, flag: [
        F.col("query_id"), F.col("name"), price, (score * 100).alias("similarity_percentage"), F.lit(flag).alias("is_base"),
    ]
    rows = recs.select(*cols(F.col("score"), False)).unionByName(base.select(*cols(F.lit(1.0), True)))
    return rows.na.drop(subset=["price"])


def chart_axes(rows: DataFrame) -> DataFrame:
    """Axis ranges per list, with their margins."""
    p, s = V.CHART_PRICE_MARGIN, V.CHART_SIMILARITY_MARGIN
    return rows.groupBy("query_id").agg(
        (F.min("price") - p).alias("price_from"), (F.max("price") + p).alias("price_to"),
        (F.min("similarity_percentage") - s).alias("similarity_from"),
        (F.max("similarity_percentage") + s).alias("similarity_to"),
    )
