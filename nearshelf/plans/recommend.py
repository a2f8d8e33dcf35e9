"""Whole requests, for a table of requests at a time."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from nearshelf import fixed_values as V
from nearshelf.functions.text import effective_producer, strip
from nearshelf.operators.candidates import (
    cap_per_group, combine_vectors, merge_candidates, top_per_query, without_base,
)
from nearshelf.operators.feedback import apply_feedback, assign_tiers, dislikes, liked_queries
from nearshelf.operators.query_text import free_text_prompt, query_variants, taste_words
from nearshelf.operators.diversify import select_diverse, with_item_key
from nearshelf.operators.resolve import resolve_names
from nearshelf.operators.search import cosine_topk, price_between
from nearshelf.session import work_folder

Embed = Callable[[DataFrame, str, str], DataFrame]  # rows, text column, vector column to add


def with_metadata(recs: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Attach catalog columns at the end, when only k rows per request are left.
    The vector column is not among them, so the scan skips it."""
    return recs.join(catalog.select("id", *columns), "id").withColumnRenamed("score", "similarity_score")


def similar_items(variants: DataFrame, base: DataFrame, catalog: DataFrame, k: int = 5, *, dim: int,
                  depth: int | None = None, digits: int | None = None,
                  max_same_as_base: int = V.MAX_SAME_PRODUCER_AS_BASE,
                  max_per_producer: int = V.MAX_PER_PRODUCER, **search) -> DataFrame:
    """Items similar to each base item: query_id, rank, phase, id, score.

    variants: query_id, variant_no, vector, price_min, price_max, up to three
    per base item; base: query_id, name, brand, embedding_text.
    """
    payload = ("name", "brand", "item_key")
    matches = cosine_topk(
        variants, with_item_key(catalog), depth or V.similar_item_depth(k), dim=dim,
        payload=payload, digits=digits, **search,
    )
    candidates = merge_candidates(matches, payload=payload)
    return select_diverse(candidates, base, k, max_same_as_base, max_per_producer)


def recommend_by_item(names: DataFrame, variants: DataFrame, catalog: DataFrame, k: int = 5, *, dim: int,
                      min_score: int = V.NAME_MIN_SCORE, scorer: str = "exact",
                      digits: int | None = None, **search) -> DataFrame:
    """Typed name -> resolved item -> similar items.

    names: query_id, typed_name, vector, price_min, price_max; variants:
    id, variant_no, vector, the query texts' vectors of every catalog item.
    """
    resolved, _ = resolve_names(names, catalog, dim=dim, min_score=min_score, scorer=scorer, digits=digits)
    bounds = [c for c in ("price_min", "price_max") if c in names.columns]
    asking, asked = _distinct_asks(resolved.select("query_id", "id").join(names.select("query_id", *bounds), "query_id"), ["id", *bounds], "asked-items")
    base = _base_of(asked, catalog, ["name", "brand"] + [c for c in ("embedding_text",) if c in catalog.columns])
    recs = similar_items(
        variants.join(asked, "id").select("query_id", "variant_no", "vector", *bounds), base, catalog, k, dim=dim, digits=digits, **search
    )
    return _for_all(recs, asking, base)


def recommend_by_text(requests: DataFrame, catalog: DataFrame, k: int = 8, *, dim: int,
                      max_per_producer: int = V.MAX_PER_PRODUCER, digits: int | None = None,
                      **search) -> DataFrame:
    """Free text -> nearest items with at most two per producer.
    requests: query_id, text, vector, price_min, price_max; blank texts ask
    for nothing."""
    asked = requests.where(F.coalesce(strip(F.col("text")), F.lit("")) != "") if "text" in requests.columns else requests
    matches = cosine_topk(
        asked, catalog, V.free_text_depth(k), dim=dim, payload=("name", "brand"), digits=digits, **search
    )
    keyed = matches.withColumn("producer", effective_producer(F.col("brand"), F.coalesce("name", F.lit(""))))
    return cap_per_group(keyed, "producer", k, max_per_producer).select(
        "query_id", "rank", "id", "score", "producer"
    )


def recommend_from_name(names: DataFrame, catalog: DataFrame, embed: Embed, k: int = 5, *, dim: int, min_score: int = V.NAME_MIN_SCORE,
                        scorer: str = "exact", digits: int | None = None, **search) -> DataFrame:
    """Typed names alone -> similar items: query_id, rank, phase, id, score, base_id.

    names: query_id, typed_name and optionally price bounds. The name's vector
    resolves it to an item, whose query texts are embedded and searched. A name
    that resolves to nothing is one row with null rank and id.
    """
    resolved = _resolved(names, catalog, embed, dim=dim, min_score=min_score, scorer=scorer, digits=digits)
    bounds = [c for c in ("price_min", "price_max") if c in names.columns]
    asking, asked = _distinct_asks(resolved.join(names.select("query_id", *bounds), "query_id"), ["id", *bounds], "asked-items")
    base = _base_of(asked, catalog, [c for c in catalog.columns if c not in ("id", "embedding", *bounds)])
    texts = query_variants(base).join(asked.select("query_id", *bounds), "query_id")
    columns = base.select("query_id", "name", "brand", *[c for c in ("embedding_text",) if c in base.columns])
    recs = similar_items(embed(texts, "text", "vector"), columns, catalog, k, dim=dim, digits=digits, **search)
    known = resolved.select("query_id", F.col("id").alias("base_id"))
    missing = names.select("query_id").join(known, "query_id", "left_anti")
    return _for_all(recs, asking, base).unionByName(missing, allowMissingColumns=True)


def recommend_from_prompt(requests: DataFrame, catalog: DataFrame, embed: Embed, dislikes_of: DataFrame | None = None, k: int = 8, *, dim: int,
                          digits: int | None = None, **search) -> DataFrame:
    """Free text with sliders -> tiered list of the user, without disliked items
    and producers. requests: query_id, user_id, text, taste_* columns, optionally
    price bounds; dislikes_of: user_id, id."""
    asked = requests.where(F.coalesce(strip(F.col("text")), F.lit("")) != "")
    asked = embed(free_text_prompt(taste_words(asked)), "prompt", "vector")
    recs = recommend_by_text(asked, catalog, k, dim=dim, digits=digits, **search)
    recs = recs.join(requests.select("query_id", "user_id"), "query_id").join(catalog.select("id", "brand"), "id")
    if dislikes_of is not None:
        recs = apply_feedback(recs, *dislikes(dislikes_of, catalog))
    return assign_tiers(recs).select("query_id", "user_id", "position", "tier", "id", "score", "producer")


def recommend_from_likes(likes: DataFrame, catalog: DataFrame, embed: Embed, k: int = 5, *, dim: int, **more) -> DataFrame:
    """Every liked item asks for its like. likes: like_id, user_id, id."""
    asked = _kept(liked_queries(likes, catalog), "liked-names")
    found = recommend_from_name(asked.select("query_id", "typed_name"), catalog, embed, k, dim=dim, **more)
    return found.join(asked.select("query_id", "user_id"), "query_id")


def recommend_v1(names: DataFrame, catalog: DataFrame, embed: Embed, k: int = 5, *, dim: int, scorer: str = "exact_v1",
                 digits: int | None = None, **search) -> DataFrame:
    """The earlier chain from a typed name: resolved at a high score among few
    candidates, then one search by the weighted vectors of the item's notes,
    category and country."""
    resolved = _resolved(names, catalog, embed, dim=dim, min_score=V.NAME_MIN_SCORE_V1, candidates=V.NAME_CANDIDATES_V1, scorer=scorer, digits=digits)
    asking, asked = _distinct_asks(resolved, ["id"], "asked-items")
    base = asked.join(catalog.select("id", F.col("name").alias("base_name"), "description", "category", "country"), "id")
    for text, out in (("description", "tasting"), ("category", "category"), ("country", "country")):
        base = embed(base.withColumn("__asked", F.col(text)), "__asked", "__vector").withColumn(
            "__" + out, F.when(F.coalesce(strip(F.col(text)), F.lit("")) != "", F.col("__vector")) if out != "tasting" else F.col("__vector"))
    vectors = base.select("query_id", "base_name", *[F.col("__" + c).alias(c) for c in ("tasting", "category", "country")])
    recs = recommend_weighted(vectors, catalog, k, dim=dim, digits=digits, **search)
    return recs.withColumnRenamed("query_id", "ask_no").join(asking, "ask_no").select("query_id", "rank", "id", "score")


def _resolved(names: DataFrame, catalog: DataFrame, embed: Embed, **how) -> DataFrame:
    """query_id, id of typed names; equal names are resolved once."""
    asking, asked = _distinct_asks(names, ["typed_name"], "asked-names")
    found, _ = resolve_names(embed(asked, "typed_name", "vector"), catalog, **how)
    return _kept(found.select(F.col("query_id").alias("ask_no"), "id").join(asking, "ask_no").select("query_id", "id"), "resolved-names")


def _distinct_asks(rows: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Who asks what, and every different ask once: (query_id, ask_no) and (query_id = ask_no, *columns).
    A query with several rows asks for all of them together; rows without a query_id ask for nothing."""
    ask = F.struct(F.lit(1).alias("one"), *columns)
    grouped = rows.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_list(ask)).alias("asks"))
    grouped = _kept(grouped, name)
    numbered = _kept(grouped.select("asks").distinct().withColumn("ask_no", F.monotonically_increasing_id()), name)
    asking = grouped.join(numbered, "asks").select("query_id", "ask_no")
    return asking, numbered.select(F.col("ask_no").alias("query_id"), F.inline("asks")).select("query_id", *columns)


def _base_of(asked: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """The catalog's row of every ask; its rows where the id repeats."""
    return asked.select("query_id", "id").distinct().join(catalog.select("id", *columns), "id")


def _for_all(recs: DataFrame, asking: DataFrame, base: DataFrame) -> DataFrame:
    """Lists of asks for all queries that ask so."""
    base_ids = base.select("query_id", F.col("id").alias("base_id")).distinct()
    return recs.join(base_ids, "query_id").withColumnRenamed("query_id", "ask_no").join(asking, "ask_no").select(
        "query_id", "rank", "phase", "id", "score", "base_id")


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Narrow rows that several steps read: written once to the shared folder."""
    folder = work_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def text_as_base(requests: DataFrame, label: str = V.FREE_TEXT_BASE_LABEL, brand: str = "Free text",
                 description: str = V.FREE_TEXT_BASE_DESCRIPTION) -> DataFrame:
    """Stand-in base row of a free-text request."""
    text = strip(F.col("text"))
    return requests.where(F.coalesce(text, F.lit("")) != "").select(
        "query_id", F.concat(F.lit(label), text).alias("name"),
        F.lit(description).alias("description"), F.lit(brand).alias("brand"),
    )


def recommend_weighted(queries: DataFrame, catalog: DataFrame, k: int = 5, *, dim: int,
                       price_min: float = 0.0, price_max: float = 9999.0,
                       weights: dict[str, float] | None = None, missing_price_as_zero: bool = True,
                       digits: int | None = None, **search) -> DataFrame:
    """Earlier search: one weighted vector, 2k nearest, then the base name and
    the price are filtered and k kept. queries: query_id, base_name, tasting,
    category, country (vectors, the last two optional)."""
    vectors = combine_vectors(queries, weights or V.WEIGHTS_V1)
    matches = cosine_topk(
        vectors.select("query_id", "vector"), catalog, V.weighted_depth(k), dim=dim,
        payload=("name", "price"), digits=digits, **search,
    )
    fitting = price_between(without_base(matches, queries), price_min, price_max, missing_price_as_zero)
    return top_per_query(fitting, k).select("query_id", "rank", "id", "score")
