"""Vector search, name resolution, selection."""

from pyspark.sql import functions as F

from checks import fixture as X
from checks.registry import check
from checks.sql_parts import (
    CAT, MERGED, REQ, TYPED, VAR, VEC, constrained, filled, greedy, guess_cte, item_key, scored, stated_brand, strip,
)
from nearshelf.functions.text import item_key as key_of
from nearshelf.operators import candidates as C, diversify as D, resolve as R, search as S
from nearshelf.operators.cells import cosine_topk_cells as search_cells, write_cells
from nearshelf.plans import recommend as P
from nearshelf.session import work_folder

DIM = X.DIM
K = 6
DEPTH = 480  # of similar items at k = 6
GUESS = guess_cte("cat")


def _catalog(spark, sf_dir):
    return X.spread(X.catalog(spark, sf_dir), "item_no")


def _free_text(spark, sf_dir, k=8):
    return P.recommend_by_text(X.requests(spark, sf_dir), _catalog(spark, sf_dir), k, dim=DIM, digits=6)


FREE_TEXT_CTE = f"""{CAT}, {VEC}, {REQ}, {scored('req', 96)}, {GUESS},
  prod AS (
    SELECT m.*, coalesce({stated_brand('m.brand')}, g.brand_guess, '') AS producer
    FROM matches m LEFT JOIN guess g ON g.name = m.name
  ),
  capped AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, producer ORDER BY rank) AS in_group FROM prod
  ),
  free_text AS (
    SELECT query_id, place AS rank, id, score, producer FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY capped.rank) AS INTEGER) AS place
      FROM capped WHERE producer = '' OR in_group <= 2) WHERE place <= 8
  )"""


@check("free_text_capped", f"WITH {FREE_TEXT_CTE} SELECT query_id, rank, id, score, producer FROM free_text")
def free_text_capped(spark, sf_dir):
    return _free_text(spark, sf_dir)


@check("cosine_topk", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 20, bounds=False)}
    SELECT query_id, variant_no, rank, id, score FROM matches""")
def cosine_topk(spark, sf_dir):
    return S.cosine_topk(
        X.requests(spark, sf_dir).drop("price_min", "price_max"), _catalog(spark, sf_dir), 20, dim=DIM, digits=6
    )


@check("cosine_topk_blocks", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 20)}
    SELECT query_id, variant_no, rank, id, score FROM matches""")
def cosine_topk_blocks(spark, sf_dir):
    return S.cosine_topk(
        X.requests(spark, sf_dir), _catalog(spark, sf_dir), 20, dim=DIM, digits=6,
        method="blocks", block_bytes=256 * 8 * DIM,
    )


@check("cosine_topk_chunks", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 20)}
    SELECT query_id, variant_no, rank, id, score, name FROM matches""")
def cosine_topk_chunks(spark, sf_dir):
    """64 chunks of queries or more, over the catalog in place."""
    folder, asked = work_folder(spark, "catalog"), X.requests(spark, sf_dir)
    _catalog(spark, sf_dir).select("id", "embedding", "price", "name").write.parquet(folder)
    cat = spark.read.parquet(folder)
    return S.cosine_topk(asked, cat, 20, dim=DIM, digits=6, payload=("name",), method="chunks", seed_share=4,
                         broadcast_bytes=max(1, asked.count() // 64) * (8 * DIM + 16 * 20))


@check("cosine_topk_cells", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 20)}
    SELECT query_id, variant_no, rank, id, score FROM matches""")
def cosine_topk_cells(spark, sf_dir):
    folder, cat = work_folder(spark, "cells"), _catalog(spark, sf_dir).select("id", "embedding", "price")
    write_cells(cat, folder, dim=DIM)
    return search_cells(X.requests(spark, sf_dir), folder, cat.schema, 20, dim=DIM, digits=6)


@check("price_prefilter_topk", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 10)}
    SELECT query_id, rank, id, score, price FROM matches""")
def price_prefilter_topk(spark, sf_dir):
    return S.cosine_topk(
        X.requests(spark, sf_dir), _catalog(spark, sf_dir), 10, dim=DIM, payload=("price",), digits=6
    ).select("query_id", "rank", "id", "score", "price")


@check("price_postfilter_topk", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 20, bounds=False)}
    SELECT query_id, rank, id, score FROM matches WHERE coalesce(price, 0) BETWEEN 0 AND 930""")
def price_postfilter_topk(spark, sf_dir):
    found = S.cosine_topk(
        X.requests(spark, sf_dir).drop("price_min", "price_max"), _catalog(spark, sf_dir), 20, dim=DIM,
        payload=("price",), digits=6,
    )
    return S.price_between(found, 0, 930).select("query_id", "rank", "id", "score")


BOUND_TEXTS = """SELECT p_partkey AS query_id,
  CASE p_partkey % 5 WHEN 0 THEN '12.5' WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN 'cheap' ELSE 'NaN' END WHEN 2 THEN NULL ELSE cast(p_size AS string) END AS price_min,
  CASE p_partkey % 4 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'NaN' ELSE '80' END WHEN 1 THEN '' ELSE cast(p_retailprice AS string) END AS price_max
FROM {part}"""


@check("price_bounds", f"""SELECT query_id,
    CASE WHEN lo IS NULL OR hi IS NULL OR isnan(lo) THEN 0.0::DOUBLE ELSE lo END AS price_min,
    CASE WHEN lo IS NULL OR hi IS NULL OR isnan(hi) THEN 999999.0::DOUBLE ELSE hi END AS price_max
    FROM (SELECT query_id, try_cast(price_min AS DOUBLE) AS lo, try_cast(price_max AS DOUBLE) AS hi FROM ({BOUND_TEXTS}))""")
def price_bounds(spark, sf_dir):
    return S.price_bounds(X.spark_sql(spark, sf_dir, BOUND_TEXTS))


def _damaged(spark, sf_dir):
    """Vectors of which some are zero and some too short."""
    e = X.spark_sql(spark, sf_dir, "SELECT * FROM {embeddings}")
    v = F.col("embedding")
    return e.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform(v, lambda x: x * 0))
                    .when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 63)).otherwise(v).alias("embedding"))


@check("zero_vector_guard", "SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0 AND vec_id % 7 <> 0")
def zero_vector_guard(spark, sf_dir):
    return S.usable_vectors(_damaged(spark, sf_dir), "embedding", DIM).select("vec_id")


@check("dimension_check", "SELECT vec_id, 63 AS size FROM embeddings WHERE vec_id % 10 <> 0 AND vec_id % 7 = 0")
def dimension_check(spark, sf_dir):
    return S.wrong_dimension(_damaged(spark, sf_dir), "embedding", DIM).select("vec_id", F.size("embedding").alias("size"))


# The neighbours' vectors stand for the category and country texts.
WEIGHTED = """SELECT a.vec_id AS query_id, a.embedding AS tasting, b.embedding AS category, c.embedding AS country
FROM {embeddings} a
LEFT JOIN {embeddings} b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 4 <> 1
LEFT JOIN {embeddings} c ON c.vec_id = a.vec_id + 2 AND a.vec_id % 4 <> 2"""
WEIGHTED_SQL = f"""weighted AS (
  SELECT query_id, list_transform(range(1, {DIM + 1}), lambda i: 0.75::DOUBLE * tasting[i]::DOUBLE
    + coalesce(0.15::DOUBLE * category[i]::DOUBLE, 0) + coalesce(0.1::DOUBLE * country[i]::DOUBLE, 0)) AS vector
  FROM ({WEIGHTED}))"""


@check("weighted_vector", f"""WITH {WEIGHTED_SQL}
    SELECT query_id, CAST(i - 1 AS INTEGER) AS pos, round(vector[i], 9) + 0.0 AS x
    FROM weighted, (SELECT unnest(range(1, {DIM + 1})) AS i)""")
def weighted_vector(spark, sf_dir):
    rows = C.combine_vectors(X.spark_sql(spark, sf_dir, WEIGHTED), {"tasting": 0.75, "category": 0.15, "country": 0.1})
    return rows.select("query_id", F.posexplode("vector").alias("pos", "x")).select(
        "query_id", "pos", (F.round("x", 9) + 0.0).alias("x")
    )


@check("weighted_vector_topk", f"""WITH {CAT}, {VEC}, {WEIGHTED_SQL}, {scored('weighted', 10, bounds=False)},
    fitting AS (
      SELECT m.* FROM matches m JOIN vec b ON b.item_no = m.query_id
      WHERE lower(m.name) <> lower(b.name) AND coalesce(m.price, 0) BETWEEN 0 AND 940)
    SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fitting.rank) AS INTEGER) AS rank, id, score
                   FROM fitting) WHERE rank <= 5""")
def weighted_vector_topk(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    queries = X.spark_sql(spark, sf_dir, WEIGHTED).join(
        cat.select(F.col("item_no").alias("query_id"), F.col("name").alias("base_name")), "query_id"
    )
    return P.recommend_weighted(queries, cat, 5, dim=DIM, price_max=940, digits=6)


@check("multi_query_matches", f"""WITH {CAT}, {VEC}, {VAR}, {scored('var', 40, variant='q.variant_no')}
    SELECT query_id, variant_no, rank, id, score FROM matches""")
def multi_query_matches(spark, sf_dir):
    v, cat = X.variants(spark, sf_dir), _catalog(spark, sf_dir)
    return C.union_matches(*[
        S.cosine_topk(v.where(F.col("variant_no") == n), cat, 40, dim=DIM, digits=6) for n in (1, 2, 3)
    ])


def _matches(spark, sf_dir, k):
    return S.cosine_topk(
        X.variants(spark, sf_dir), _catalog(spark, sf_dir), k, dim=DIM, payload=("name", "brand"), digits=6
    )


def _candidates(spark, sf_dir):
    """Candidates with the item keys of the catalog."""
    columns = ("name", "brand", "item_key")
    found = S.cosine_topk(X.variants(spark, sf_dir), D.with_item_key(_catalog(spark, sf_dir)), DEPTH, dim=DIM, payload=columns, digits=6)
    return C.merge_candidates(found, payload=columns)


CAND_CTE = f"{CAT}, {VEC}, {REQ}, {VAR}, {scored('var', DEPTH, variant='q.variant_no')}, {MERGED}"


@check("merge_candidates", f"""WITH {CAT}, {VEC}, {VAR}, {scored('var', 40, variant='q.variant_no')}, {MERGED}
    SELECT query_id, cand_rank, id, score FROM cand""")
def merge_candidates(spark, sf_dir):
    return C.merge_candidates(_matches(spark, sf_dir, 40))


@check("base_excluded_topk", f"""WITH {CAT}, {VEC}, {REQ}, {scored('req', 30)},
    other AS (SELECT m.* FROM matches m JOIN vec b ON b.item_no = m.query_id WHERE lower(m.name) <> lower(b.name))
    SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY other.rank) AS INTEGER) AS rank,
                          id, score AS similarity_score, name FROM other) WHERE rank <= 6""")
def base_excluded_topk(spark, sf_dir):
    cat, req = _catalog(spark, sf_dir), X.requests(spark, sf_dir)
    found = S.cosine_topk(req, cat, 30, dim=DIM, payload=("name",), digits=6)
    kept = C.without_base(found, req.select("query_id", F.col("name").alias("base_name")))
    return C.top_per_query(kept, K).select("query_id", "rank", "id", F.col("score").alias("similarity_score"), "name")


@check("diversify_fold", f"""WITH RECURSIVE {CAND_CTE}, {GUESS}, {greedy(K)}
    SELECT query_id, rank, id, score, cand_rank FROM chosen""")
def diversify_fold(spark, sf_dir):
    return D.diversify(_candidates(spark, sf_dir), K)


@check("constrain_first_per_key", f"""WITH {CAND_CTE},
    ranked AS (
      SELECT c.*, {item_key('c.name')} AS key FROM cand c JOIN req b ON b.query_id = c.query_id WHERE lower(c.name) <> lower(b.name)),
    firsts AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.key ORDER BY cand_rank) AS place FROM ranked r)
    SELECT f.query_id, f.cand_rank, f.id, f.key AS item_key FROM firsts f JOIN req b ON b.query_id = f.query_id
    WHERE f.key = '' OR (f.place = 1 AND f.key <> {item_key('b.name')})""")
def constrain_first_per_key(spark, sf_dir):
    base = X.requests(spark, sf_dir).select(
        "query_id", F.col("name").alias("base_name"), key_of(F.col("name")).alias("base_key")
    )
    return C.first_per_key(_candidates(spark, sf_dir), base).select("query_id", "cand_rank", "id", "item_key")


# Nearest six as the chosen list, which the constraint pass then thins out.
NEAREST_CHOSEN = f"""cand AS (SELECT query_id, rank AS cand_rank, id, score, name, brand FROM matches), {GUESS},
  keyed AS (
    SELECT c.*, {item_key('c.name')} AS key, coalesce({stated_brand('c.brand')}, g.brand_guess, '') AS producer
    FROM cand c LEFT JOIN guess g ON g.name = c.name),
  chosen AS (SELECT *, cand_rank AS rank FROM keyed WHERE cand_rank <= {K})"""


def _nearest(spark, sf_dir, k):
    return S.cosine_topk(
        X.requests(spark, sf_dir), _catalog(spark, sf_dir), k, dim=DIM, payload=("name", "brand"), digits=6
    ).withColumnRenamed("rank", "cand_rank")


@check("constrain_pass", f"""WITH RECURSIVE {CAT}, {VEC}, {REQ}, {scored('req', K)}, {NEAREST_CHOSEN}, {constrained(K)}
    SELECT query_id, rank, id, score FROM taken""")
def constrain_pass(spark, sf_dir):
    return D.constrain(_nearest(spark, sf_dir, K), X.requests(spark, sf_dir), K)


@check("fallback_fill", f"""WITH RECURSIVE {CAT}, {VEC}, {REQ}, {scored('req', 40)}, {NEAREST_CHOSEN}, {constrained(K)}, {filled(K)}
    SELECT query_id, rank, phase, id, score FROM filled""")
def fallback_fill(spark, sf_dir):
    near, req = _nearest(spark, sf_dir, 40), X.requests(spark, sf_dir)
    taken = D.constrain(near.where(F.col("cand_rank") <= K), req, K)
    return C.fill_up(taken, near, req.select("query_id", F.col("name").alias("base_name")), K)


@check("base_modes", f"""WITH {CAT}, {VEC}, {REQ}, {GUESS}
    SELECT b.query_id, lower(b.name) AS base_name, {item_key('b.name')} AS base_key,
           coalesce({stated_brand('b.brand')}, g.brand_guess, '') AS base_producer,
           coalesce({strip('b.embedding_text')}, '') <> '' AS base_profiled
    FROM req b LEFT JOIN guess g ON g.name = b.name""")
def base_modes(spark, sf_dir):
    return D.base_columns(X.requests(spark, sf_dir))


SIMILAR_CTE = f"{CAND_CTE}, {GUESS}, {greedy(K)}, {constrained(K)}, {filled(K)}"


@check("similar_items", f"WITH RECURSIVE {SIMILAR_CTE} SELECT query_id, rank, phase, id, score FROM filled")
def similar_items(spark, sf_dir):
    return P.similar_items(X.variants(spark, sf_dir), X.requests(spark, sf_dir), _catalog(spark, sf_dir), K, dim=DIM, digits=6)


# --- names ------------------------------------------------------------------

def sorted_words(x: str) -> str:
    plain = f"regexp_replace(replace(replace(lower({x}), 'â', '~'), '~', 'ä'), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')"
    # one-byte letter for the accented one, as the edit distance here counts bytes
    return (f"replace(array_to_string(list_sort(list_filter(string_split({plain}, ' '), lambda w: w <> '')), ' '), 'ä', '~')")


FUZZY = """CAST(round(100 * (greatest(length(a), length(b)) - levenshtein(a, b))::DOUBLE
    / greatest(length(a), length(b))) AS INTEGER)"""
RESOLVE_CTE = f"""{CAT}, {VEC}, {TYPED}, {scored('typed', 20, bounds=False)},
  pairs AS (
    SELECT m.query_id, m.rank, m.id, m.name, t.typed_name, {sorted_words('t.typed_name')} AS a, {sorted_words('m.name')} AS b
    FROM matches m JOIN typed t ON t.query_id = m.query_id WHERE m.name <> ''),
  fuzzy AS (SELECT *, {FUZZY} AS fuzzy FROM pairs),
  resolved AS (
    SELECT query_id, typed_name, id, name, fuzzy FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fuzzy DESC, fuzzy.rank) AS place FROM fuzzy)
    WHERE place = 1 AND fuzzy >= 75)"""


@check("fuzzy_native", f"WITH {RESOLVE_CTE} SELECT query_id, rank, id, fuzzy FROM fuzzy")
def fuzzy_native(spark, sf_dir):
    typed = X.typed_names(spark, sf_dir)
    found = S.cosine_topk(typed, _catalog(spark, sf_dir), 20, dim=DIM, payload=("name",), digits=6)
    pairs = found.join(typed.select("query_id", "typed_name"), "query_id")
    return R.fuzzy_scores(pairs, "native").select("query_id", "rank", "id", "fuzzy")


@check("fuzzy_exact")
def fuzzy_exact(spark, sf_dir):
    typed = X.typed_names(spark, sf_dir)
    found = S.cosine_topk(typed, _catalog(spark, sf_dir), 20, dim=DIM, payload=("name",), digits=6)
    pairs = found.join(typed.select("query_id", "typed_name"), "query_id")
    return R.fuzzy_scores(pairs, "exact").select("query_id", "rank", "id", "fuzzy")


def _resolve(spark, sf_dir, scorer, **more):
    return R.resolve_names(X.typed_names(spark, sf_dir), _catalog(spark, sf_dir), dim=DIM, scorer=scorer, digits=6, **more)


@check("resolve_names", f"WITH {RESOLVE_CTE} SELECT query_id, typed_name, id, name, fuzzy FROM resolved")
def resolve_names(spark, sf_dir):
    return _resolve(spark, sf_dir, "native")[0]


@check("unresolved_names", f"""WITH {RESOLVE_CTE} SELECT query_id, typed_name FROM typed
    WHERE query_id NOT IN (SELECT query_id FROM resolved)""")
def unresolved_names(spark, sf_dir):
    return _resolve(spark, sf_dir, "native")[1]


@check("resolve_names_exact")
def resolve_names_exact(spark, sf_dir):
    return _resolve(spark, sf_dir, "exact")[0]


@check("resolve_names_v1")
def resolve_names_v1(spark, sf_dir):
    return _resolve(spark, sf_dir, "exact_v1", candidates=10, min_score=90)[0]


@check("effective_producer", f"""WITH {CAT}, {GUESS}
    SELECT c.id, coalesce({stated_brand('c.brand')}, g.brand_guess, '') AS producer FROM cat c LEFT JOIN guess g ON g.name = c.name""")
def effective_producer(spark, sf_dir):
    return R.with_effective_producer(_catalog(spark, sf_dir)).select("id", "producer")


# Every resolved name asks with the vectors of its item and the two next ones.
ITEM_VARIANTS = f"""
SELECT r.base_id AS id, v.variant_no, v.vector FROM ({X.VARIANTS}) v JOIN ({X.REQUESTS}) r ON r.query_id = v.query_id"""
TYPED_WITH_BOUNDS = f"""
SELECT t.query_id, t.typed_name, t.vector, r.price_min, r.price_max
FROM ({X.TYPED_NAMES}) t JOIN ({X.REQUESTS}) r ON r.query_id = t.query_id"""


@check("recommend_by_item", f"""WITH RECURSIVE {RESOLVE_CTE.replace('matches', 'name_matches')},
    req AS (
      SELECT r.query_id, r.id AS base_id, c.name, c.brand, c.embedding_text FROM resolved r JOIN cat c ON c.id = r.id),
    var AS (
      SELECT r.query_id, i.variant_no, i.vector::DOUBLE[] AS vector, b.price_min, b.price_max
      FROM resolved r JOIN ({ITEM_VARIANTS}) i ON i.id = r.id JOIN ({X.REQUESTS}) b ON b.query_id = r.query_id),
    {scored('var', DEPTH, variant='q.variant_no')}, {MERGED}, {GUESS}, {greedy(K)}, {constrained(K)}, {filled(K)}
    SELECT f.query_id, f.rank, f.phase, f.id, f.score, r.base_id FROM filled f JOIN req r ON r.query_id = f.query_id""")
def recommend_by_item(spark, sf_dir):
    return P.recommend_by_item(
        X.spark_sql(spark, sf_dir, TYPED_WITH_BOUNDS), X.spark_sql(spark, sf_dir, ITEM_VARIANTS),
        _catalog(spark, sf_dir), K, dim=DIM, scorer="native", digits=6,
    )
