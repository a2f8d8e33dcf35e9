"""Plans that begin with raw text or raw pages."""

from pyspark.sql import functions as F, types as T

from checks import fixture as X
from checks.fixture import duck
from checks.registry import ORACLES, check
from checks.pages import PROFILE_CTE, TRUTH, WANTED
from checks.search import DEPTH, FUZZY, GUESS, K, sorted_words
from checks.sql_parts import CAT, MERGED, TYPED, VEC, constrained, filled, greedy, scored, stated_brand, strip
from checks.texts import LEGACY, SLIDERS, VARIANT_CTES, WORDS, _query_text
from nearshelf import fixed_values as V
from nearshelf.operators.query_text import query_text
from nearshelf.operators.text_vectors import embed_texts, fit_text_vectors
from nearshelf.plans import ingest as I, recommend as P
from nearshelf.session import work_folder
from nearshelf.sources.vector_log import read_current
from nearshelf.sources import manifest as M, records as RC
from nearshelf.streaming import ingest as SI

TEXT_DIM = 256


def text_vectors(fit: str, *rows: str, dim: int = TEXT_DIM) -> str:
    """CTEs <r>_vec(key, v) of the CTEs r(key, text), weighted by the texts of the CTE fit."""
    def buckets(r: str) -> str:
        text = f"CASE WHEN coalesce({strip('text')}, '') = '' THEN '{V.EMPTY_QUERY_TEXT}' ELSE text END"
        return f"""{r}_buckets AS (SELECT key, list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
      lambda w: ('0x' || left(md5(w), 8))::BIGINT % {dim}) AS b FROM {r})"""

    def vector(r: str) -> str:
        return f"""{r}_vec AS (SELECT key, list_transform(raw, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM (
      SELECT key, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS n FROM (
        SELECT key, list_transform(range(0, {dim}), lambda i: weights[i + 1] * len(list_filter(b, lambda x: x = i))) AS raw FROM {r}_buckets, weighted)))"""

    weights = f"""weighted AS (SELECT list(ln((t.n + 1.0::DOUBLE) / (coalesce(h.n, 0) + 1.0::DOUBLE)) ORDER BY i) AS weights
      FROM range(0, {dim}) r(i) CROSS JOIN (SELECT count(*) AS n FROM {fit}) t
      LEFT JOIN (SELECT bucket, count(*) AS n FROM (SELECT unnest(list_distinct(b)) AS bucket FROM {fit}_buckets) GROUP BY bucket) h ON h.bucket = i)"""
    return ", ".join([*map(buckets, rows), weights, *map(vector, rows)])


CATALOG_TEXTS = f"l0 AS ({LEGACY}), catalog_text AS (SELECT l0.id AS key, {_query_text(True)} AS text FROM l0 LEFT JOIN guess g ON g.name = l0.name)"


def _catalog_texts(spark, sf_dir):
    rows = X.spread(X.spark_sql(spark, sf_dir, LEGACY), "item_no").drop("embedding").withColumn("keywords_list", F.split("tags", ","))
    legacy = rows.withColumnRenamed("country", "country_of_origin")
    return legacy.withColumn("text", query_text(legacy)).withColumnRenamed("country_of_origin", "country")


# Texts of the catalog and of the requests turned into vectors by weights of the catalog's words.
@check("text_vector_topk", f"""WITH {CAT}, {GUESS}, {CATALOG_TEXTS}, asked AS (SELECT doc_id AS key, text FROM {{documents}} WHERE coalesce({strip('text')}, '') <> ''),
  {text_vectors('catalog_text', 'catalog_text', 'asked')},
  matches AS (SELECT * FROM (
    SELECT query_id, id, name, brand, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT a.key AS query_id, c.id, c.name, c.brand, round(list_inner_product(a.v, k.v), 6) + 0.0 AS score
      FROM asked_vec a, catalog_text_vec k JOIN cat c ON c.id = k.key WHERE list_sum(a.v) <> 0 AND list_sum(k.v) <> 0)) WHERE rank <= {V.free_text_depth(5)}),
  prod AS (SELECT m.*, coalesce({stated_brand('m.brand')}, g.brand_guess, '') AS producer FROM matches m LEFT JOIN guess g ON g.name = m.name),
  capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, producer ORDER BY rank) AS in_group FROM prod)
  SELECT query_id, CAST(place AS INTEGER) AS rank, id, score, producer FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY capped.rank) AS place FROM capped WHERE producer = '' OR in_group <= 2) WHERE place <= 5""")
def text_vector_topk(spark, sf_dir):
    texts = _catalog_texts(spark, sf_dir)
    model = fit_text_vectors(texts, dim=TEXT_DIM)
    asked = X.spread(X.spark_sql(spark, sf_dir, "SELECT doc_id AS query_id, text FROM {documents}"), "query_id")
    return P.recommend_by_text(
        embed_texts(model, asked, out="vector"), embed_texts(model, texts), 5, dim=TEXT_DIM, digits=6
    )


def _embed(model):
    return lambda rows, text, out: embed_texts(model, rows, text, out)


def _text_catalog(spark, sf_dir):
    """(catalog whose vectors are those of its texts, how to embed another text)."""
    texts = _catalog_texts(spark, sf_dir)
    model = fit_text_vectors(texts, dim=TEXT_DIM)
    folder = work_folder(spark, "text-catalog")
    embed_texts(model, texts).drop("text").write.parquet(folder)
    return spark.read.parquet(folder), _embed(model)


PROMPT = strip("coalesce(" + strip("text") + ", '') || chr(10) || chr(10) || 'Preferences: ' || "
               + " || '; ' || ".join(f"({w})" for w in WORDS.values()) + f" || '. {V.FLIGHT_REQUEST}'")
PROMPT_DISLIKES = f"SELECT DISTINCT user_id, id FROM ({X.SIGNALS}) s WHERE event_type = 'error'"


@check("recommend_from_prompt", f"""WITH {CAT}, {GUESS}, {CATALOG_TEXTS}, sliders AS (SELECT * FROM ({SLIDERS}) s WHERE coalesce({strip('text')}, '') <> ''),
  asked AS (SELECT doc_id AS key, {PROMPT} AS text FROM sliders),
  {text_vectors('catalog_text', 'catalog_text', 'asked')},
  matches AS (SELECT * FROM (
    SELECT query_id, id, name, brand, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT a.key AS query_id, c.id, c.name, c.brand, round(list_inner_product(a.v, k.v), 6) + 0.0 AS score
      FROM asked_vec a, catalog_text_vec k JOIN cat c ON c.id = k.key WHERE list_sum(a.v) <> 0 AND list_sum(k.v) <> 0)) WHERE rank <= {V.free_text_depth(8)}),
  prod AS (SELECT m.*, coalesce({stated_brand('m.brand')}, g.brand_guess, '') AS producer FROM matches m LEFT JOIN guess g ON g.name = m.name),
  capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, producer ORDER BY rank) AS in_group FROM prod),
  listed AS (SELECT *, query_id % 50 AS user_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY capped.rank) AS place FROM capped WHERE producer = '' OR in_group <= 2) WHERE place <= 8),
  hidden AS ({PROMPT_DISLIKES}),
  blocked AS (SELECT DISTINCT h.user_id, lower({strip('c.brand')}) AS key FROM hidden h JOIN cat c ON c.id = h.id WHERE coalesce({strip('c.brand')}, '') <> ''),
  kept AS (SELECT * FROM listed l WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = l.user_id AND h.id = l.id)
    AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.user_id = l.user_id AND b.key = lower({strip('l.brand')}))),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM kept)
  SELECT query_id, user_id, CAST(n AS INTEGER) AS position, CASE WHEN n < 4 THEN 'core' WHEN n < 6 THEN 'explore' ELSE 'wildcard' END AS tier,
    id, score, producer FROM placed""")
def recommend_from_prompt(spark, sf_dir):
    catalog, embed = _text_catalog(spark, sf_dir)
    requests = X.spread(X.spark_sql(spark, sf_dir, SLIDERS), "doc_id").withColumnRenamed("doc_id", "query_id").withColumn("user_id", F.col("query_id") % 50)
    return P.recommend_from_prompt(requests, catalog, embed, X.spark_sql(spark, sf_dir, PROMPT_DISLIKES), dim=TEXT_DIM, digits=6)


NAMES = f"SELECT query_id, typed_name FROM ({X.TYPED_NAMES}) t"


# Compared in tests with the same steps taken one by one.
@check("recommend_from_name")
def recommend_from_name(spark, sf_dir):
    catalog, embed = _text_catalog(spark, sf_dir)
    return P.recommend_from_name(X.spark_sql(spark, sf_dir, NAMES), catalog, embed, K, dim=TEXT_DIM, scorer="native", digits=6)


@check("recommend_from_name_exact")
def recommend_from_name_exact(spark, sf_dir):
    catalog, embed = _text_catalog(spark, sf_dir)
    return P.recommend_from_name(X.spark_sql(spark, sf_dir, NAMES), catalog, embed, K, dim=TEXT_DIM, digits=6)


def _likes(spark, sf_dir):
    return X.signals(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("like_id"), "user_id", "id")


@check("recommend_from_likes")
def recommend_from_likes(spark, sf_dir):
    catalog, embed = _text_catalog(spark, sf_dir)
    return P.recommend_from_likes(_likes(spark, sf_dir), catalog, embed, K, dim=TEXT_DIM, scorer="native", digits=6)


@check("recommend_from_likes_exact")
def recommend_from_likes_exact(spark, sf_dir):
    catalog, embed = _text_catalog(spark, sf_dir)
    return P.recommend_from_likes(_likes(spark, sf_dir), catalog, embed, K, dim=TEXT_DIM, digits=6)


@check("recommend_v1")
def recommend_v1(spark, sf_dir):
    catalog, embed = _text_catalog(spark, sf_dir)
    return P.recommend_v1(X.spark_sql(spark, sf_dir, NAMES), catalog, embed, K, dim=TEXT_DIM, digits=6)


# --- pages to vectors ---------------------------------------------------------

NAME_TEXTS = "name_text AS (SELECT id AS key, name AS text FROM cat)"
VECTORS_SQL = f"""WITH {CAT}, {TRUTH}, {PROFILE_CTE}, {NAME_TEXTS},
  profile AS (SELECT 'shop:' || sku AS key, profile_text AS text FROM profiles WHERE {WANTED}),
  {text_vectors('name_text', 'name_text', 'profile')}
  SELECT p.key AS id, left(p.text, 1000) AS embedding_text, CAST(i - 1 AS INTEGER) AS pos, round(v[i], 9) + 0.0 AS x
  FROM profile_vec v JOIN profile p USING (key), (SELECT unnest(range(1, {TEXT_DIM + 1})) AS i)"""


def _name_model(spark, sf_dir):
    return _embed(fit_text_vectors(X.catalog(spark, sf_dir).select(F.col("name").alias("text")), dim=TEXT_DIM))


def _vectors(table):
    return table.select("id", "embedding_text", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 9) + 0.0)


def _ingest(spark, sf_dir, base, n, manifest, pages=None):
    return I.run_ingest(
        X.pages(spark, sf_dir) if pages is None else pages, M.read_manifest(spark, f"{base}/{manifest}"), id_prefix="shop:", source="shop", stage_path=f"{base}/stage{n}",
        records_path=f"{base}/records", manifest_path=f"{base}/{manifest}", embed=_name_model(spark, sf_dir), table_path=f"{base}/table", batch_no=n)


@check("ingest_vectors", VECTORS_SQL)
def ingest_vectors(spark, sf_dir):
    """Pages to the vector table in one run."""
    base = work_folder(spark, "ingest")
    _ingest(spark, sf_dir, base, 1, "manifest")
    return _vectors(read_current(spark, base + "/table"))


@check("ingest_replay", VECTORS_SQL)
def ingest_replay(spark, sf_dir):
    """The run is taken to have died before its manifest, is repeated, and finds nothing on a third start."""
    base = work_folder(spark, "ingest")
    # All three starts read the pages, which are made once.
    X.pages(spark, sf_dir).write.parquet(base + "/in")
    pages = spark.read.parquet(base + "/in")
    _ingest(spark, sf_dir, base, 1, "lost", pages)
    _ingest(spark, sf_dir, base, 1, "manifest", pages)
    _ingest(spark, sf_dir, base, 2, "manifest", pages)
    return _vectors(read_current(spark, base + "/table").where("batch_no = 1"))


LINES_SQL = f"""WITH {CAT}, {TRUTH}, {PROFILE_CTE} SELECT sku, name, category, price, source_url, left(profile_text, 1000) AS embedding_text
    FROM profiles WHERE {WANTED}"""


@check("ingest_replay_lines", LINES_SQL)
def ingest_replay_lines(spark, sf_dir):
    """JSON lines of a run that died before its manifest, of its repetition, and of a third start that finds nothing."""
    base = work_folder(spark, "ingest")
    run = lambda n, manifest: I.run_ingest(
        X.pages(spark, sf_dir), M.read_manifest(spark, f"{base}/{manifest}"), id_prefix="shop:", source="shop", stage_path=f"{base}/stage{n}",
        records_path=f"{base}/records", manifest_path=f"{base}/{manifest}", by_run=True)
    run(1, "lost")
    run(2, "manifest")
    run(3, "manifest")
    schema = "sku STRING, name STRING, category STRING, price DOUBLE, source_url STRING, embedding_text STRING"
    return RC.read_runs(spark, base + "/records", T.StructType.fromDDL(schema), M.read_manifest(spark, base + "/manifest"))


@check("stream_vectors", VECTORS_SQL)
def stream_vectors(spark, sf_dir):
    """Pages to vectors as a stream."""
    base, embed = work_folder(spark, "stream"), _name_model(spark, sf_dir)
    X.pages(spark, sf_dir).write.parquet(base + "/in")
    source = spark.readStream.schema("path STRING, html STRING").parquet(base + "/in")
    SI.stream_ingest(source, out=base + "/out", checkpoint=base + "/checkpoint", id_prefix="shop:", source="shop",
                     embed=lambda rows: embed(rows, "profile_text", "embedding")).awaitTermination()
    return _vectors(SI.current_records(spark, base + "/out"))


# --- the exact name score -----------------------------------------------------

def exact_scores(pairs: str, version: int) -> str:
    """CTEs up to exact(pid, fuzzy) over a CTE pairs(pid, typed_name, name): twice the letters in matching blocks
    over all letters. A block is the longest common run, the first one in a, then in b; what lies before and after it is searched again."""
    def plain(x):
        return f"trim(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"

    def ascii_plain(x):
        return plain(f"regexp_replace({x}, '[\\x{{80}}-\\x{{FF}}]', '', 'g')")

    def ordered(x):
        return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"

    typed = ascii_plain(plain("lower(typed_name)") if version == 2 else "lower(typed_name)")
    block = """list_min(flatten(list_transform(range(a0, a1), lambda i: list_transform(list_filter(range(b0, b1), lambda j: a[i + 1] = b[j + 1]), lambda j:
      {'k': -len(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda k: a[i + 1:i + k] = b[j + 1:j + k])), 'i': i, 'j': j}))))"""
    return f"""sides AS (SELECT pid, {ordered(typed)} AS a, {ordered(ascii_plain('lower(name)'))} AS b FROM {pairs}),
  found AS (
    SELECT pid, a, b, 0 AS a0, length(a) AS a1, 0 AS b0, length(b) AS b1, NULL::STRUCT(k BIGINT, i BIGINT, j BIGINT) AS m FROM sides WHERE a <> b AND a <> '' AND b <> ''
    UNION ALL
    SELECT pid, a, b, part.a0, part.a1, part.b0, part.b1, m FROM (
      SELECT pid, a, b, m, unnest([{{'a0': a0, 'a1': m.i, 'b0': b0, 'b1': m.j}}, {{'a0': m.i - m.k, 'a1': a1, 'b0': m.j - m.k, 'b1': b1}}]) AS part
      FROM (SELECT pid, a, b, a0, a1, b0, b1, {block} AS m FROM found WHERE a1 > a0 AND b1 > b0) WHERE m IS NOT NULL)),
  matched AS (SELECT pid, sum(-k) AS n FROM (SELECT DISTINCT pid, m.k AS k, m.i AS i, m.j AS j FROM found WHERE m IS NOT NULL) GROUP BY pid),
  exact AS (SELECT s.pid, CAST(CASE WHEN a = b THEN 100 WHEN a = '' OR b = '' THEN 0
    ELSE round_even(100 * (2.0::DOUBLE * coalesce(n, 0) / (length(a) + length(b))), 0) END AS INTEGER) AS fuzzy FROM sides s LEFT JOIN matched USING (pid))"""


def _pairs_cte(k: int) -> str:
    return f"""{CAT}, {VEC}, {TYPED}, {scored('typed', k, bounds=False)},
  pairs AS (SELECT row_number() OVER () AS pid, m.query_id, m.rank, m.id, m.name, t.typed_name FROM matches m JOIN typed t ON t.query_id = m.query_id WHERE m.name <> '')"""


def _resolved_sql(k: int, version: int, least: int) -> str:
    return f"""WITH RECURSIVE {_pairs_cte(k)}, {exact_scores('pairs', version)}
    SELECT query_id, typed_name, id, name, fuzzy FROM (
      SELECT p.*, e.fuzzy, row_number() OVER (PARTITION BY query_id ORDER BY e.fuzzy DESC, p.rank) AS place FROM pairs p JOIN exact e USING (pid))
    WHERE place = 1 AND fuzzy >= {least}"""


ORACLES["fuzzy_exact"] = duck(f"""WITH RECURSIVE {_pairs_cte(20)}, {exact_scores('pairs', 2)}
  SELECT p.query_id, p.rank, p.id, e.fuzzy FROM pairs p JOIN exact e USING (pid)""")
ORACLES["resolve_names_exact"] = duck(_resolved_sql(20, 2, 75))
ORACLES["resolve_names_v1"] = duck(_resolved_sql(10, 1, 90))


# --- chains from a typed name ---------------------------------------------------

LIKED_NAMES = f"""SELECT s.event_id AS query_id, s.user_id, {strip('c.name')} AS typed_name FROM ({X.SIGNALS}) s JOIN cat c ON c.id = s.id
  WHERE s.event_type = 'click' AND coalesce({strip('c.name')}, '') <> ''"""


def _named(names: str, fit_more: list[str], candidates: int, least: int, scorer: str) -> str:
    """CTEs from texts to resolved(query_id, id), with vec (the catalog by its texts' vectors) and <r>_vec of the CTEs in fit_more.
    Equal pairs of names are scored once."""
    if scorer == "native":
        score = f"exact AS (SELECT pid, {FUZZY} AS fuzzy FROM (SELECT pid, {sorted_words('typed_name')} AS a, {sorted_words('name')} AS b FROM pair))"
    else:
        score = exact_scores("pair", 1 if scorer == "exact_v1" else 2)
    return f"""named AS ({names}), name_asked AS (SELECT query_id AS key, typed_name AS text FROM named),
  {text_vectors('catalog_text', 'catalog_text', 'name_asked', *fit_more)},
  vec AS (SELECT c.id, c.name, c.brand, c.price, k.v FROM cat c JOIN catalog_text_vec k ON k.key = c.id WHERE list_sum(k.v) <> 0),
  name_query AS (SELECT key AS query_id, v AS vector FROM name_asked_vec WHERE list_sum(v) <> 0),
  {scored('name_query', candidates, bounds=False, name='name_matches')},
  pairs AS (SELECT dense_rank() OVER (ORDER BY n.typed_name, m.name) AS pid, m.query_id, m.rank, m.id, m.name, n.typed_name
    FROM name_matches m JOIN named n ON n.query_id = m.query_id WHERE m.name <> ''),
  pair AS (SELECT DISTINCT pid, typed_name, name FROM pairs), {score},
  resolved AS (SELECT query_id, id FROM (
      SELECT p.query_id, p.id, e.fuzzy, row_number() OVER (PARTITION BY p.query_id ORDER BY e.fuzzy DESC, p.rank) AS place FROM pairs p JOIN exact e USING (pid))
    WHERE place = 1 AND fuzzy >= {least})"""


def _similar_to_names(names: str, scorer: str) -> str:
    """CTEs up to filled and req, the base items."""
    return f"""WITH RECURSIVE {CAT}, {GUESS}, {CATALOG_TEXTS}, {VARIANT_CTES},
  variant_asked AS (SELECT query_id || '|' || variant_no AS key, text FROM firsts WHERE place = 1),
  {_named(names, ['variant_asked'], V.NAME_CANDIDATES, V.NAME_MIN_SCORE, scorer)},
  req AS (SELECT r.query_id, r.id AS base_id, c.name, c.brand, c.embedding_text FROM resolved r JOIN cat c ON c.id = r.id),
  var AS (SELECT r.query_id, f.variant_no, a.v AS vector FROM resolved r JOIN firsts f ON f.query_id = r.id AND f.place = 1
    JOIN variant_asked_vec a ON a.key = f.query_id || '|' || f.variant_no WHERE list_sum(a.v) <> 0),
  {scored('var', DEPTH, variant='q.variant_no', bounds=False)}, {MERGED}, {greedy(K)}, {constrained(K)}, {filled(K)},
  answers AS (SELECT f.query_id, f.rank, f.phase, f.id, f.score, r.base_id FROM filled f JOIN req r ON r.query_id = f.query_id
    UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, NULL FROM named WHERE query_id NOT IN (SELECT query_id FROM resolved))"""


for _name, _scorer in (("", "native"), ("_exact", "exact")):
    ORACLES["recommend_from_name" + _name] = duck(f"{_similar_to_names(NAMES, _scorer)} SELECT * FROM answers")
    ORACLES["recommend_from_likes" + _name] = duck(
        f"{_similar_to_names(LIKED_NAMES, _scorer)} SELECT f.*, n.user_id FROM answers f JOIN named n ON n.query_id = f.query_id")

NOTES = " UNION ALL ".join(f"SELECT id || '|{c}' AS key, {c} AS text FROM cat" for c in ("description", "category", "country"))
ORACLES["recommend_v1"] = duck(f"""WITH RECURSIVE {CAT}, {GUESS}, {CATALOG_TEXTS}, note AS ({NOTES}),
  {_named(NAMES, ['note'], V.NAME_CANDIDATES_V1, V.NAME_MIN_SCORE_V1, 'exact_v1')},
  one_vector AS (
    SELECT r.query_id, c.name AS base_name, list_transform(range(1, {TEXT_DIM + 1}), lambda i: 0.75::DOUBLE * t.v[i]
      + CASE WHEN coalesce({strip('c.category')}, '') <> '' THEN 0.15::DOUBLE * g.v[i] ELSE 0 END
      + CASE WHEN coalesce({strip('c.country')}, '') <> '' THEN 0.1::DOUBLE * o.v[i] ELSE 0 END) AS vector
    FROM resolved r JOIN cat c ON c.id = r.id JOIN note_vec t ON t.key = r.id || '|description'
    JOIN note_vec g ON g.key = r.id || '|category' JOIN note_vec o ON o.key = r.id || '|country'),
  one_query AS (SELECT * FROM one_vector WHERE list_sum(vector) <> 0),
  {scored('one_query', V.weighted_depth(K), bounds=False)}
  SELECT * FROM (
    SELECT m.query_id, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY m.rank) AS INTEGER) AS rank, m.id, m.score
    FROM matches m JOIN one_query b ON b.query_id = m.query_id
    WHERE lower(coalesce(m.name, '')) <> lower(coalesce(b.base_name, '')) AND coalesce(m.price, 0) BETWEEN 0 AND 9999) WHERE rank <= {K}""")
