"""Names, profiles, query texts."""

from pyspark.sql import functions as F

from checks import fixture as X
from checks.registry import check
from checks.sql_parts import CAT, CLASS, comma_items, guess_cte, item_key, lines, producer_rule, quoted_list, squeeze, strip, year
from nearshelf import fixed_values as V
from nearshelf.functions import text as T
from nearshelf.operators import query_text as Q
from nearshelf.operators.notes import review_snippets as snippets_of

GUESS = guess_cte("cat")


def _catalog(spark, sf_dir):
    return X.spread(X.catalog(spark, sf_dir), "item_no")


@check("vintage", f"WITH {CAT} SELECT id, {year('name')} AS vintage FROM cat")
def vintage(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", T.first_year(F.col("name")).alias("vintage"))


@check("producer_rule", f"WITH {CAT} SELECT id, {producer_rule('name')} AS producer FROM cat")
def producer_rule_(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", T.producer_from_name(F.col("name")).alias("producer"))


@check("brand_rule", f"WITH {CAT}, {GUESS} SELECT c.id, g.brand_guess AS brand FROM cat c JOIN guess g ON g.name = c.name")
def brand_rule(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", T.brand_from_name(F.col("name")).alias("brand"))


@check("item_key", f"WITH {CAT} SELECT id, {item_key('name')} AS key FROM cat")
def item_key_(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", T.item_key(F.col("name")).alias("key"))


def _style(x: str) -> str:
    low = " AND ".join(f"NOT starts_with(lower(l), '{p}')" for p in V.IDENTITY_LINE_PREFIXES)
    return f"coalesce(nullif({lines(x, low)}, ''), {x}, '')"


@check("style_text", f"""WITH {CAT} SELECT id, {_style('embedding_text')} AS style FROM cat
    UNION ALL SELECT 'doc:' || cast(doc_id AS string) AS id, {_style('text')} AS style FROM {{documents}}""")
def style_text(spark, sf_dir):
    docs = X.spark_sql(spark, sf_dir, "SELECT 'doc:' || cast(doc_id AS string) AS id, text AS embedding_text FROM {documents}")
    rows = _catalog(spark, sf_dir).select("id", "embedding_text").unionByName(docs)
    return rows.select("id", Q.style_text(F.col("embedding_text")).alias("style"))


# Rows without profile: tags come as a list, as older rows have them.
LEGACY = f"""SELECT *, CASE WHEN item_no % 4 = 1 THEN keywords END AS tags FROM ({X.CATALOG}) c"""


def _legacy(spark, sf_dir):
    rows = X.spread(X.spark_sql(spark, sf_dir, LEGACY), "item_no")
    return rows.withColumn("keywords_list", F.split("tags", ",")).withColumnRenamed("country", "country_of_origin")


def _query_text(identity: bool) -> str:
    def line(label, value):
        return f"CASE WHEN {value} <> '' THEN '{label}' || {value} || '.' END"

    stored = strip("l0.embedding_text")
    who = [line("Wine: ", "l0.name"), line("Producer: ", f"coalesce(CASE WHEN l0.brand <> '' AND l0.brand <> 'N/A' THEN l0.brand END, g.brand_guess)")]
    tail = "array_to_string(list_slice(string_split(l0.tags, ','), -8, -1), ', ')"
    parts = (who if identity else []) + [
        line("Type/Category: ", "l0.category"), line("Origin: ", "l0.country"), line("Bottle Size: ", "l0.size"),
        "CASE WHEN l0.description <> '' THEN 'Tasting notes:' || chr(10) || l0.description END",
        f"CASE WHEN l0.tags IS NOT NULL THEN 'Tags/Keywords: ' || {tail} || '.' END",
    ]
    built = lines(f"concat_ws(chr(10), {', '.join(parts)})")
    own = stored if identity else _style(stored)
    return f"CASE WHEN coalesce({stored}, '') <> '' THEN {own} ELSE coalesce(nullif({built}, ''), 'Basic wine entry for ' || coalesce(l0.name, 'Unknown Wine') || '.') END"


@check("query_text", f"""WITH {CAT}, {GUESS}, l0 AS ({LEGACY})
    SELECT l0.id, {_query_text(True)} AS full_text, {_query_text(False)} AS style_text FROM l0 LEFT JOIN guess g ON g.name = l0.name""")
def query_text(spark, sf_dir):
    rows = _legacy(spark, sf_dir)
    return rows.select("id", Q.query_text(rows).alias("full_text"), Q.query_text(rows, include_identity=False).alias("style_text"))


# The query texts of the rows of l0: firsts(query_id, variant_no, text, place).
VARIANT_CTES = f"""three AS (
    SELECT l0.id AS query_id, {_query_text(False)} AS t1,
      CASE WHEN len({comma_items("coalesce(l0.keywords, '')")}) > 0 THEN 'Varietal/Style cues: '
        || array_to_string(list_slice({comma_items("coalesce(l0.keywords, '')")}, -10, -1), ' ') END AS t2,
      CASE WHEN coalesce(l0.category, '') <> '' OR coalesce(l0.country, '') <> '' THEN
        'Category: ' || coalesce(l0.category, '') || '. Origin: ' || coalesce(l0.country, '') || '.' END AS t3
    FROM l0 LEFT JOIN guess g ON g.name = l0.name),
  rows AS (
    SELECT query_id, 1 AS variant_no, t1 AS text FROM three UNION ALL
    SELECT query_id, 2, t2 FROM three UNION ALL SELECT query_id, 3, t3 FROM three),
  firsts AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, {squeeze('text')} ORDER BY variant_no) AS place
    FROM rows WHERE {squeeze('text')} <> '')"""
VARIANT_TEXTS = f"""WITH {CAT}, {GUESS}, l0 AS ({LEGACY}),
  {VARIANT_CTES}
SELECT query_id, variant_no, text FROM firsts WHERE place = 1"""


@check("query_variants", VARIANT_TEXTS)
def query_variants(spark, sf_dir):
    return Q.query_variants(_legacy(spark, sf_dir).withColumnRenamed("id", "query_id"))


# JSON list elements of reviews_json, NULL when it is no JSON list
ELEMENTS = "CASE WHEN json_valid(reviews_json) AND json_type(reviews_json) = 'ARRAY' THEN json_extract(reviews_json, '$[*]') END"


def snippets(n: int) -> str:
    return (
        f"coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(list_slice({ELEMENTS}, 1, {n}), "
        "lambda r: json_extract_string(r, '$.review')), lambda t: t <> ''), "
        f"""lambda t: '"' || left(t, {V.SNIPPET_CHARS}) || '..."'), '; '), ''), '{V.NO_REVIEWS_TEXT}')"""
    )


REVIEWED = f"reviewed AS (SELECT *, {X.REVIEWS_JSON} AS reviews_json FROM cat)"


@check("review_snippets", f"WITH {CAT}, {REVIEWED} SELECT id, {snippets(2)} AS two, {snippets(1)} AS one FROM reviewed")
def review_snippets(spark, sf_dir):
    return X.items_with_reviews(spark, sf_dir).select(
        "id", snippets_of(F.col("reviews_json"), 2).alias("two"), snippets_of(F.col("reviews_json"), 1).alias("one")
    )


# Blank and padded texts among the documents.
TEXTS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(160) || chr(9)
  WHEN 2 THEN '  ' || text || chr(10) ELSE text END AS text FROM {documents}"""


@check("embedding_input", f"""SELECT doc_id,
    CASE WHEN coalesce({strip('text')}, '') = '' THEN '{V.EMPTY_QUERY_TEXT}' ELSE text END AS input,
    left(CASE WHEN coalesce({strip('text')}, '') = '' THEN '{V.EMPTY_QUERY_TEXT_V1}' ELSE {strip('text')} END, 3000) AS input_v1
    FROM ({TEXTS}) t""")
def embedding_input(spark, sf_dir):
    text = F.col("text")
    return X.spark_sql(spark, sf_dir, TEXTS).select(
        "doc_id", Q.embedding_input(text).alias("input"), Q.embedding_input(text, 1).alias("input_v1")
    )


SLIDERS = f"""SELECT doc_id, text, doc_id * 7 % 101 AS taste_body, doc_id * 11 % 101 AS taste_acidity,
  doc_id * 13 % 101 AS taste_tannin, doc_id * 17 % 101 AS taste_fruit_earth, doc_id * 19 % 101 AS taste_oak FROM ({TEXTS}) t"""


def _word(scale, low, high, *words) -> str:
    v = "taste_" + scale
    return f"CASE WHEN {v} <= {low} THEN '{words[0]}' WHEN {v} < {high} THEN '{words[1]}' ELSE '{words[2]}' END"


WORDS = {s[0]: _word(*s) for s in V.TASTE_SCALES}


@check("taste_words", "SELECT doc_id, " + ", ".join(f"{w} AS {s}_word" for s, w in WORDS.items()) + f" FROM ({SLIDERS}) s")
def taste_words(spark, sf_dir):
    return Q.taste_words(X.spark_sql(spark, sf_dir, SLIDERS)).select("doc_id", *[s[0] + "_word" for s in V.TASTE_SCALES])


@check("free_text_prompt", f"""SELECT doc_id, {strip("coalesce(" + strip('text') + ", '') || chr(10) || chr(10) || 'Preferences: ' || "
    + " || '; ' || ".join(f'({w})' for w in WORDS.values()) + f" || '. {V.FLIGHT_REQUEST}'")} AS prompt FROM ({SLIDERS}) s""")
def free_text_prompt(spark, sf_dir):
    return Q.free_text_prompt(Q.taste_words(X.spark_sql(spark, sf_dir, SLIDERS))).select("doc_id", "prompt")
