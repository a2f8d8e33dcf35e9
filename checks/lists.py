"""Session signals, list shaping, data of the comparison notes."""

from pyspark.sql import functions as F

from checks import fixture as X
from checks.registry import check
from checks.search import FREE_TEXT_CTE, _free_text
from checks.sql_parts import BRAND_KEY, CAT, REQ, VEC, guess_cte, scored, strip
from checks.texts import ELEMENTS, REVIEWED, snippets
from nearshelf import fixed_values as V
from nearshelf.operators import feedback as B, notes as G
from nearshelf.operators.search import cosine_topk
from nearshelf.plans import recommend as P

GUESS = guess_cte("cat")
SIG = f"sig AS ({X.SIGNALS})"


def _signals(spark, sf_dir, kind):
    return X.signals(spark, sf_dir).where(F.col("event_type") == kind)


HIDDEN = "hidden AS (SELECT DISTINCT user_id, id FROM sig WHERE event_type = 'error')"
BLOCKED = f"""blocked AS (SELECT DISTINCT h.user_id, {BRAND_KEY.replace('brand', 'c.brand')} AS brand_key
    FROM hidden h JOIN cat c ON c.id = h.id WHERE {BRAND_KEY.replace('brand', 'c.brand')} <> '')"""


@check("disliked_items", f"WITH {SIG}, {HIDDEN} SELECT user_id, id FROM hidden")
def disliked_items(spark, sf_dir):
    return B.dislikes(_signals(spark, sf_dir, "error"), X.catalog(spark, sf_dir))[0]


@check("blocked_producers", f"WITH {CAT}, {SIG}, {HIDDEN}, {BLOCKED} SELECT user_id, brand_key FROM blocked")
def blocked_producers(spark, sf_dir):
    return B.dislikes(_signals(spark, sf_dir, "error"), X.catalog(spark, sf_dir))[1]


# Request n belongs to user n % 150.
USER = "query_id % 150"
RECS = f"recs AS (SELECT f.query_id, {USER} AS user_id, f.rank, f.id, c.brand FROM free_text f JOIN cat c ON c.id = f.id)"
KEPT = f"""kept AS (SELECT r.* FROM recs r
    WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = r.user_id AND h.id = r.id)
      AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.user_id = r.user_id AND b.brand_key = {BRAND_KEY.replace('brand', 'r.brand')}))"""


def _recs(spark, sf_dir):
    recs = P.with_metadata(_free_text(spark, sf_dir), X.catalog(spark, sf_dir), ["brand"])
    return recs.select("query_id", F.expr(USER).alias("user_id"), "rank", "id", "brand")


def _kept(spark, sf_dir):
    return B.apply_feedback(_recs(spark, sf_dir), *B.dislikes(_signals(spark, sf_dir, "error"), X.catalog(spark, sf_dir)))


@check("feedback_filter", f"WITH {FREE_TEXT_CTE}, {SIG}, {HIDDEN}, {BLOCKED}, {RECS}, {KEPT} SELECT query_id, user_id, rank, id FROM kept")
def feedback_filter(spark, sf_dir):
    return _kept(spark, sf_dir).select("query_id", "user_id", "rank", "id")


@check("shown_list", f"""WITH {FREE_TEXT_CTE}, {SIG}, {HIDDEN}, {RECS} SELECT query_id, user_id, rank, id FROM recs r
    WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = r.user_id AND h.id = r.id)""")
def shown_list(spark, sf_dir):
    recs = _recs(spark, sf_dir).select("query_id", "user_id", "rank", "id")
    return B.hide_shown(recs, _signals(spark, sf_dir, "error")).select("query_id", "user_id", "rank", "id")


@check("tiers", f"""WITH {FREE_TEXT_CTE}, {SIG}, {HIDDEN}, {BLOCKED}, {RECS}, {KEPT},
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kept.rank) AS n FROM kept)
    SELECT query_id, id, CAST(n AS INTEGER) AS position, CASE WHEN n < 4 THEN 1 WHEN n < 6 THEN 2 ELSE 3 END AS tier_no,
           CASE WHEN n < 4 THEN 'core' WHEN n < 6 THEN 'explore' ELSE 'wildcard' END AS tier FROM placed""")
def tiers(spark, sf_dir):
    return B.assign_tiers(_kept(spark, sf_dir)).select("query_id", "id", "position", "tier_no", "tier")


@check("liked_queries", f"""WITH {CAT}, {SIG} SELECT s.event_id AS query_id, s.user_id, {strip('c.name')} AS typed_name
    FROM sig s JOIN cat c ON c.id = s.id WHERE s.event_type = 'click'""")
def liked_queries(spark, sf_dir):
    likes = _signals(spark, sf_dir, "click").withColumnRenamed("event_id", "like_id")
    return B.liked_queries(likes, X.catalog(spark, sf_dir))


@check("recent_likes", f"""WITH {CAT}, {SIG} SELECT * FROM (
    SELECT s.user_id, CAST(row_number() OVER (PARTITION BY s.user_id ORDER BY s.ts DESC, s.event_id DESC) AS INTEGER) AS place, c.name
    FROM sig s JOIN cat c ON c.id = s.id WHERE s.event_type = 'click') WHERE place <= 5""")
def recent_likes(spark, sf_dir):
    likes = _signals(spark, sf_dir, "click").join(X.catalog(spark, sf_dir).select("id", "name"), "id")
    return B.recent_likes(likes).select("user_id", "place", "name")


# Every supplier types something: a piece of an item name, a brand, a word, a
# letter, or nothing.
TYPED = f"""SELECT s_suppkey AS query_id, CASE s_suppkey % 7 WHEN 0 THEN ' BRAND#1' WHEN 1 THEN substr(name, 4, 9)
  WHEN 2 THEN upper(substr(name, 8, 4)) WHEN 3 THEN 'e' WHEN 4 THEN substr(name, 6, 2) || ' ' WHEN 5 THEN 'nothing like it'
  ELSE CASE WHEN s_suppkey < 20 THEN '  ' ELSE 'Ring' END END AS typed
FROM {{supplier}} JOIN ({X.CATALOG}) c ON item_no = s_suppkey"""
NAMES = "names AS (SELECT DISTINCT name FROM cat WHERE name <> '')"


@check("autocomplete", f"""WITH {CAT}, {NAMES}, typed AS ({TYPED}), hits AS (
      SELECT t.query_id, {strip('t.typed')} AS q, n.name, row_number() OVER (PARTITION BY t.query_id ORDER BY n.name) AS place
      FROM typed t JOIN names n ON contains(lower(n.name), lower({strip('t.typed')})))
    SELECT query_id, CAST(place AS INTEGER) AS place, name FROM hits WHERE q = '' OR place <= 250""")
def autocomplete(spark, sf_dir):
    names = X.catalog(spark, sf_dir).select("name").where(F.col("name") != "").distinct()
    return B.autocomplete(names, X.spark_sql(spark, sf_dir, TYPED))


@check("autocomplete_v1", f"""WITH {CAT}, {NAMES}, typed AS ({TYPED})
    SELECT t.query_id, CAST(row_number() OVER (PARTITION BY t.query_id ORDER BY n.name) AS INTEGER) AS place, n.name
    FROM typed t JOIN names n ON contains(lower(n.name), lower(t.typed))""")
def autocomplete_v1(spark, sf_dir):
    names = X.catalog(spark, sf_dir).select("name").where(F.col("name") != "").distinct()
    return B.autocomplete(names, X.spark_sql(spark, sf_dir, TYPED), limit=None)


@check("suggest_names", f"WITH {CAT}, {NAMES} SELECT name FROM names WHERE contains(lower(name), 'ring') ORDER BY name LIMIT 250")
def suggest_names(spark, sf_dir):
    return B.suggest_names(X.catalog(spark, sf_dir).select("name").where(F.col("name") != "").distinct(), " Ring ")


@check("review_rows", f"""WITH {CAT}, {REVIEWED},
    el AS (SELECT id, unnest(list_slice({ELEMENTS}, 1, 3)) AS r, generate_subscripts(list_slice({ELEMENTS}, 1, 3), 1) - 1 AS pos FROM reviewed),
    f AS (SELECT id, CAST(pos AS INTEGER) AS pos, coalesce(json_extract_string(r, '$.author'), 'Anonymous') AS author,
            json_extract_string(r, '$.rating') AS rating, coalesce(json_extract_string(r, '$.review'), '') AS review
          FROM el WHERE json_type(r) = 'OBJECT')
    SELECT *, '**' || author || '**' || coalesce(' (Rating: ' || rating || ')', '') || ': ' || review AS line FROM f""")
def review_rows(spark, sf_dir):
    return B.review_rows(X.items_with_reviews(spark, sf_dir))


# Rating objects as JSON text, as JSON text of JSON text, broken, or missing.
RATED = """SELECT p_partkey AS item_no, CASE p_partkey % 5
  WHEN 0 THEN '{"ratingValue":' || cast(p_size AS string) || ',"ratingCount":3}'
  WHEN 1 THEN '"{' || chr(92) || '"ratingValue' || chr(92) || '":' || chr(92) || '"' || p_brand || chr(92) || '"}"'
  WHEN 2 THEN '{"ratingValue": ' WHEN 3 THEN '{"ratingCount":1}' END AS rating FROM {part}"""


@check("rating_value", f"""SELECT item_no, CASE item_no % 5 WHEN 0 THEN cast(p_size AS VARCHAR) WHEN 1 THEN p_brand ELSE 'N/A' END AS rating_value
    FROM ({RATED}) r JOIN part ON p_partkey = item_no""")
def rating_value(spark, sf_dir):
    return X.spark_sql(spark, sf_dir, RATED).select("item_no", B.rating_value(F.col("rating")).alias("rating_value"))


CHART = """chart AS (
  SELECT f.query_id, c.name, c.price, f.score * 100 AS similarity_percentage, false AS is_base FROM free_text f JOIN cat c ON c.id = f.id
  UNION ALL SELECT r.query_id, c.name, c.price, 100.0::DOUBLE, true FROM req r JOIN cat c ON c.id = r.base_id),
  shown AS (SELECT * FROM chart WHERE price IS NOT NULL)"""


def _chart(spark, sf_dir):
    cat = X.catalog(spark, sf_dir).select("id", "name", "price")
    recs = _free_text(spark, sf_dir).join(cat, "id")
    base = X.requests(spark, sf_dir).select("query_id", F.col("base_id").alias("id")).join(cat, "id")
    return B.chart_rows(recs, base)


@check("chart_rows", f"WITH {FREE_TEXT_CTE}, {CHART} SELECT * FROM shown")
def chart_rows(spark, sf_dir):
    return _chart(spark, sf_dir)


@check("chart_axes", f"""WITH {FREE_TEXT_CTE}, {CHART} SELECT query_id, min(price) - 10 AS price_from, max(price) + 10 AS price_to,
    min(similarity_percentage) - 5 AS similarity_from, max(similarity_percentage) + 5 AS similarity_to FROM shown GROUP BY query_id""")
def chart_axes(spark, sf_dir):
    return B.chart_axes(_chart(spark, sf_dir))


# --- notes ------------------------------------------------------------------

def _details(side: str, default_name: str, none: str, cut: int, n: int) -> str:
    brand = f"coalesce(CASE WHEN {side}.brand <> '' AND {side}.brand <> 'N/A' THEN {side}.brand END, nullif({side}g.brand_guess, ''), 'N/A')"
    return (
        f"'Category: ' || coalesce({side}.category, 'N/A') || ', Origin: ' || coalesce({side}.country, 'N/A') || ', Producer: ' || {brand} "
        f"|| ', Description: ' || left(coalesce({side}.description, '{none}'), {cut}) || '..., Reviews: ' || {side}.s{n}"
    )


def _filled(template: str, values: dict[str, str]) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for key, value in values.items():
        out = f"replace({out}, '{{{key}}}', {value})"
    return out


SNIP = f"snip AS (SELECT *, {snippets(2)} AS s2, {snippets(1)} AS s1 FROM reviewed)"
NEAR = f"{CAT}, {VEC}, {REQ}, {scored('req', 3)}, {REVIEWED}, {SNIP}, {GUESS}"
PAIRS = """FROM matches m JOIN req q ON q.query_id = m.query_id
  JOIN snip b ON b.id = q.base_id LEFT JOIN guess bg ON bg.name = b.name
  JOIN snip r ON r.id = m.id LEFT JOIN guess rg ON rg.name = r.name"""


def _near(spark, sf_dir):
    """Three nearest items of every item, and the items themselves."""
    cat, req = X.catalog(spark, sf_dir), X.requests(spark, sf_dir)
    items = X.items_with_reviews(spark, sf_dir)
    recs = cosine_topk(req, cat, 3, dim=X.DIM, digits=6).select("query_id", "id").join(items, "id")
    base = req.select("query_id", F.col("base_id").alias("id")).join(items, "id")
    return recs, base


@check("pair_prompts", f"""WITH {NEAR}, d AS (
      SELECT m.query_id, m.id, b.name AS base_name, r.name AS rec_name, {_details('b', '', 'No desc.', 300, 2)} AS base_details,
             {_details('r', '', 'No desc.', 300, 2)} AS rec_details {PAIRS})
    SELECT query_id, id, base_details, rec_details, {_filled(G.PAIR_TEMPLATE, dict(base_details='base_details', rec_details='rec_details',
        base_name='base_name', rec_name='rec_name'))} AS prompt FROM d""")
def pair_prompts(spark, sf_dir):
    return G.pair_prompts(*_near(spark, sf_dir))


@check("base_prompts", f"""WITH {CAT}, {REQ}, {REVIEWED}, {SNIP}, {GUESS}, d AS (
      SELECT q.query_id, b.name AS base_name, {_details('b', '', 'No description.', 200, 1)} AS base_details
      FROM req q JOIN snip b ON b.id = q.base_id LEFT JOIN guess bg ON bg.name = b.name)
    SELECT query_id, base_details, {_filled(G.BASE_TEMPLATE, dict(base_details='base_details', base_name='base_name'))} AS prompt FROM d""")
def base_prompts(spark, sf_dir):
    req = X.requests(spark, sf_dir).select("query_id", F.col("base_id").alias("id"))
    return G.base_prompts(req.join(X.items_with_reviews(spark, sf_dir), "id"))


READABLE = "(json_valid(coalesce(b.reviews_json, '[]')) AND json_valid(coalesce(r.reviews_json, '[]')))"


def _notes(side: str) -> str:
    el = ELEMENTS.replace("reviews_json", f"{side}.reviews_json")
    texts = f"list_transform(list_slice({el}, 1, 3), lambda e: coalesce(json_extract_string(e, '$.review'), 'No review text'))"
    return f"CASE WHEN {READABLE} AND {texts} IS NOT NULL THEN CAST(to_json({texts}) AS VARCHAR) ELSE '[]' END"


@check("pair_prompts_v1", f"WITH {NEAR} SELECT m.query_id, m.id, {_notes('b')} AS base_notes, {_notes('r')} AS rec_notes {PAIRS}")
def pair_prompts_v1(spark, sf_dir):
    return G.pair_prompts_v1(*_near(spark, sf_dir)).drop("prompt")


# Answers of several shapes made of the documents: complete, blank parts, too
# few or too many parts, empty.
ANSWERS = """SELECT doc_id AS query_id, lang || cast(doc_id AS string) AS id, source AS base_name, lang AS rec_name,
  CASE doc_id % 7
    WHEN 0 THEN ' BASE_WINE_BLURB: on ' || source || ' ||END_SECTION||RECOMMENDED_WINE_BLURB:' || lang
         || '||END_SECTION||' || chr(10) || 'DETAILED_COMPARISON_MARKDOWN:' || text
    WHEN 1 THEN 'BASE_WINE_BLURB:||END_SECTION||' || source || '||END_SECTION||  '
    WHEN 2 THEN 'BASE_WINE_BLURB: a||END_SECTION||' || text
    WHEN 3 THEN 'a||END_SECTION||b||END_SECTION||c||END_SECTION||' || text
    WHEN 4 THEN '   ' WHEN 5 THEN text END AS response FROM {documents}"""


@check("parse_sections", f"""WITH a AS (SELECT *, {strip('response')} AS whole, string_split({strip('response')}, '||END_SECTION||') AS p FROM ({ANSWERS})),
    s AS (SELECT *, coalesce(len(p) = 3, false) AS three, {strip("replace(p[1], 'BASE_WINE_BLURB:', '')")} AS p1,
      {strip("replace(p[2], 'RECOMMENDED_WINE_BLURB:', '')")} AS p2, {strip("replace(p[3], 'DETAILED_COMPARISON_MARKDOWN:', '')")} AS p3 FROM a)
    SELECT query_id, id,
      CASE WHEN three AND p1 <> '' THEN p1 ELSE 'Enjoying ' || base_name || '? Here''s what makes it special based on its profile.' END AS base_wine_blurb,
      CASE WHEN three AND p2 <> '' THEN p2 ELSE rec_name || ' is a great pick if you like ' || base_name || ', offering similar enjoyment.' END AS recommended_wine_blurb,
      CASE WHEN three AND p3 <> '' THEN p3 WHEN three OR whole IS NULL THEN '{V.NOTES_PENDING_TEXT}' ELSE '**AI Notes:**' || chr(10) || whole END AS detailed_comparison_markdown
    FROM s""")
def parse_sections(spark, sf_dir):
    return G.parse_sections(X.spark_sql(spark, sf_dir, ANSWERS))


@check("base_blurb", f"""SELECT query_id, coalesce(nullif({strip('response')}, ''),
    'You likely enjoy ' || base_name || ' for its general characteristics and profile.') AS base_wine_blurb FROM ({ANSWERS})""")
def base_blurb(spark, sf_dir):
    return G.base_blurb(X.spark_sql(spark, sf_dir, ANSWERS))


@check("pending_notes", f"""WITH {FREE_TEXT_CTE}, {SIG} SELECT f.query_id, f.id, f.rank FROM free_text f
    WHERE NOT EXISTS (SELECT 1 FROM sig s WHERE s.event_type = 'click' AND s.event_id = f.query_id AND s.id = f.id)""")
def pending_notes(spark, sf_dir):
    explained = _signals(spark, sf_dir, "click").select(F.col("event_id").alias("query_id"), "id")
    return G.pending_notes(_free_text(spark, sf_dir), explained).select("query_id", "id", "rank")


@check("text_as_base", f"""SELECT doc_id AS query_id, 'Your vibe: ' || {strip('text')} AS name,
    'A sommelier-style prompt (not a specific bottle).' AS description, 'Free text' AS brand FROM {{documents}} WHERE {strip('text')} <> ''""")
def text_as_base(spark, sf_dir):
    return P.text_as_base(X.spark_sql(spark, sf_dir, "SELECT doc_id AS query_id, text FROM {documents}"))
