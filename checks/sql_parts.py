"""Pieces of the comparison SQL."""

from checks.fixture import CATALOG, REQUESTS, TYPED_NAMES, VARIANTS
from nearshelf import fixed_values as V

WS = V.WHITESPACE
CLASS = V.WHITESPACE_CLASS
LINES = V.LINE_BREAK_CLASS


def quoted_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{CLASS}+', ' ', 'g'), '{WS}')"


def lines(x: str, keep: str = "true") -> str:
    """Stripped non-blank lines; `keep` tests the line l."""
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({x}, '{LINES}'), "
        f"lambda l: trim(l, '{WS}')), lambda l: l <> '' AND {keep}), chr(10))"
    )


def item_key(x: str) -> str:
    return (
        f"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '{V.YEAR}', ' ', 'g'), "
        f"'[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"
    )


def comma_items(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda k: trim(k, '{WS}')), lambda k: k <> '')"


def year(x: str) -> str:
    return f"nullif(regexp_extract({x}, '{V.YEAR}', 1), '')"


def producer_rule(x: str) -> str:
    rest = f"trim(regexp_replace({x}, '{V.YEAR}', ''), '{WS}')"
    toks = f"list_filter(string_split_regex({rest}, '{CLASS}+'), lambda w: w <> '')"
    stop = f"list_position(list_transform({toks}, lambda w: lower(w) IN {quoted_list(V.PRODUCER_STOP_WORDS)}), true)"
    return (
        f"CASE WHEN len({toks}) > 1 THEN nullif(array_to_string(list_slice({toks}, 1, "
        f"least(4, coalesce(nullif({stop}, 0), 99) - 1)), ' '), '') END"
    )


# brand guessed from a name, for every distinct name: guess(name, brand_guess)
def guess_cte(names: str) -> str:
    return f"""
g_words AS (
  SELECT name, unnest(list) AS w, generate_subscripts(list, 1) AS i
  FROM (SELECT name, list_filter(string_split_regex(name, '{CLASS}+'), lambda w: w <> '') AS list
        FROM (SELECT DISTINCT name FROM {names} WHERE name IS NOT NULL))
),
g_class AS (
  SELECT name, w, i, CASE
      WHEN left(w, 1) IN {quoted_list(V.BRAND_QUOTES)} THEN 'q'
      WHEN lower(w) IN {quoted_list(V.BRAND_OPENERS)} THEN 'o'
      WHEN lower(w) IN {quoted_list(V.BRAND_KEYWORDS)} THEN 'k'
      WHEN regexp_matches(w, '^\\p{{Lu}}') OR lower(w) LIKE 'st.%' OR lower(w) LIKE 'st-%' THEN 'p'
      ELSE 'l' END AS c
  FROM g_words WHERE NOT (i = 1 AND regexp_full_match(w, '\\d{{4}}'))
),
g_start AS (
  SELECT name, min(i) FILTER (c IN ('o', 'p')) AS first_word, min(i) FILTER (c = 'q') AS first_quote
  FROM g_class GROUP BY name
),
g_end AS (
  SELECT s.name, s.first_word, min(c.i) AS stop_word
  FROM g_start s LEFT JOIN g_class c ON c.name = s.name AND c.i > s.first_word AND c.c <> 'p'
  WHERE s.first_word IS NOT NULL AND coalesce(s.first_quote, 9999) > s.first_word
  GROUP BY s.name, s.first_word
),
g_brand AS (
  SELECT e.name, lower(regexp_replace(regexp_replace(string_agg(w, ' ' ORDER BY i), '''s?$', ''), ',+$', '')) AS b
  FROM g_end e JOIN g_class c ON c.name = e.name
   AND c.i BETWEEN e.first_word AND least(e.first_word + 2, coalesce(e.stop_word - 1, 9999))
  GROUP BY e.name
),
guess AS (
  SELECT n.name, CASE WHEN b IS NULL OR length(b) < 2 OR b IN {quoted_list(V.BRAND_KEYWORDS)}
                        OR b IN {quoted_list(V.BRAND_REGIONS)} THEN '' ELSE b END AS brand_guess
  FROM (SELECT DISTINCT name FROM {names} WHERE name IS NOT NULL) n LEFT JOIN g_brand USING (name)
)"""


def stated_brand(b: str) -> str:
    return f"CASE WHEN trim({b}, '{WS}') <> '' AND {b} <> 'N/A' THEN lower({b}) END"


CAT = f"cat AS ({CATALOG})"
VEC = """vec AS (SELECT id, item_no, name, brand, category, country, description, price, embedding_text,
  embedding::DOUBLE[] AS v FROM cat WHERE embedding IS NOT NULL)"""
REQ = f"req AS (SELECT * REPLACE (vector::DOUBLE[] AS vector) FROM ({REQUESTS}) r)"
VAR = f"var AS (SELECT * REPLACE (vector::DOUBLE[] AS vector) FROM ({VARIANTS}) v)"
TYPED = f"typed AS (SELECT * REPLACE (vector::DOUBLE[] AS vector) FROM ({TYPED_NAMES}) t)"


def scored(queries: str, k: int, *, variant: str = "1", bounds: bool = True, name: str = "matches") -> str:
    """matches(query_id, variant_no, rank, id, score, name, brand, price): best k."""
    price = "(q.price_min <= 0 OR c.price >= q.price_min) AND (q.price_max >= 999999 OR c.price <= q.price_max)"
    return f"""
{name}_all AS (
  SELECT q.query_id, {variant} AS variant_no, c.id, c.name, c.brand, c.price,
         round(list_cosine_similarity(q.vector, c.v), 6) + 0.0 AS score
  FROM {queries} q JOIN vec c ON {price if bounds else 'true'}
),
{name} AS (
  SELECT * FROM (
    SELECT query_id, variant_no, CAST(row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, id) AS INTEGER) AS rank,
           id, score, name, brand, price
    FROM {name}_all) WHERE rank <= {k}
)"""


MERGED = """
merged AS (
  SELECT query_id, id, max(score) AS score, min(variant_no * 1000000 + rank) AS seen,
         any_value(name) AS name, any_value(brand) AS brand
  FROM matches GROUP BY query_id, id
),
cand AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS cand_rank,
         id, score, name, brand
  FROM merged
)"""

BRAND_KEY = f"coalesce(lower(trim(brand, '{WS}')), '')"


def greedy(k: int) -> str:
    """chosen(query_id, rank, id, score, cand_rank ...): one recursion step per candidate."""
    return f"""
keyed AS (
  SELECT c.*, {item_key('c.name')} AS key, {BRAND_KEY.replace('brand', 'c.brand')} AS brand_key,
         coalesce({stated_brand('c.brand')}, g.brand_guess, '') AS producer
  FROM cand c LEFT JOIN guess g ON g.name = c.name
),
walk(query_id, pos, picked, keys, brands) AS (
  SELECT DISTINCT query_id, 0, CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM keyed
  UNION ALL
  SELECT w.query_id, w.pos + 1,
         CASE WHEN t.take THEN list_append(w.picked, c.cand_rank) ELSE w.picked END,
         CASE WHEN t.take THEN list_append(w.keys, c.key) ELSE w.keys END,
         CASE WHEN t.take THEN list_append(w.brands, c.brand_key) ELSE w.brands END
  FROM walk w
  JOIN keyed c ON c.query_id = w.query_id AND c.cand_rank = w.pos + 1
  CROSS JOIN LATERAL (SELECT NOT (
      (c.key <> '' AND list_contains(w.keys, c.key) AND len(w.picked) < {max(2, k // 2)})
      OR (c.brand_key <> '' AND len(list_filter(w.brands, lambda b: b = c.brand_key)) >= 2 AND len(w.picked) < {k - 1})
    ) AS take) t
  WHERE len(w.picked) < {k}
),
walked AS (SELECT query_id, max_by(picked, pos) AS picked FROM walk GROUP BY query_id),
chosen AS (
  SELECT c.*, CAST(list_position(w.picked, c.cand_rank) AS INTEGER) AS rank
  FROM walked w JOIN keyed c ON c.query_id = w.query_id AND list_contains(w.picked, c.cand_rank)
)"""


# taken(query_id, rank, id, score): the constraint pass over chosen(query_id, rank, ...)
def constrained(k: int, base: str = "req") -> str:
    return f"""
base AS (
  SELECT b.query_id, lower(coalesce(b.name, '')) AS base_name, {item_key('b.name')} AS base_key,
         coalesce({strip('b.embedding_text')}, '') <> '' AS profiled,
         coalesce({stated_brand('b.brand')}, g.brand_guess, '') AS producer
  FROM {base} b LEFT JOIN guess g ON g.name = b.name
),
limits AS (
  SELECT query_id, base_name, base_key, CASE WHEN profiled THEN '' ELSE producer END AS own,
         CASE WHEN profiled THEN {k} ELSE 2 END AS cap FROM base
),
sift(query_id, pos, kept, keys, producers) AS (
  SELECT query_id, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM limits
  UNION ALL
  SELECT s.query_id, s.pos + 1,
         CASE WHEN t.take THEN list_append(s.kept, c.id) ELSE s.kept END,
         CASE WHEN t.take THEN list_append(s.keys, c.key) ELSE s.keys END,
         CASE WHEN t.take THEN list_append(s.producers, c.producer) ELSE s.producers END
  FROM sift s
  JOIN chosen c ON c.query_id = s.query_id AND c.rank = s.pos + 1
  JOIN limits b ON b.query_id = s.query_id
  CROSS JOIN LATERAL (SELECT NOT (
      lower(coalesce(c.name, '')) = b.base_name
      OR (c.key <> '' AND (c.key = b.base_key OR list_contains(s.keys, c.key)))
      OR (b.own <> '' AND c.producer = b.own AND list_contains(s.producers, c.producer))
      OR (c.producer <> '' AND len(list_filter(s.producers, lambda p: p = c.producer)) >= b.cap)
    ) AS take) t
),
sifted AS (SELECT query_id, max_by(kept, pos) AS kept FROM sift GROUP BY query_id),
taken AS (
  SELECT c.query_id, CAST(list_position(s.kept, c.id) AS INTEGER) AS rank, c.id, c.score
  FROM sifted s JOIN chosen c ON c.query_id = s.query_id AND list_contains(s.kept, c.id)
)"""


def filled(k: int) -> str:
    return f"""
spare AS (
  SELECT c.query_id, 2 AS phase, c.cand_rank AS pos, c.id, c.score
  FROM cand c JOIN base b ON b.query_id = c.query_id
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.query_id = c.query_id AND t.id = c.id)
    AND ({strip('c.name')} = '' OR lower({strip('c.name')}) <> b.base_name)
),
filled AS (
  SELECT * FROM (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY phase, pos) AS INTEGER) AS rank, phase, id, score
    FROM (SELECT query_id, 1 AS phase, rank AS pos, id, score FROM taken UNION ALL SELECT * FROM spare))
  WHERE rank <= {k}
)"""
