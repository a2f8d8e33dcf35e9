"""Catalog-like tables derived from the driver's tables.

The derivations are SQL texts valid in both engines (`||` everywhere, because
concat() treats nulls differently), so the checks differ in the operators only.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

DIM = 64


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a shared text: {table} stands for a driver table."""
    for t in ("nation", "part", "embeddings", "documents", "events", "pages", "labels", "supplier", "conversations"):
        sql = sql.replace("{%s}" % t, f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`")
    return spark.sql(sql)


def duck(sql: str) -> str:
    for t in ("nation", "part", "embeddings", "documents", "events", "pages", "labels", "supplier", "conversations"):
        sql = sql.replace("{%s}" % t, t)
    return sql


_CAP = "(upper(substr(p_name, 1, 1)) || substr(p_name, 2))"
_YEAR = "cast(1990 + p_partkey % 30 AS string)"

# Which of eight name shapes an item gets follows from its base name, so that
# one base name over several years makes several vintages of one item.
CATALOG = f"""
SELECT 'item:' || cast(p_partkey AS string) AS id,
       p_partkey AS item_no,
       CASE length(p_name) % 8
         WHEN 0 THEN {_YEAR} || ' ' || p_brand || ' ' || p_name
         WHEN 1 THEN {_YEAR} || ' Domaine ' || {_CAP} || ' Reserve'
         WHEN 2 THEN p_brand || '''s "' || p_name || '" ' || {_YEAR}
         WHEN 3 THEN 'The ' || {_CAP} || ' Estate ' || {_YEAR} || ' ' || cast(2001 + p_partkey % 7 AS string)
         WHEN 4 THEN {_YEAR} || ' St. ' || {_CAP} || ' Chablis Grand Cru'
         WHEN 5 THEN {_CAP} || ', ' || {_CAP} || ' Rioja ' || {_YEAR}
         WHEN 6 THEN {_YEAR} || ' ' || upper(p_name) || ' – Château ' || {_CAP}
         ELSE '  ' || p_name || '  '
       END AS name,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 'N/A'
            WHEN p_partkey % 29 = 0 THEN ' ' ELSE p_brand END AS brand,
       CASE p_partkey % 7
         WHEN 0 THEN p_type || ' / Wine - Red' WHEN 1 THEN 'Spirits / Gin' WHEN 2 THEN 'Virginia Wine'
         WHEN 3 THEN 'Old  and' || chr(9) || 'Rare / Wine - White' WHEN 4 THEN NULL
         WHEN 5 THEN 'sparkling WINE' ELSE p_type || ' / Wine - ' || n_name END AS category,
       n_name AS country,
       CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE cast(p_size AS string) || 'ml' END AS size,
       text AS description,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE p_partkey % 4
         WHEN 0 THEN replace(p_name, ' ', ',') || ', ' || p_type || ' ,' || p_brand || ',,' || n_name
         WHEN 1 THEN replace(p_name, ' ', ', ') || ',' || p_type || ',' || p_brand || ',' || n_name || ','
                     || cast(p_size AS string) || ',' || replace(p_name, ' ', '-') || ',' || lower(p_type) || ','
                     || lower(n_name) || ',' || lower(p_brand) || ',' || upper(p_name) || ',last'
         WHEN 2 THEN '' ELSE NULL END AS keywords,
       CASE WHEN p_partkey % 2 = 0 THEN
         'Name: ' || p_name || '.' || chr(10) || 'PRODUCER: ' || p_brand || '.' || chr(10) || chr(10)
         || '  Category: ' || p_type || '.  ' || chr(10) || 'Vintage: ' || {_YEAR} || '.' || chr(10)
         || 'Price: $' || cast(p_size AS string) || '.'
         || CASE WHEN p_partkey % 6 = 0 THEN chr(13) || chr(10) || 'Tasting notes: ' || coalesce(text, 'plain') ELSE '' END
       END AS embedding_text,
       embedding,
       label
FROM {{part}}
JOIN {{nation}} ON n_nationkey = p_partkey % 25
LEFT JOIN {{documents}} ON doc_id = p_partkey
LEFT JOIN {{embeddings}} ON vec_id = p_partkey
"""

# Every item with a vector asks for itself; bounds are on or off by item number.
REQUESTS = f"""
SELECT item_no AS query_id, id AS base_id, name, brand, embedding_text, embedding AS vector,
       CASE WHEN item_no % 3 = 1 THEN 905.0 ELSE 0.0 END AS price_min,
       CASE WHEN item_no % 3 = 2 THEN 940.0 ELSE 999999.0 END AS price_max
FROM ({CATALOG}) c WHERE embedding IS NOT NULL
"""

# The second and third query text of an item have the next items' vectors.
VARIANTS = f"""
SELECT r.query_id, v.variant_no, e.embedding AS vector, r.price_min, r.price_max
FROM ({REQUESTS}) r
CROSS JOIN (SELECT 1 AS variant_no UNION ALL SELECT 2 UNION ALL SELECT 3) v
JOIN {{embeddings}} e ON e.vec_id = r.query_id + v.variant_no - 1
"""

TYPED_NAMES = f"""
SELECT query_id, vector,
       CASE query_id % 4 WHEN 0 THEN name WHEN 1 THEN substr(name, 6) || ' ' || substr(name, 1, 5)
         WHEN 2 THEN replace(name, 'e', 'a') ELSE 'zzz nonsense ' || cast(query_id AS string) END AS typed_name
FROM ({REQUESTS}) r
"""

# Likes and dislikes of the event stream, each about one catalog item.
SIGNALS = """
SELECT event_id, ts, user_id, event_type,
       'item:' || cast(event_id * 7 % (SELECT max(p_partkey) + 1 FROM {part}) AS string) AS id
FROM {events} WHERE event_type IN ('click', 'error')
"""


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores: a driver table is one small file, hence one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, CATALOG)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, REQUESTS)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, VARIANTS)


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, TYPED_NAMES)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, SIGNALS)


# --- pages with JSON-LD -----------------------------------------------------
# The page of an item shows it in one of twelve ways (item_no % 12):
#  0 plain object            1 array, product second     2 two products
#  3 @type is a list         4 upper-case tag, padded    5 single-quoted type
#  6 numeric sku             7 offers is an object       8 broken block first
#  9 blank name             10 price as text            11 no block at all
# The expected records are computed from the columns, not from the pages.

def _quoted(c: str) -> str:
    packed = f"to_json(named_struct('v', {c}))"
    return f"CASE WHEN {c} IS NOT NULL THEN substr({packed}, 6, length({packed}) - 6) END"


def _member(key: str, value: str) -> str:
    """'"key":value,' or '' for a null value."""
    return f"""coalesce('"{key}":' || {value} || ',', '')"""


_REVIEWS = [
    f"""'{{"author":{{"name":"Critic ' || item_no || '"}},"reviewBody":' || coalesce({_quoted('description')}, 'null')
        || ',"reviewRating":{{"ratingValue":' || (85 + item_no % 15) || ',"bestRating":100}}}}'""",
    """'{"author":" Bob ","reviewRating":{"ratingValue":"90.5"}}'""",
    f"""'{{"reviewBody":' || {_quoted("'Short note on ' || name")} || '}}'""",
    """'{"author":"Nobody","reviewBody":"  ","reviewRating":"high"}'""",
    """'{"author":{"name":5},"reviewRating":{"ratingValue":77,"bestRating":"x"}}'""",
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per catalog item and all real pages: path, html."""
    reviews = "array_join(slice(array(" + ", ".join(_REVIEWS) + "), 1, int(item_no % 6)), ',')"
    shape = "item_no % 12"
    price = f"""CASE WHEN item_no % 9 = 4 THEN '"$12"' WHEN {shape} = 10 THEN '" ' || price || ' "' ELSE string(price) END"""
    offer = f"""'{{' || {_member('price', price)} || '"availability":"InStock"}}'"""
    body = " || ".join([
        """CASE WHEN item_no % 24 = 12 THEN '"name":"first name","weight":NaN,' WHEN item_no % 24 = 1 THEN '"sku":"first","weight":-Infinity,' ELSE '' END""",
        f"""CASE {shape} WHEN 3 THEN '"@type":["Product"],' ELSE '"@type":"Product",' END""",
        f"""CASE {shape} WHEN 6 THEN '"sku":' || item_no || ',' ELSE '"sku":" S' || item_no || ' ",' END""",
        f"""CASE {shape} WHEN 9 THEN '"name":"  ",' ELSE {_member('name', _quoted('name'))} END""",
        _member("category", _quoted("category")),
        f"""CASE item_no % 2 WHEN 0 THEN '"countryOfOrigin":{{"@type":"Country","name":' || {_quoted('country')} || '}},'
            ELSE {_member('countryOfOrigin', _quoted('country'))} END""",
        _member("size", _quoted("size")),
        _member("description", _quoted("description")),
        _member("keywords", _quoted("keywords")),
        f"""CASE {shape} WHEN 7 THEN '"offers":' || {offer} ELSE '"offers":[' || {offer} || ',{{"price":1}}]' END || ','""",
        f"""'"review":[' || {reviews} || '],'""",
        """CASE item_no % 2 WHEN 0 THEN '"aggregateRating":{"ratingCount":' || item_no % 50 || ',"ratingValue":"4.5"}'
           ELSE '"aggregateRating":"none"' END""",
    ])
    product = f"('{{' || {body} || '}}')"
    other = """'{"@type":"BreadcrumbList","name":"trail"}'"""
    open_tag = """'<script type="application/ld+json">'"""
    blocks = f"""CASE {shape}
        WHEN 1 THEN {open_tag} || '[' || {other} || ',' || product || ']</script>'
        WHEN 2 THEN {open_tag} || product || '</script><p>x</p>' || {open_tag}
                    || '{{"@type":"Product","sku":"other","name":"other"}}</script>'
        WHEN 4 THEN '<SCRIPT id="a" TYPE="application/LD+json" async>' || chr(10) || '  ' || product || chr(10) || '</SCRIPT >'
                    || '</SCRIPT>'
        WHEN 5 THEN '<script type=''application/ld+json''>' || product || '</script>'
        WHEN 8 THEN {open_tag} || '{{broken</script>' || {open_tag} || '  </script>' || {open_tag} || product || '</script>'
        WHEN 11 THEN '<script>var x = 1;</script>'
        ELSE {open_tag} || {other} || '</script>' || {open_tag} || product || '</script>' END"""
    url = """CASE WHEN item_no % 3 = 0 THEN '' ELSE '<META  property="og:url" content="http://shop/' || item_no || '">' END"""
    made = spread(spark_sql(spark, sf_dir, CATALOG), "item_no").selectExpr("*", f"{product} AS product").selectExpr(
        "'/pages/' || item_no || '.html' AS path",
        f"'<html><head>' || {url} || '</head><body>' || {blocks} || '</body></html>' AS html",
    )
    real = spark_sql(spark, sf_dir, "SELECT '/real/' || cast(page_id AS string) || '.htm' AS path, html FROM {pages}")
    return made.unionByName(real)


def items_with_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with reviews and ratings as JSON text, as older rows have."""
    return spark_sql(spark, sf_dir, f"SELECT *, {REVIEWS_JSON} AS reviews_json FROM ({CATALOG}) c")


REVIEWS_JSON = """
CASE item_no % 6
  WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN '[{"review": broken'
  WHEN 3 THEN '[{"author":"Ann ' || cast(item_no AS string) || '","rating":' || cast(80 + item_no % 20 AS string)
       || ',"review":"' || repeat('Long text on ' || country || '. ', 20) || '"}, "text only", {"review":"Second"}]'
  WHEN 4 THEN '{"review":"not a list"}'
  ELSE '[{"review":""},{"author":null,"review":"' || trim(name) || ' is fine"},{"rating":"91+","review":"x"},{"review":"fourth"}]'
END"""
