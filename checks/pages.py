"""Extraction, profiles and ingest.

The expected records come from the columns the pages were made of, so nothing of
the extraction is repeated here.
"""

import os

from pyspark.sql import functions as F

from checks import fixture as X
from checks.registry import check
from checks.sql_parts import CAT, producer_rule, squeeze, strip, year
from nearshelf import fixed_values as V
from nearshelf.operators import extract as E, profile as R
from nearshelf.operators.ranges import value_at
from nearshelf.plans import ingest as I
from nearshelf.session import work_folder
from nearshelf.sources import manifest as M, names as N, page_packs as PP, pages as PG, records as RC, vector_log as VL, vector_table as VT
from nearshelf.streaming import ingest as SI

SHAPE = "item_no % 12"
# what a page shows for each item; ok_page: it has a product with sku and name
TRUTH = f"""truth AS (
  SELECT item_no, '/pages/' || item_no || '.html' AS path,
    {SHAPE} NOT IN (3, 5, 6, 9, 11) AS ok_page,
    'S' || item_no AS sku, nullif({strip('name')}, '') AS name, nullif({squeeze('category')}, '') AS category, country,
    nullif({strip('size')}, '') AS size, CAST(NULL AS VARCHAR) AS image, nullif({strip('description')}, '') AS description,
    CASE WHEN {SHAPE} = 7 OR item_no % 9 = 4 THEN NULL ELSE price END AS price,
    CASE WHEN {SHAPE} = 7 THEN NULL ELSE 'InStock' END AS availability,
    nullif({strip('keywords')}, '') AS keywords,
    CASE WHEN item_no % 2 = 0 THEN '{{"ratingCount":' || (item_no % 50) || ',"ratingValue":"4.5"}}' END AS aggregate_rating,
    CASE WHEN item_no % 3 = 0 THEN NULL ELSE 'http://shop/' || item_no END AS source_url
  FROM cat),
reviews_made AS (
  SELECT item_no, 0 AS pos, 'Critic ' || item_no AS author, description AS review, (85 + item_no % 15)::DOUBLE AS rating, 100::DOUBLE AS best FROM truth WHERE item_no % 6 >= 1
  UNION ALL SELECT item_no, 1, 'Bob', NULL, 90.5, NULL FROM truth WHERE item_no % 6 >= 2
  UNION ALL SELECT t.item_no, 2, NULL, {strip("'Short note on ' || c.name")}, NULL, NULL FROM truth t JOIN cat c USING (item_no) WHERE t.item_no % 6 >= 3
  UNION ALL SELECT item_no, 4, NULL, NULL, 77, NULL FROM truth WHERE item_no % 6 >= 5),
reviews_kept AS (
  SELECT item_no, CAST(row_number() OVER (PARTITION BY item_no ORDER BY pos) - 1 AS INTEGER) AS pos, author, review, rating, best FROM reviews_made)"""
WANTED = ("(lower(coalesce(category, '')) LIKE '%wine%' AND NOT regexp_matches(lower(coalesce(category, '')), '"
          + "|".join(V.CATEGORY_MUST_NOT_CONTAIN) + "'))")
STATUS = f"CASE WHEN NOT ok_page THEN 'skip_parse' WHEN {WANTED} THEN 'ok' ELSE 'skip_not_wine' END"
FIELDS = "sku, name, category, country, size, image, description, price, availability, keywords, aggregate_rating, source_url"


def _pages(spark, sf_dir):
    return X.pages(spark, sf_dir)


@check("jsonld_blocks", f"""WITH {CAT}
    SELECT '/pages/' || item_no || '.html' AS path,
           CASE {SHAPE} WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 11 THEN 0 ELSE 2 END AS blocks FROM cat
    UNION ALL SELECT '/real/' || page_id || '.htm', len(regexp_extract_all(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>')) FROM {{pages}}""")
def jsonld_blocks(spark, sf_dir):
    return _pages(spark, sf_dir).select("path", F.size(E.jsonld_blocks(F.col("html"))).alias("blocks"))


@check("jsonld_objects", f"""WITH {CAT}
    SELECT '/pages/' || item_no || '.html' AS path, CASE {SHAPE} WHEN 5 THEN 0 WHEN 11 THEN 0 WHEN 4 THEN 1 WHEN 8 THEN 1 ELSE 2 END AS objects,
           CASE WHEN {SHAPE} IN (3, 5, 11) THEN 0 WHEN {SHAPE} = 2 THEN 2 ELSE 1 END AS products FROM cat
    UNION ALL SELECT '/real/' || page_id || '.htm', 0, 0 FROM {{pages}}""")
def jsonld_objects(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "path", F.size(E.jsonld_objects(F.col("html"))).alias("objects"), F.size(E.products_of(F.col("html"))).alias("products")
    )


@check("product_fields", f"WITH {CAT}, {TRUTH} SELECT path, {FIELDS} FROM truth WHERE ok_page")
def product_fields(spark, sf_dir):
    return E.extract_products(_pages(spark, sf_dir)).drop("reviews")


@check("product_reviews", f"""WITH {CAT}, {TRUTH}
    SELECT t.path, r.pos, r.author, {strip('r.review')} AS review, r.rating, r.best AS best_rating
    FROM truth t JOIN reviews_kept r USING (item_no) WHERE t.ok_page""")
def product_reviews(spark, sf_dir):
    rows = E.extract_products(_pages(spark, sf_dir)).select("path", F.posexplode("reviews").alias("pos", "r"))
    return rows.select("path", "pos", "r.*")


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN rtrim(left({x}, {n}), '{V.WHITESPACE}') || '{V.ELLIPSIS}' ELSE {x} END"


REVIEW_LINE = f"""CASE WHEN r.review IS NOT NULL AND r.rating IS NOT NULL
      THEN coalesce(r.author, 'Critic') || ' (' || r.rating::VARCHAR || '): ' || {_cut(strip('r.review'), 240)}
    WHEN r.review IS NOT NULL THEN coalesce(r.author, 'Critic') || ': ' || {_cut(strip('r.review'), 240)}
    ELSE coalesce(r.author, 'Critic') || ' rating: ' || r.rating::VARCHAR END"""


@check("reviews_flat", f"""WITH {CAT}, {TRUTH}
    SELECT t.path, r.pos, {REVIEW_LINE} AS line FROM truth t JOIN reviews_kept r USING (item_no) WHERE t.ok_page AND r.pos < 3""")
def reviews_flat(spark, sf_dir):
    rows = R.flatten_metadata(E.extract_products(_pages(spark, sf_dir)))
    return rows.select("path", F.posexplode("reviews").alias("pos", "line"))


@check("wine_predicate", f"WITH {CAT} SELECT id, {WANTED} AS wanted FROM cat")
def wine_predicate(spark, sf_dir):
    return X.catalog(spark, sf_dir).select("id", E.is_wanted_category(F.col("category")).alias("wanted"))


KEYWORD_ITEMS = f"list_filter(list_transform(string_split(t.keywords, ','), lambda k: trim(k, '{V.WHITESPACE}')), lambda k: k <> '')"
PROFILE = f"""concat_ws(chr(10), 'Name: ' || t.name || '.',
    'Producer: ' || {producer_rule('t.name')} || '.', 'Vintage: ' || {year('t.name')} || '.', 'Category: ' || t.category || '.',
    'Country: ' || t.country || '.', 'Bottle: ' || t.size || '.', 'Price: $' || printf('%.2f', t.price) || '.',
    'Tasting notes: ' || {squeeze('t.description')},
    CASE WHEN r.review IS NOT NULL THEN 'Critic (' || coalesce(r.author, 'Critic') || ')' || coalesce(' ' || r.rating::VARCHAR, '') || ': '
      || {_cut(squeeze('r.review'), 280)} END,
    'Keywords: ' || nullif(array_to_string(list_slice({KEYWORD_ITEMS}, -6, -1), ', '), '') || '.')"""
PROFILE_CTE = f"""profiles AS (SELECT t.*, {PROFILE} AS profile_text FROM truth t LEFT JOIN reviews_kept r ON r.item_no = t.item_no AND r.pos = 0
    WHERE ok_page)"""


@check("profile_text", f"""WITH {CAT}, {TRUTH}, {PROFILE_CTE} SELECT path, {year('name')} AS vintage, {producer_rule('name')} AS producer,
    profile_text, left(profile_text, 1000) AS stored FROM profiles""")
def profile_text(spark, sf_dir):
    rows = R.with_profile_text(E.extract_products(_pages(spark, sf_dir)))
    return rows.select("path", "vintage", "producer", "profile_text", R.stored_profile(F.col("profile_text")).alias("stored"))


@check("page_ids", f"""WITH {CAT} SELECT 'wine_' || item_no AS vector_id, sha1('/pages/' || item_no || '.html') AS key, 'shop:S' || item_no AS sku_id FROM cat
    UNION ALL SELECT NULL, sha1('/real/' || page_id || '.htm'), NULL FROM {{pages}}""")
def page_ids(spark, sf_dir):
    number = F.regexp_extract("path", r"^/pages/(\d+)\.", 1)
    return _pages(spark, sf_dir).select(
        E.file_vector_id(F.element_at(F.split("path", "/"), -1)).alias("vector_id"), E.page_key(F.col("path")).alias("key"),
        E.vector_id(F.when(number != "", F.concat(F.lit("S"), number)), "shop:").alias("sku_id"),
    )


# Bytes that are no UTF-8 in front of every page text.
@check("lossy_text", "SELECT page_id, 'a' || 'b' || html AS html FROM pages")
def lossy_text(spark, sf_dir):
    raw = X.spark_sql(spark, sf_dir, "SELECT page_id, concat(X'61FF62', cast(html AS binary)) AS content FROM {pages}")
    return raw.select("page_id", PG.decode_text(F.col("content")).alias("html"))


def _page_id():
    return F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("bigint").alias("page_id")


def _single_files(spark, sf_dir):
    """Every real page written as a file of its own; the folders."""
    base = work_folder(spark, "files")
    rows = X.spark_sql(spark, sf_dir, "SELECT page_id, html FROM {pages}").repartition("page_id")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        rows.write.partitionBy("page_id").text(base)
        return base + "/page_id=*"
    folder = path.toUri().getPath()

    # The same folders and files, from the tasks: Hadoop's local file system starts a process for each of them.
    def write(batches):
        last, out = None, None
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                name = "__HIVE_DEFAULT_PARTITION__" if page_id is None else str(page_id)
                if name != last:
                    if out:
                        out.close()
                    os.makedirs(f"{folder}/page_id={name}", exist_ok=True)
                    last, out = name, open(f"{folder}/page_id={name}/part-0.txt", "wb")
                out.write((html or b"") + b"\n")
            yield batch.select(["page_id"])
        if out:
            out.close()

    raw = rows.select(F.col("page_id").cast("bigint"), F.col("html").cast("binary")).sortWithinPartitions("page_id")
    raw.mapInArrow(write, "page_id bigint").agg(F.count("*")).collect()
    return base + "/page_id=*"


@check("page_files", "SELECT page_id, html || chr(10) AS html FROM pages")
def page_files(spark, sf_dir):
    """Pages read from files of their own."""
    return PG.read_pages(spark, _single_files(spark, sf_dir), glob="*.txt").select(_page_id(), "html")


@check("page_packs", "SELECT page_id, html || chr(10) AS html FROM pages")
def page_packs(spark, sf_dir):
    """The same pages packed, in a second run those that the first one left out, and read from the packs."""
    files, packs = _single_files(spark, sf_dir), work_folder(spark, "packs")
    PP.pack_pages(spark, files.replace("*", "*[0-4]"), packs, glob="*.txt")
    PP.pack_pages(spark, files, packs, glob="*.txt")
    return PP.read_packed(spark, packs).select(_page_id(), "html")


ALL_PATHS = f"SELECT '/pages/' || cast(item_no AS string) || '.html' AS path FROM ({X.CATALOG}) c UNION ALL SELECT '/real/' || cast(page_id AS string) || '.htm' FROM {{pages}}"


@check("first_pages", f"SELECT path FROM ({ALL_PATHS}) ORDER BY path LIMIT 300")
def first_pages(spark, sf_dir):
    return PG.first_pages(_pages(spark, sf_dir), 300).select("path")


@check("first_pages_half", f"SELECT path FROM ({ALL_PATHS}) ORDER BY path LIMIT (SELECT count(*) // 2 FROM ({ALL_PATHS}))")
def first_pages_half(spark, sf_dir):
    """Half of all paths, found by ranges at every size."""
    pages = _pages(spark, sf_dir)
    last = value_at(pages, "path", pages.count() // 2)
    return pages.where(F.col("path") <= last).select("path")


# --- ingest -----------------------------------------------------------------

DONE = f"SELECT sha1('/pages/' || cast(item_no AS string) || '.html') AS key, 'ok' AS status, cast(NULL AS string) AS sku FROM ({X.CATALOG}) c WHERE label = 3"


@check("ingest_to_do", f"SELECT path FROM ({ALL_PATHS}) WHERE sha1(path) NOT IN (SELECT key FROM ({DONE}))")
def ingest_to_do(spark, sf_dir):
    return I.pages_to_do(_pages(spark, sf_dir), X.spark_sql(spark, sf_dir, DONE)).select("path")


STATUS_CTE = f"""{CAT}, {TRUTH}, classified AS (
  SELECT sha1(path) AS key, {STATUS} AS status, CASE WHEN ok_page AND NOT {WANTED} THEN sku END AS sku FROM truth
  UNION ALL SELECT sha1('/real/' || page_id || '.htm'), 'skip_parse', NULL FROM pages)"""


@check("ingest_status", f"WITH {STATUS_CTE} SELECT key, status, sku FROM classified WHERE key NOT IN (SELECT key FROM ({DONE}))")
def ingest_status(spark, sf_dir):
    return I.plan_ingest(
        _pages(spark, sf_dir), X.spark_sql(spark, sf_dir, DONE), id_prefix="shop:", source="shop"
    ).manifest


@check("status_counts", f"WITH {STATUS_CTE} SELECT status, count(*) AS pages FROM classified GROUP BY status")
def status_counts(spark, sf_dir):
    return I.status_counts(E.classify_pages(_pages(spark, sf_dir)))


RECORD_COLUMNS = "id, sku, name, category, country, size, image, description, price, availability, keywords, aggregate_rating, source_url, source, embedding_text, profile_text"
RECORDS_SQL = f"""WITH {CAT}, {TRUTH}, {PROFILE_CTE}
    SELECT 'shop:' || sku AS id, {FIELDS}, 'shop' AS source, left(profile_text, 1000) AS embedding_text, profile_text FROM profiles WHERE {WANTED}"""


@check("ingest_records", RECORDS_SQL)
def ingest_records(spark, sf_dir):
    none = spark.createDataFrame([], M.MANIFEST)
    return I.plan_ingest(_pages(spark, sf_dir), none, id_prefix="shop:", source="shop").records.select(*RECORD_COLUMNS.split(", "))


@check("ingest_twice", f"WITH {STATUS_CTE} SELECT status, count(*) AS pages, 0 AS second_run FROM classified GROUP BY status")
def ingest_twice(spark, sf_dir):
    """A run writes records and manifest; a second run finds nothing to do."""
    base = work_folder(spark, "ingest")
    run = lambda n: I.run_ingest(
        _pages(spark, sf_dir), M.read_manifest(spark, base + "/manifest"), id_prefix="shop:", source="shop",
        stage_path=f"{base}/stage{n}", records_path=base + "/records", manifest_path=base + "/manifest",
    )
    first, second = run(1), run(2)
    return first.join(second.withColumnRenamed("pages", "second_run"), "status", "left").na.fill(0)


@check("records_json", f"""WITH {CAT}, {TRUTH}, {PROFILE_CTE} SELECT sku, name, category, price, source_url, left(profile_text, 1000) AS embedding_text
    FROM profiles WHERE {WANTED}""")
def records_json(spark, sf_dir):
    path = work_folder(spark, "records")
    none = spark.createDataFrame([], M.MANIFEST)
    records = I.plan_ingest(_pages(spark, sf_dir), none, id_prefix="shop:", source="shop").records.drop("id", "profile_text")
    RC.append_records(records, path)
    return RC.read_records(spark, path, records.schema).select("sku", "name", "category", "price", "source_url", "embedding_text")


@check("stream_ingest", RECORDS_SQL)
def stream_ingest(spark, sf_dir):
    """The pages arrive as files of a stream that is started twice."""
    base = work_folder(spark, "stream")
    _pages(spark, sf_dir).write.parquet(base + "/in")
    for _ in range(2):
        source = spark.readStream.schema("path STRING, html STRING").parquet(base + "/in")
        SI.stream_ingest(source, out=base + "/out", checkpoint=base + "/checkpoint", id_prefix="shop:", source="shop").awaitTermination()
    return SI.current_records(spark, base + "/out").select(*RECORD_COLUMNS.split(", "))


# --- names and the vector table ---------------------------------------------

@check("name_catalog", f"WITH {CAT} SELECT DISTINCT name FROM cat WHERE name <> ''")
def name_catalog(spark, sf_dir):
    return N.distinct_names(X.catalog(spark, sf_dir))


@check("names_csv", f"WITH {CAT} SELECT DISTINCT name FROM cat WHERE name <> ''")
def names_csv(spark, sf_dir):
    path = work_folder(spark, "names")
    N.write_names(N.distinct_names(X.catalog(spark, sf_dir)), path)
    return N.read_names(spark, path)


LISTED = "SELECT DISTINCT 'item:' || cast(event_id * 7 % (SELECT max(p_partkey) + 1 FROM {part}) AS string) AS id FROM {events} WHERE event_type = 'purchase'"


@check("id_lookup", f"WITH {CAT} SELECT DISTINCT name FROM cat WHERE name <> '' AND id IN (SELECT id FROM ({LISTED}))")
def id_lookup(spark, sf_dir):
    return N.names_by_id(X.catalog(spark, sf_dir), X.spark_sql(spark, sf_dir, LISTED))


# Price changes: every purchase event sets its item's price; new items may come.
CHANGES = """SELECT 'item:' || cast(event_id % (SELECT 2 * max(p_partkey) FROM {part}) AS string) AS id,
  event_id AS batch_no, value AS price FROM {events} WHERE event_type = 'purchase'"""
EXISTING = f"SELECT id, cast(-1 AS bigint) AS batch_no, price FROM ({X.CATALOG}) c"


@check("upsert_latest", f"""SELECT id, batch_no, price FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC) AS place
    FROM (SELECT * FROM ({EXISTING}) UNION ALL SELECT * FROM ({CHANGES}))) WHERE place = 1""")
def upsert_latest(spark, sf_dir):
    return VT.upsert_latest(X.spark_sql(spark, sf_dir, EXISTING), X.spark_sql(spark, sf_dir, CHANGES))


UPSERTED_SQL = f"""SELECT id, batch_no, price FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC) AS place
    FROM (SELECT * FROM ({EXISTING}) UNION ALL SELECT * FROM ({CHANGES}))) WHERE place = 1"""


def _price_log(spark, sf_dir):
    """The table, then the changes in four batches of which one comes twice, the latest first."""
    path = work_folder(spark, "log")
    VL.append_batch(X.spark_sql(spark, sf_dir, EXISTING), path, batch_id="all")
    changes = X.spark_sql(spark, sf_dir, CHANGES)
    for n in (3, 0, 3, 1, 2):
        VL.append_batch(changes.where(F.col("batch_no") % 4 == n), path, batch_id=f"changes-{n}")
    return path


@check("upsert_log", UPSERTED_SQL)
def upsert_log(spark, sf_dir):
    return VL.read_current(spark, _price_log(spark, sf_dir))


@check("log_statistics", f"SELECT NULL::INTEGER AS dimension, count(*) AS total_vector_count FROM ({UPSERTED_SQL})")
def log_statistics(spark, sf_dir):
    path = _price_log(spark, sf_dir)
    VL.compact(spark, path)
    return VL.log_statistics(spark, path)


@check("table_statistics", f"WITH {CAT} SELECT max(len(embedding))::INTEGER AS dimension, count(*) AS total_vector_count FROM cat")
def table_statistics(spark, sf_dir):
    return VT.table_statistics(X.catalog(spark, sf_dir))


@check("source_counts", f"WITH {CAT} SELECT country AS source, count(*) AS vector_count FROM cat GROUP BY country")
def source_counts(spark, sf_dir):
    return VT.source_counts(X.catalog(spark, sf_dir).withColumnRenamed("country", "source"))


REVIEWS_TEXT = """CASE item_no % 6 WHEN 0 THEN ''
    WHEN 3 THEN 'Ann ' || item_no || '|' || repeat('Long text on ' || country || '. ', 20) || '|' || (80 + item_no % 20)::DOUBLE || ';-|Second|-'
    WHEN 5 THEN CASE WHEN contains(name, '"') THEN '-|' || id || '|-' ELSE '-||-;-|' || trim(name) || ' is fine|-;-|x|-;-|fourth|-' END ELSE '-|' || id || '|-' END"""
ABSENT = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("sku", "image", "availability", "aggregate_rating", "source_url", "source"))


@check("normalized_catalog", f"""WITH {CAT} SELECT id, name, brand, category, country, size, description, embedding_text, {ABSENT},
    coalesce(nullif(keywords, ''), lower(category)) AS keywords, price, CAST(len(embedding) AS INTEGER) AS dim, {REVIEWS_TEXT} AS reviews FROM cat""")
def normalized_catalog(spark, sf_dir):
    """Older names, reviews as JSON text where the row has a list there, else as plain texts."""
    old = X.items_with_reviews(spark, sf_dir).withColumn("reviews", F.array("id")).withColumnRenamed("country", "country_of_origin").withColumn(
        "keywords_list", F.array(F.lower("category"))
    ).withColumn("price", F.col("price").cast("string"))
    out = VT.normalize_catalog(old.withColumn("keywords_list", F.when(F.col("category").isNotNull(), F.col("keywords_list"))))
    line = F.transform("reviews", lambda r: F.concat_ws("|", *[F.coalesce(r[c].cast("string"), F.lit("-")) for c in ("author", "review", "rating")]))
    return out.withColumns({"dim": F.when(F.col("embedding").isNotNull(), F.size("embedding")), "reviews": F.array_join(line, ";")}).drop("embedding")
