"""Extraction and ingest on edge pages, files and streams."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from nearshelf.functions.text import item_key
from nearshelf.operators import extract as E, profile as R
from nearshelf.plans import ingest as I
from nearshelf.schema import MANIFEST
from nearshelf.sources import manifest as M, pages as PG, records as RC, vector_table as VT
from nearshelf.streaming import ingest as SI


def page(*blocks, head=""):
    return head + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def product(**fields):
    return json.dumps({"@type": "Product", "sku": "1", "name": "N", "category": "Wine - Red", **fields})


def records(spark, *htmls):
    rows = spark.createDataFrame([(f"/p/{i:02d}.html", h) for i, h in enumerate(htmls)], "path STRING, html STRING")
    return [r.asDict(recursive=True) for r in E.classify_pages(rows).orderBy("path").collect()]


def test_which_object_is_the_product(spark):
    got = records(
        spark, "", page("{}"), page("null"), page("nope", product(sku="2")), page(json.dumps([{"@type": "x"}, json.loads(product(sku="3"))])),
        page(product(sku="4"), product(sku="5")), page('{"@type":["Product"],"sku":"6","name":"x"}'),
        page(json.dumps([[json.loads(product(sku="7"))]])), page('{"@graph":[' + product() + "]}"),
        "<script type='application/ld+json'>" + product() + "</script>", '<SCRIPT x TYPE="APPLICATION/LD+JSON"\n>\n' + product(sku="8") + "</SCRIPT>",
        page(product(sku=9)), page(product(sku=" ")), page(product(name=None)), page('"Product"', "5", product(sku="10")),
    )
    assert [r["sku"] if r["status"] != "skip_parse" else None for r in got] == [
        None, None, None, "2", "3", "4", None, None, None, None, "8", None, None, None, "10"]


@pytest.mark.parametrize("category,status", [(None, "skip_not_wine"), ("Beer", "skip_not_wine"), ("Wine / Spirits", "skip_not_wine"),
                                             ("Virginia Wine", "skip_not_wine"), ("WINE", "ok"), (" Old  Rare /\tWine ", "ok")])
def test_status(spark, category, status):
    (got,) = records(spark, page(product(category=category)))
    assert got["status"] == status
    assert got["category"] == (" ".join(category.split()) if category else None)


def test_polymorphic_fields(spark):
    got = records(
        spark, page(product(countryOfOrigin="  France ", offers=[{"price": "12.5", "availability": "In"}])),
        page(product(countryOfOrigin={"name": "Italy"}, offers={"price": 3})), page(product(countryOfOrigin={"x": 1}, offers=[])),
        page(product(countryOfOrigin=["a"], offers=[3, {"price": 4}])), page(product(offers=[{"price": "$12"}])),
        page(product(offers=[{"price": None}], aggregateRating={"b": 1, "a": [2]})), page(product(offers=[{"price": True}], aggregateRating="x", size=5)),
    )
    assert [r["country"] for r in got[:4]] == ["France", "Italy", None, None]
    assert [r["price"] for r in got] == [12.5, None, None, None, None, None, 1.0]
    assert got[0]["availability"] == "In" and got[6]["size"] is None
    assert [r["aggregate_rating"] and json.loads(r["aggregate_rating"]) for r in got[5:]] == [{"b": 1, "a": [2]}, None]


def test_reviews(spark):
    reviews = [{"author": {"name": "A"}, "reviewBody": " x\n y ", "reviewRating": {"ratingValue": "92", "bestRating": 100}}, "text",
               {"author": 5, "reviewRating": {"ratingValue": 0}}, {"author": "nobody"}, {"reviewBody": "z" * 300, "reviewRating": 7},
               {"reviewBody": "fourth"}]
    rows = spark.createDataFrame([("p", page(product(review=reviews))), ("q", page(product(review={"reviewBody": "x"})))], "path STRING, html STRING")
    found = E.extract_products(rows).orderBy("path").cache()
    first = found.first().asDict(recursive=True)["reviews"]
    assert [(r["author"], r["review"], r["rating"], r["best_rating"]) for r in first] == [
        ("A", "x\n y", 92.0, 100.0), (None, None, 0.0, None), (None, "z" * 300, None, None), (None, "fourth", None, None)]
    flat = [r.reviews for r in R.flatten_metadata(found).orderBy("path").collect()]
    assert flat == [["A (92.0): x\n y", "Critic rating: 0.0", "Critic: " + "z" * 240 + "…"], None]
    text = R.with_profile_text(found).orderBy("path").first().profile_text
    assert text == "Name: N.\nCategory: Wine - Red.\nCritic (A) 92.0: x y"


def test_og_url(spark):
    tag = '<meta property="og:url" content="%s">'
    got = records(spark, tag % "u1" + page(product()), (tag % "").upper() + page(product()), page(product(), head="<META\n property=\"OG:URL\"\tcontent=\"b c\""))
    assert [r["source_url"] for r in got] == ["u1", None, "b c"]


def test_repeated_keys_and_nan_are_read(spark):
    def one(body):
        return records(spark, page(body))[0]

    assert one('{"@type":"Product","sku":"1","sku":"2","name":"n"}')["sku"] == "2"
    got = one('{"@type":"Product","sku":"1","name":"n","weight":NaN,"offers":[{"price":3}],"category":"Red Wine"}')
    assert (got["status"], got["price"]) == ("ok", 3.0)
    listed = one('[{"@type":"Other"},{"@type":"Product","name":"a","name":"b","sku":"s"}]')
    assert (listed["sku"], listed["name"]) == ("s", "b")
    assert one('{"@type":"Product","sku":"1",')["status"] == "skip_parse"


def test_own_replacement_marks_stay(spark):
    from nearshelf.sources.pages import decode_text

    mark = "\ufffd".encode()
    rows = spark.createDataFrame([(b"a" + mark + b"b",), (b"a\xff" + mark + b"\xfeb",), (b"\xff",)], "c BINARY")
    assert [r.t for r in rows.select(decode_text(F.col("c")).alias("t")).collect()] == ["a\ufffdb", "a\ufffdb", ""]


def test_the_last_page_of_a_key_wins_in_any_order(spark):
    from nearshelf.sources.vector_table import latest_by_key

    rows = [("k", 1, "a"), ("k", 1, "b"), ("k", 0, "z")]
    got = {tuple(latest_by_key(spark.createDataFrame(r, "id STRING, batch_no INT, x STRING").coalesce(1), "id", "batch_no").first()) for r in (rows, rows[::-1])}
    assert len(got) == 1


def test_pages_are_parsed_once(spark):
    rows = spark.createDataFrame([("p", page(product()))], "path STRING, html STRING")
    plan = E.classify_pages(rows).where("status = 'ok'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "html"
    src.mkdir()
    (src / "12.html").write_bytes(b"\xff" + page(product(sku="a")).encode())
    (src / "3.html").write_text(page(product(sku="b", category="Rum")))
    (src / "x.html").write_text("nothing")
    (src / "7.txt").write_text(page(product(sku="c")))
    return src


def test_read_pages(spark, folder):
    pages = PG.read_pages(spark, str(folder)).cache()
    assert sorted(r.file_name for r in pages.collect()) == ["12.html", "3.html", "x.html"]
    assert pages.where("file_name = '12.html'").first().html.startswith("<script")
    assert sorted(r.id for r in PG.page_vector_ids(pages).collect()) == ["wine_12", "wine_3"]
    assert [r.file_name for r in PG.first_pages(pages, 1).collect()] == ["12.html"]
    assert PG.first_pages(pages, 0).count() == 3


def ingest(spark, folder, tmp_path, n, limit=0):
    counts = I.run_ingest(
        PG.read_pages(spark, str(folder)), M.read_manifest(spark, str(tmp_path / "manifest")), id_prefix="shop:", source="shop",
        stage_path=str(tmp_path / f"stage{n}"), records_path=str(tmp_path / "records"), manifest_path=str(tmp_path / "manifest"), limit=limit,
    )
    return {r.status: r.pages for r in counts.collect()}


def test_ingest_resumes(spark, folder, tmp_path):
    assert ingest(spark, folder, tmp_path, 1, limit=1) == {"ok": 1}
    assert ingest(spark, folder, tmp_path, 2, limit=1) == {}
    assert ingest(spark, folder, tmp_path, 3) == {"skip_not_wine": 1, "skip_parse": 1}
    assert ingest(spark, folder, tmp_path, 4) == {}
    lines = [json.loads(line) for f in (tmp_path / "records").glob("*.json") for line in f.read_text().splitlines()]
    assert lines == [{"sku": "a", "name": "N", "category": "Wine - Red", "source": "shop", "embedding_text": "Name: N.\nCategory: Wine - Red."}]
    skus = {(r.status, r.sku) for r in M.read_manifest(spark, str(tmp_path / "manifest")).collect()}
    assert skus == {("ok", None), ("skip_not_wine", "b"), ("skip_parse", None)}


def test_lines_of_a_repeated_run_are_read_once(spark, folder, tmp_path):
    manifest, records = str(tmp_path / "manifest"), str(tmp_path / "records")

    def run(n, manifest_path=manifest, limit=0):
        return {r.status: r.pages for r in I.run_ingest(
            PG.read_pages(spark, str(folder)), M.read_manifest(spark, manifest), id_prefix="shop:", source="shop", stage_path=str(tmp_path / f"stage{n}"),
            records_path=records, manifest_path=manifest_path, limit=limit, by_run=True).collect()}

    def lines():
        return sorted(r.sku for r in RC.read_runs(spark, records, T.StructType.fromDDL("sku STRING, name STRING"), M.read_manifest(spark, manifest)).collect())

    assert run(1, manifest_path=str(tmp_path / "lost")) == {"ok": 1, "skip_not_wine": 1, "skip_parse": 1}
    assert lines() == []
    assert run(2, limit=1) == {"ok": 1}
    assert lines() == ["a"]
    (folder / "99.html").write_text(page(product(sku="z")))
    assert run(3, manifest_path=str(tmp_path / "lost")) == {"ok": 1, "skip_not_wine": 1, "skip_parse": 1}
    assert lines() == ["a"]
    assert run(4) == {"ok": 1, "skip_not_wine": 1, "skip_parse": 1}
    assert run(5) == {}
    assert lines() == ["a", "z"]


def test_many_first_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(f"/p/{i % 40:02d}", str(i)) for i in range(60)] + [(None, "x")], "path STRING, html STRING").repartition(7)
    found = lambda: {n: sorted(r.html for r in PG.first_pages(pages, n).collect()) for n in (1, 20, 41, 59, 60, 100)}
    sorted_whole = found()
    monkeypatch.setattr(PG, "SORTED_PATHS", 0)
    assert found() == sorted_whole
    assert PG.first_pages(pages, 20).count() == 20 and PG.first_pages(pages, 1).count() == 2
    assert PG.first_pages(pages, 60).count() == 60 and PG.first_pages(pages, 100).count() == 60
    assert PG.first_pages(pages.limit(0), 5).count() == 0


def test_long_manifest_takes_the_other_way(spark, monkeypatch):
    pages = spark.createDataFrame([(f"/p/{i}", "") for i in range(20)], "path STRING, html STRING")
    done = pages.where("path < '/p/15'").select(E.page_key(F.col("path")).alias("key"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("sku"))
    short = {r.path for r in I.pages_to_do(pages, done).collect()}
    monkeypatch.setattr(I, "BROADCAST_KEYS", 2)
    assert {r.path for r in I.pages_to_do(pages, done).collect()} == short and len(short) == 13


def test_checkpoint_file(spark, tmp_path):
    good, bad = tmp_path / "c.json", tmp_path / "d.json"
    good.write_text(json.dumps({"done": {"k1": {"status": "ok"}, "k2": {"status": "skip_not_wine", "sku": "s"}}}, indent=2))
    bad.write_text("{broken")
    rows = sorted(tuple(r) for r in M.read_checkpoint_json(spark, str(good)).collect())
    assert rows == [("k1", "ok", None), ("k2", "skip_not_wine", "s")]
    assert M.read_checkpoint_json(spark, str(bad)).count() == 0
    assert M.read_checkpoint_json(spark, str(tmp_path / "none.json")).count() == 0
    assert M.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_stream_picks_up_new_files_once(spark, folder, tmp_path):
    def run():
        SI.stream_ingest(SI.stream_pages(spark, str(folder)), out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"),
                         id_prefix="shop:", source="shop").awaitTermination()
        return sorted((r.id, r.name) for r in SI.current_records(spark, str(tmp_path / "out")).collect())

    assert run() == [("shop:a", "N")]
    assert run() == [("shop:a", "N")]
    (folder / "99.html").write_text(page(product(sku="a", name="newer")))
    assert run() == [("shop:a", "newer")]
    assert SI.stream_manifest(spark, str(tmp_path / "out")).count() == 4


def test_upsert_replaces_and_is_idempotent(spark):
    table = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "id STRING, batch_no INT, x DOUBLE")
    batch = spark.createDataFrame([("b", 1, 3.0), ("b", 2, 4.0), ("c", 1, 5.0)], table.schema)
    once = VT.upsert_latest(table, batch)
    want = [("a", 0, 1.0), ("b", 2, 4.0), ("c", 1, 5.0)]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in VT.upsert_latest(once, batch).collect()) == want


@pytest.mark.parametrize("ddl,row,want", [
    ("name STRING, country_of_origin STRING, reviews_json STRING, keywords_list ARRAY<STRING>",
     ("n", "F", '[{"author":"A","rating":9.5}]', ["a", "b"]), ("F", "a,b", "A", 9.5)),
    ("name STRING, country STRING, reviews ARRAY<STRING>, keywords STRING", ("n", "F", ["A: x"], "k"), ("F", "k", None, None)),
    ("name STRING, country STRING, reviews STRING, keywords STRING", ("n", "F", '[{"author":"B","rating":3}]', "k"), ("F", "k", "B", 3.0)),
])
def test_older_catalogs(spark, ddl, row, want):
    out = VT.normalize_catalog(spark.createDataFrame([row], ddl)).first()
    assert (out.country, out.keywords, out.reviews[0].author, out.reviews[0].rating) == want
