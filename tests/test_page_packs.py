"""Pages in packs against the same pages as single files."""

import glob
from pathlib import Path

import pytest

from nearshelf.plans import ingest as I
from nearshelf.sources import manifest as M, page_packs as PP, pages as PG
from nearshelf.streaming import ingest as SI
from tests.test_pages import page, product


def write(folder, names, **fields):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / f"{n}.html").write_text(page(product(sku=f"s{n}", **fields)))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "html", range(1, 31))
    (tmp_path / "html" / "40.html").write_bytes(b"\xff\xfe" + "� own mark".encode())
    (tmp_path / "html" / "41.html").write_bytes(b"")  # Spark's readers give no row for a file without a byte.
    (tmp_path / "html" / "7.txt").write_text("other")
    (tmp_path / "html" / "blank [1].html").write_text("x" * 300_000)
    return tmp_path / "html"


def rows(df):
    return sorted(tuple(r) for r in df.select("path", "file_name", "html").collect())


def test_packs_hold_what_the_files_hold(spark, folder, tmp_path):
    packs = str(tmp_path / "packs")
    assert PP.packed_files(spark, packs).count() == 0
    assert PP.pack_pages(spark, str(folder), packs) == 32
    assert rows(PP.read_packed(spark, packs)) == rows(PG.read_pages(spark, str(folder)))
    # Nothing is new; then two pages are, a changed one is not.
    assert PP.pack_pages(spark, str(folder), packs) == 0
    before = rows(PP.read_packed(spark, packs))
    write(folder, [1, 50, 51], name="later")
    assert PP.pack_pages(spark, str(folder), packs) == 2
    after = rows(PP.read_packed(spark, packs))
    assert len(after) == 34 and set(before) < set(after)


@pytest.mark.parametrize("limit", [0, 100])
def test_new_paths_either_way(spark, folder, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(PP, "BROADCAST_PATHS", limit)
    packs = str(tmp_path / "packs")
    PP.pack_pages(spark, str(folder), packs, glob="1*.html")
    PP.pack_pages(spark, str(folder), packs)
    assert rows(PP.read_packed(spark, packs)) == rows(PG.read_pages(spark, str(folder)))


def test_packs_are_bounded(spark, folder, tmp_path):
    PP.pack_pages(spark, str(folder), str(tmp_path / "few"))
    PP.pack_pages(spark, str(folder), str(tmp_path / "pages"), pack_pages=5)
    PP.pack_pages(spark, str(folder), str(tmp_path / "bytes"), pack_bytes=100_000)
    files = {n: glob.glob(str(tmp_path / n / "*.parquet")) for n in ("few", "pages", "bytes")}
    assert len(files["few"]) == 1 and len(files["pages"]) >= 7 and len(files["bytes"]) > 1
    assert max(spark.read.parquet(f).count() for f in files["pages"]) <= 5
    paths = [r.path for r in spark.read.parquet(files["few"][0]).collect()]
    assert paths == sorted(paths)


def test_new_paths_are_held_once_per_pack(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder))
    paths = files.where("length > 10").select("path")
    assert files.rdd.getNumPartitions() > 2
    plan = PP.to_pack(files, paths, 32, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Repartition 2, false")
    assert sorted(r.path for r in PP.to_pack(files, paths, 32, 2).collect()) == sorted(r.path for r in paths.collect())


def test_no_body_is_read_for_paths(spark, folder, tmp_path):
    packs = str(tmp_path / "packs")
    PP.pack_pages(spark, str(folder), packs)
    plan = PP.read_packed(spark, packs).where("path <= 'm'").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "LessThanOrEqual(path,m)" in plan


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert PP.pack_pages(spark, str(tmp_path / "none"), str(tmp_path / "packs")) == 0
    assert PP.read_packed(spark, str(tmp_path / "packs")).count() == 0


def test_ingest_resumes_within_a_pack(spark, folder, tmp_path):
    packs, manifest = str(tmp_path / "packs"), str(tmp_path / "manifest")
    PP.pack_pages(spark, str(folder), packs)

    def run(n, limit):
        counts = I.run_ingest(
            PP.read_packed(spark, packs), M.read_manifest(spark, manifest), id_prefix="shop:", source="shop", limit=limit,
            stage_path=str(tmp_path / f"stage{n}"), records_path=str(tmp_path / "records"), manifest_path=manifest)
        return sum(r.pages for r in counts.collect())

    assert [run(1, 10), run(2, 25), run(3, 0), run(4, 0)] == [10, 15, 7, 0]
    assert len(glob.glob(packs + "/*.parquet")) == 1


def test_stream_takes_every_pack_once(spark, folder, tmp_path):
    packs, out = str(tmp_path / "packs"), str(tmp_path / "out")

    def run():
        SI.stream_ingest(PP.stream_packed(spark, packs, max_packs=2), out=out, checkpoint=str(tmp_path / "cp"),
                         id_prefix="shop:", source="shop").awaitTermination()
        batches = {r.batch_no: r["count"] for r in spark.read.parquet(out + "/pages").groupBy("batch_no").count().collect()}
        return SI.current_records(spark, out).count(), batches

    PP.pack_pages(spark, str(folder), packs, pack_pages=10)
    found, batches = run()
    assert found == 30 and sum(batches.values()) == 32 and len(batches) == 2
    assert run() == (found, batches)
    write(folder, [60])
    PP.pack_pages(spark, str(folder), packs)
    again, more = run()
    assert again == 31 and {b: n for b, n in more.items() if b not in batches} == {max(batches) + 1: 1}


def test_single_files_are_written_without_a_process_for_each(spark, tmp_path):
    from checks.pages import _single_files

    pages = [(1, "one"), (2, "two"), (2, "two again"), (3, None), (10, "zehn ü"), (None, "nobody")]
    spark.createDataFrame(pages, "page_id BIGINT, html STRING").write.parquet(str(tmp_path / "pages.parquet"))
    folder = Path(_single_files(spark, str(tmp_path))).parent
    found = {f.parent.name.split("=")[1]: sorted(f.read_text().splitlines()) for f in folder.rglob("*") if f.is_file() and f.name != "_SUCCESS"}
    assert found == {"1": ["one"], "2": ["two", "two again"], "3": [""], "10": ["zehn ü"], "__HIVE_DEFAULT_PARTITION__": ["nobody"]}
    # Hadoop's checksum files, one more file for each page, are not there.
    assert not list(folder.rglob("*.crc"))
