"""Vector search against numpy, both ways of running it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearshelf.functions import blocks as B
from nearshelf.functions.vectors import cosine
from nearshelf.operators import search as S
from nearshelf.operators.candidates import first_per_key, merge_candidates
from nearshelf.operators.cells import cosine_topk_cells, write_cells
from nearshelf.operators.diversify import diversify, select_diverse

DIM = 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, DIM)).round(1).astype(np.float32)
    vectors[300:530] = vectors[300]          # a third of all rows are copies
    vectors[10] = 0
    prices = [None if i % 9 == 0 else float(i % 50) for i in range(700)]
    rows = [(f"i{i:03d}", [float(x) for x in v], prices[i], f"n{i}") for i, v in enumerate(vectors)]
    rows.append(("short", [1.0] * 3, 1.0, "s"))
    catalog = spark.createDataFrame(rows, "id STRING, embedding ARRAY<FLOAT>, price DOUBLE, name STRING").repartition(7).cache()
    q = [(i, i % 2 + 1, [float(x) for x in vectors[i]], float(i % 3 * 10), 999999.0 if i % 4 else 30.0) for i in range(0, 700, 5)]
    queries = spark.createDataFrame(q, "query_id INT, variant_no INT, vector ARRAY<FLOAT>, price_min DOUBLE, price_max DOUBLE").cache()
    return vectors, prices, q, catalog, queries


def brute_force(vectors, prices, q, k):
    v = vectors.astype(np.float64)
    out = set()
    for query_id, variant, vector, low, high in q:
        x = np.array(vector, np.float64)
        if not x.any():
            continue
        hits = []
        for i, row in enumerate(v):
            p = prices[i]
            if not row.any() or (low > 0 and (p is None or p < low)) or (high < 999999 and (p is None or p > high)):
                continue
            hits.append((-round(float(row @ x / np.linalg.norm(row) / np.linalg.norm(x)), 6), f"i{i:03d}"))
        out |= {(query_id, variant, r + 1, i) for r, (_, i) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("options", [dict(), dict(method="blocks"), dict(method="blocks", block_bytes=40 * 8 * DIM),
                                     dict(method="blocks", block_bytes=5 * 8 * DIM), dict(broadcast_bytes=4_000),
                                     dict(method="chunks"), dict(method="chunks", broadcast_bytes=6_000, seed_share=8)])
def test_equals_brute_force(data, options):
    vectors, prices, q, catalog, queries = data
    got = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=6, payload=("name",), **options).collect()
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)
    assert all(r.name == "n" + str(int(r.id[1:])) for r in got)


def test_many_batches_per_task(spark, data):
    vectors, prices, q, catalog, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = S.cosine_topk(queries, catalog.coalesce(1), 4, dim=DIM, digits=6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 4)


def test_wide_clusters_cut_in_two_steps(spark, data):
    vectors, prices, q, catalog, queries = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=6).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)


def test_broadcast_refuses_too_many_queries(data):
    *_, catalog, queries = data
    with pytest.raises(ValueError):
        S.cosine_topk(queries, catalog, 9, dim=DIM, method="broadcast", broadcast_bytes=1)


def test_no_queries_no_rows(data):
    *_, catalog, queries = data
    assert S.cosine_topk(queries.where("query_id < 0"), catalog, 9, dim=DIM).count() == 0
    assert S.cosine_topk(queries, catalog.where("price < 0"), 9, dim=DIM, method="blocks").count() == 0


def test_narrower_prices_only_remove_rows(data):
    *_, catalog, queries = data
    ids = lambda low: {(r.query_id, r.id) for r in S.cosine_topk(
        queries.withColumn("price_min", F.lit(low)).withColumn("price_max", F.lit(40.0)), catalog, 1000, dim=DIM).collect()}
    assert ids(20.0) < ids(5.0)


def test_shared_price_bounds_reach_the_scan(spark, data, tmp_path):
    *_, catalog, queries = data
    catalog.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = S.cosine_topk(queries.withColumn("price_min", F.lit(7.0)), stored, 3, dim=DIM)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(price,7.0)" in plan
    assert "name" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_plan_has_one_exchange_and_no_product_join(data):
    *_, catalog, queries = data
    plan = S.cosine_topk(queries, catalog, 3, dim=DIM)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pair_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = [r.c for r in rows.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2 ** -0.5) and got[1] is None


def test_bounds_off_when_unreadable(spark):
    rows = spark.createDataFrame([("5", "x"), (None, "7"), ("5", "7")], "price_min STRING, price_max STRING")
    assert [tuple(r) for r in S.price_bounds(rows).collect()] == [(0.0, 999999.0), (0.0, 999999.0), (5.0, 7.0)]


def test_post_filter_prices(spark):
    rows = spark.createDataFrame([("5",), ("x",), (None,), ("10",)], "price STRING")
    keep = lambda **o: [r.price for r in S.price_between(rows, 0, 10, **o).collect()]
    assert keep() == ["5", None, "10"] and keep(missing_price_as_zero=False) == ["5", "10"]


@pytest.mark.parametrize("method", ["broadcast", "blocks"])
def test_nan_bounds_are_off_whatever_the_order(spark, method):
    catalog = spark.createDataFrame([(f"i{k}", float(k), [1.0, k / 10]) for k in range(10)], "id STRING, price DOUBLE, embedding ARRAY<FLOAT>")
    asked = [(1, [1.0, 0.0], 5.0, 999999.0), (2, [1.0, 0.0], float("nan"), float("nan")), (3, [1.0, 0.0], float("nan"), 3.0)]
    for rows in (asked, asked[::-1]):
        q = spark.createDataFrame(rows, "query_id INT, vector ARRAY<FLOAT>, price_min DOUBLE, price_max DOUBLE").coalesce(1)
        got = S.cosine_topk(q, catalog, 20, dim=2, method=method).groupBy("query_id").count().collect()
        assert {r["query_id"]: r["count"] for r in got} == {1: 5, 2: 10, 3: 4}


@pytest.fixture(scope="module")
def stored(data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "t")
    write_cells(data[3], path, dim=DIM, cells=12)
    return path


@pytest.mark.parametrize("options", [dict(), dict(broadcast_bytes=5_000)])
def test_cells_equal_brute_force(data, stored, options):
    vectors, prices, q, catalog, queries = data
    got = cosine_topk_cells(queries, stored, catalog.schema, 9, dim=DIM, digits=6, payload=("name",), **options).collect()
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)
    assert all(r.name == "n" + str(int(r.id[1:])) for r in got)


def test_cells_hold_every_usable_row_within_their_radius(spark, data, stored):
    cells = {r.cell: r for r in spark.read.parquet(stored + "/cells").collect()}
    rows = spark.read.parquet(stored + "/rows").collect()
    assert len(rows) == 699 and 2 <= len(cells) <= 12
    for r in rows:
        v, c = np.array(r.embedding), np.array(cells[r.cell].centre)
        assert np.arccos(np.clip(v @ c / np.linalg.norm(v), -1, 1)) <= cells[r.cell].radius + 1e-9
    assert sum(c.n for c in cells.values()) == 699


def test_distant_cells_are_not_read(spark, tmp_path):
    """Two tight groups far from each other: a search near one succeeds though the other's files are unreadable."""
    rng = np.random.default_rng(5)
    near = [[1.0] + list(x) for x in rng.normal(scale=0.01, size=(60, DIM - 1))]
    far = [[-1.0] + list(x) for x in rng.normal(scale=0.01, size=(60, DIM - 1))]
    rows = [(f"i{k}", [float(x) for x in v], 1.0) for k, v in enumerate(near + far)]
    catalog = spark.createDataFrame(rows, "id STRING, embedding ARRAY<FLOAT>, price DOUBLE")
    path = str(tmp_path / "t")
    write_cells(catalog, path, dim=DIM, cells=2)
    cell = spark.read.parquet(path + "/rows").where("id = 'i100'").first().cell
    for name in (tmp_path / "t" / "rows" / f"cell={cell}").glob("part-*"):
        name.write_bytes(b"no parquet")
    queries = spark.createDataFrame([(1, [1.0] + [0.0] * (DIM - 1))], "query_id INT, vector ARRAY<FLOAT>")
    got = cosine_topk_cells(queries, path, catalog.schema, 5, dim=DIM).collect()
    assert len(got) == 5 and all(int(r.id[1:]) < 60 for r in got)
    away = queries.select("query_id", F.transform("vector", lambda x: -x).alias("vector"))
    with pytest.raises(Exception, match="parquet|Parquet"):
        cosine_topk_cells(away, path, catalog.schema, 5, dim=DIM).collect()


def test_cells_of_an_empty_table(spark, data, tmp_path):
    *_, catalog, queries = data
    path = str(tmp_path / "t")
    write_cells(catalog.where("id IS NULL"), path, dim=DIM)
    assert cosine_topk_cells(queries, path, catalog.schema, 5, dim=DIM).count() == 0


def test_chunks_move_no_vectors(data):
    *_, catalog, queries = data
    plan = S.cosine_topk(queries, catalog, 3, dim=DIM, method="chunks", payload=("name",))._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.split("\n") if "Project" in line or "Relation" in line or "Filter" in line]
    assert "vector" not in plan and not any("embedding" in line for line in joined if "Project" in line)


@pytest.mark.parametrize("options", [dict(), dict(broadcast_bytes=30_000), dict(broadcast_bytes=12_000)])
def test_queries_that_stay(data, options):
    vectors, prices, q, catalog, queries = data
    got = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=6, payload=("name",), method="passes", **options).collect()
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)
    assert all(r.name == "n" + str(int(r.id[1:])) for r in got)


def test_a_query_with_its_matches_in_later_chunks_is_searched_again(data, monkeypatch):
    vectors, prices, q, catalog, queries = data
    monkeypatch.setattr(S.blocks, "guessed_rank", lambda k, share: 1)
    got = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=6, method="passes", broadcast_bytes=20_000).collect()
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)


def test_equal_keys_share_their_places(data):
    *_, catalog, queries = data
    twice = queries.withColumn("query_id", F.col("query_id") % 50)
    want, *others = [sorted((r.query_id, r.variant_no, r.rank, r.id, r.score) for r in S.cosine_topk(twice, catalog, 9, dim=DIM, digits=6, **o).collect())
                     for o in (dict(), dict(method="passes"), dict(method="passes", broadcast_bytes=20_000))]
    assert all(o == want for o in others)


def test_many_queries_hold_few_hits(data, monkeypatch):
    """A query's hits leave one task where the catalog fits into one chunk, and queries that travel are bounded by their hits."""
    *_, catalog, queries = data
    monkeypatch.setattr(S, "HELD_HITS", 300)
    seen = []
    monkeypatch.setattr(S, "_final_rank", lambda hits, k, payload, real=S._final_rank: (seen.append(hits.count()), real(hits, k, payload))[1])
    got = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=6)
    assert seen == [got.count()]


def test_small_blocks_do_not_multiply_the_other_side():
    assert S._blocks_of(100, DIM, 8 * DIM * 25) == 4
    assert S._blocks_of(100_000, DIM, 8 * DIM) == S.BLOCKS
    assert S._blocks_of(100 * S.BLOCK_BYTES // (8 * DIM), DIM, 8 * DIM) == 100


@pytest.mark.parametrize("many", [dict(method="passes"), dict(method="passes", broadcast_bytes=20_000), dict(broadcast_bytes=9_000)])
def test_derived_sides_are_computed_once(spark, data, monkeypatch, many):
    """No row of either side is derived a second time, whatever the number of chunks."""
    vectors, prices, q, catalog, queries = data
    monkeypatch.setattr(S, "HELD_HITS", 300)
    asked, searched = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(into):
        def run(batches):
            for batch in batches:
                into.add(batch.num_rows)
                yield batch
        return run

    got = S.cosine_topk(queries.mapInArrow(counted(asked), queries.schema), catalog.mapInArrow(counted(searched), catalog.schema), 9, dim=DIM, digits=6, **many)
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got.collect()} == brute_force(vectors, prices, q, 9)
    assert searched.value == catalog.count()
    assert asked.value == queries.count()


def test_a_block_holds_its_vectors_once():
    vectors = np.random.default_rng(5).normal(size=(500, DIM)).astype(np.float32)
    table = pa.table({"id": [f"i{n:03d}" for n in range(500)], "price": np.ones(500), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    block = B.catalog_block(table, DIM, [])
    flat = table.column("embedding").chunk(0).flatten().to_numpy()
    assert np.shares_memory(block.rows, flat)
    wide = vectors.astype(np.float64)
    assert (block.vectors(np.arange(500)) == wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]).all()


def test_first_bar_by_groups_loses_no_row():
    """Rows of one group of neighbours are the best ones; a vector of no number and prices are among them."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(9_001, DIM)).astype(np.float32)
    vectors[64:96] = vectors[64] + rng.normal(size=(32, DIM)) / 50
    vectors[70] = np.nan
    table = pa.table({"id": [f"i{n:05d}" for n in range(9_001)], "price": np.arange(9_001) % 7.0, "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for low in (0.0, 3.0):
        asked = pa.table({"query_id": [1, 2], "vector": pa.array([vectors[64], vectors[500]], pa.list_(pa.float32())),
                          "price_min": [low, low], "price_max": [999999.0] * 2, "floor": [-np.inf] * 2})
        q = B.query_block(asked, ["query_id"], DIM, (0.0, 999999.0))
        rows, cols, _ = B.best_rows(q, B.catalog_block(table, DIM, []), 20, 6)
        for n, of in enumerate((64, 500)):
            scores = np.round(unit.astype(np.float64) @ unit[of], 6)
            scores[np.isnan(scores) | (np.arange(9_001) % 7 < low)] = -np.inf
            assert np.allclose(scores[cols[rows == n]], np.sort(scores)[::-1][:20], atol=2e-6)


def test_chunks_read_a_kept_catalog(spark, data):
    """What derives the catalog runs once, however many chunks of queries ask."""
    vectors, prices, q, catalog, queries = data
    seen = spark.sparkContext.accumulator(0)

    def derive(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    derived = catalog.select("id", "embedding", "price").mapInArrow(derive, "id STRING, embedding ARRAY<FLOAT>, price DOUBLE")
    got = S.cosine_topk(queries, derived, 9, dim=DIM, digits=6, method="chunks", broadcast_bytes=6_000, seed_share=8).collect()
    assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)
    assert seen.value == 701


@pytest.mark.parametrize("digits", [6, None])
def test_hits_of_queries_that_stay_are_exchanged_once_and_narrow(spark, data, digits):
    """Their places and scores go to the query's task as lists; merging and choosing exchange nothing more."""
    vectors, prices, q, catalog, queries = data
    payload = ("name", "price")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        found = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=digits, payload=payload, method="passes", broadcast_bytes=12_000)
        merged = merge_candidates(found, payload)
        plan = merged._jdf.queryExecution().executedPlan().toString().split("\n")
        rows = found.collect()
        assert len(merged.collect()) == len({(r.query_id, r.id) for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    exchanged = [n for n, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 1 and "MapInArrow" in plan[exchanged[0] + 1] + plan[exchanged[0] + 2]
    assert not any("name" in line for line in plan[exchanged[0]:exchanged[0] + 3])
    if digits:
        assert {(r.query_id, r.variant_no, r.rank, r.id) for r in rows} == brute_force(vectors, prices, q, 9)
    assert all((r.name, r.price) == ("n" + str(int(r.id[1:])), prices[int(r.id[1:])]) for r in rows)


def test_more_chunks_than_travel_at_once(spark, data, monkeypatch):
    """A search in several passes, whose first ones set the bars."""
    vectors, prices, q, catalog, queries = data
    monkeypatch.setattr(S, "CHUNKS_AT_ONCE", 2)
    for digits, rank in ((6, None), (None, None), (6, 1)):
        if rank:
            monkeypatch.setattr(S.blocks, "guessed_rank", lambda k, share: rank)
        monkeypatch.setattr(S, "PAYLOAD_BYTES", 1 << 20 if rank else 0)
        got = S.cosine_topk(queries, catalog, 9, dim=DIM, digits=digits, payload=("name",), method="passes", broadcast_bytes=6_000).collect()
        if digits:
            assert {(r.query_id, r.variant_no, r.rank, r.id) for r in got} == brute_force(vectors, prices, q, 9)
        assert all(r.name == "n" + str(int(r.id[1:])) for r in got)
        assert len(got) == len(brute_force(vectors, prices, q, 9))


@pytest.mark.parametrize("after", [lambda c, base: first_per_key(c, base), lambda c, base: diversify(c, 6),
                                   lambda c, base: select_diverse(c, base.select("query_id", F.col("base_name").alias("name"), F.lit("b").alias("brand")), 6)])
def test_candidates_are_chosen_where_their_hits_arrive(spark, data, after):
    """Hits travel once on a wide cluster too, and no column of their items with them."""
    *_, catalog, queries = data
    payload = ("name", "brand", "item_key")
    named = catalog.withColumns({"brand": F.lit("b"), "item_key": F.col("name")})
    base = spark.createDataFrame([(n, "x", "y") for n in range(5)], "query_id INT, base_name STRING, base_key STRING").hint("broadcast")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        found = S.cosine_topk(queries, named, 9, dim=DIM, digits=6, payload=payload, method="passes")
        plan = after(merge_candidates(found, payload), base)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    exchanged = [n for n, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 1
    assert not any("name" in line for line in plan[exchanged[0]:exchanged[0] + 3])
