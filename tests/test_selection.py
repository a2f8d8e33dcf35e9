"""Selection operators: properties that hold on random lists, and small lists worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from nearshelf.functions.text import effective_producer, item_key
from nearshelf.operators import candidates as C, diversify as D

K = 6
CAND = "query_id INT, cand_rank INT, id STRING, score DOUBLE, name STRING, brand STRING"
BASE = "query_id INT, name STRING, brand STRING, embedding_text STRING"
NAMES = ["2015 Red Hill", "2016 Red Hill", "Red hill", "2015 Domaine Blue", "2017 Domaine Blue", "plain", "Old Stone 'Peak'",
         "", "2001", "Ste. Marie Chablis", "The Grand Cru", "2015 Ridge Top", "2016 Ridge Top", None]
BRANDS = ["A", "A", "B", " a ", "N/A", None, "", " ", "Red Hill"]


def random_lists(seed, n):
    rnd = random.Random(seed)
    lists, bases = {}, {}
    for q in range(n):
        size = rnd.choice([0, 1, 3, 8, 30, 90])
        few = rnd.sample(NAMES, rnd.randint(1, len(NAMES)))
        lists[q] = [
            {"id": f"i{i}", "score": 1 - i / 100, "name": rnd.choice(few), "brand": rnd.choice(BRANDS)} for i in range(size)
        ]
        bases[q] = {"name": rnd.choice(NAMES), "brand": rnd.choice(BRANDS), "embedding_text": rnd.choice([None, " ", "Name: x."])}
    return lists, bases


@pytest.fixture(scope="module")
def data(spark):
    lists, bases = random_lists(7, 250)
    cand = spark.createDataFrame(
        [(q, i + 1, c["id"], c["score"], c["name"], c["brand"]) for q, cs in lists.items() for i, c in enumerate(cs)], CAND
    )
    base = spark.createDataFrame([(q, b["name"], b["brand"], b["embedding_text"]) for q, b in bases.items()], BASE)
    return lists, bases, cand.repartition(5).cache(), base.cache()


def by_query(rows, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(value(r))
    return out


@pytest.fixture(scope="module")
def facts(data):
    """(query_id, id) -> rank, key, producer, brand, name; the operators' own inputs as columns."""
    _, _, cand, _ = data
    rows = cand.select("*", item_key(F.coalesce("name", F.lit(""))).alias("key"),
                       effective_producer(F.col("brand"), F.coalesce("name", F.lit(""))).alias("producer")).collect()
    return {(r.query_id, r.id): r for r in rows}


def test_greedy_pick(data, facts):
    _, _, cand, _ = data
    got = by_query(D.diversify(cand, K).collect(), lambda r: r.id)
    for q, ids in got.items():
        picked = [facts[q, i] for i in ids]
        ranks = [r.cand_rank for r in picked]
        assert ranks == sorted(set(ranks)) and ranks[0] == 1 and len(ids) <= K
        early = [r.key for r in picked[: max(2, K // 2)] if r.key]
        assert len(early) == len(set(early))
        brands = [(r.brand or "").strip().lower() for r in picked[: K - 1]]
        assert all(brands.count(b) <= 2 for b in brands if b)
    # A longer list begins like the shorter one while both are under their halves.
    longer = by_query(D.diversify(cand, 2 * K).collect(), lambda r: r.id)
    assert all(longer[q][: K // 2] == ids[: K // 2] for q, ids in got.items())


@pytest.mark.parametrize("k", [1, 2, 6, 60])
def test_whole_selection(data, facts, k):
    lists, bases, cand, base = data
    got = by_query(D.select_diverse(cand, base, k).collect(), lambda r: (r.phase, r.id))
    for q, cs in lists.items():
        own = (bases[q]["name"] or "").strip().lower()
        chosen = got.get(q, [])
        ids = [i for _, i in chosen]
        other = [c for c in cs if not own or (c["name"] or "").strip().lower() != own]
        assert len(ids) == len(set(ids)) == min(k, len(other)) or len(ids) == min(k, len(cs))
        assert [p for p, _ in chosen] == sorted(p for p, _ in chosen)
        strict = [facts[q, i] for p, i in chosen if p == 1]
        keys = [r.key for r in strict if r.key]
        assert len(keys) == len(set(keys))
        if not (bases[q]["embedding_text"] or "").strip():
            made = [r.producer for r in strict if r.producer]
            assert all(made.count(m) <= 2 for m in made)
        filled = [facts[q, i].cand_rank for p, i in chosen if p == 2]
        assert filled == sorted(filled)


def rows_of(*items):
    return [(1, n, i, 1 - n / 100, name, brand) for n, (i, name, brand) in enumerate(items, 1)]


@pytest.mark.parametrize("items,base,want", [
    # The base item and another vintage of it are left to the fill-up, the base itself is never taken.
    ([("a", "2015 Ridge Top", "R"), ("b", "2016 Ridge Top", "R"), ("c", "plain", "P")], ("2015 Ridge Top", "R", None), [(1, "c"), (2, "b")]),
    # One more of the base's producer, two of any other, the rest fills up.
    ([("a", "one", "R"), ("b", "two", "R"), ("c", "three", "S"), ("d", "four", "S")], ("base", "R", None), [(1, "a"), (1, "c"), (1, "d"), (2, "b")]),
    # With a stored profile of the base, producers are not limited.
    ([("a", "one", "R"), ("b", "two", "R"), ("c", "three", "S")], ("base", "R", "Name: base."), [(1, "a"), (1, "b"), (1, "c")]),
])
def test_lists_worked_out_by_hand(spark, items, base, want):
    got = D.select_diverse(spark.createDataFrame(rows_of(*items), CAND), spark.createDataFrame([(1, *base)], BASE), 6)
    assert [(r.phase, r.id) for r in got.orderBy("rank").collect()] == want


def test_split_steps_equal_the_whole(data):
    _, _, cand, base = data
    whole = by_query(D.select_diverse(cand, base, K).collect(), lambda r: (r.phase, r.id))
    picked = D.diversify(cand, K).select("query_id", "rank", "id").join(cand, ["query_id", "id"])
    taken = D.constrain(picked.drop("cand_rank"), base, K)
    steps = C.fill_up(taken, cand, base.select("query_id", F.col("name").alias("base_name")), K)
    assert by_query(steps.collect(), lambda r: (r.phase, r.id)) == whole


def test_rows_without_metadata_take_a_place_and_return_by_fill(spark):
    rows = [(1, 1, "x", 0.9, "2015 Red Hill", "A", False)] + [(1, i, f"y{i}", 0.8, f"n{i}", None, True) for i in (2, 3)]
    cand = spark.createDataFrame(rows, CAND + ", has_metadata BOOLEAN")
    base = spark.createDataFrame([(1, "base", None, None)], BASE)
    got = [(r.phase, r.id) for r in D.select_diverse(cand, base, 2).orderBy("rank").collect()]
    assert got == [(1, "y2"), (2, "x")]


@pytest.mark.parametrize("cap", [1, 2])
def test_cap_per_group(data, facts, cap):
    _, _, cand, _ = data
    keyed = cand.withColumnRenamed("cand_rank", "rank").withColumn(
        "producer", effective_producer(F.col("brand"), F.coalesce("name", F.lit("")))
    )
    got = by_query(C.cap_per_group(keyed, "producer", K, cap).collect(), lambda r: r.id)
    for q, ids in got.items():
        taken = [facts[q, i] for i in ids]
        made = [r.producer for r in taken if r.producer]
        assert all(made.count(m) <= cap for m in made)
        # What was passed over stands behind cap others of its producer.
        last = taken[-1].cand_rank if len(ids) == K else 10**9
        for (p, i), r in facts.items():
            if p == q and i not in ids and r.cand_rank < last:
                assert r.producer and sum(t.producer == r.producer and t.cand_rank < r.cand_rank for t in taken) == cap
    longer = by_query(C.cap_per_group(keyed, "producer", K + 1, cap).collect(), lambda r: r.id)
    assert all(longer[q][: len(ids)] == ids for q, ids in got.items())


def test_merge_keeps_best_score_and_first_sight(spark):
    rows = [(1, 1, 1, "a", 0.5), (1, 1, 2, "b", 0.4), (1, 2, 1, "c", 0.5), (1, 2, 2, "b", 0.5), (1, 3, 1, "a", 0.5), (1, 3, 2, "", 0.9), (1, 3, 3, None, 0.9)]
    matches = spark.createDataFrame(rows, "query_id INT, variant_no INT, rank INT, id STRING, score DOUBLE")
    got = [(r.cand_rank, r.id, r.score) for r in C.merge_candidates(matches).orderBy("cand_rank").collect()]
    assert got == [(1, "a", 0.5), (2, "b", 0.5), (3, "c", 0.5)]


def test_late_candidates_are_found_where_the_first_do_not_fill(spark):
    """600 copies of one item in front: the places left go to candidates far behind the head."""
    rows = [(1, n, f"i{n:04d}", 1.0, "Same" if n <= 600 else f"Other {n}", "B" if n <= 600 else f"B{n}") for n in range(1, 611)]
    cand = spark.createDataFrame(rows, "query_id INT, cand_rank INT, id STRING, score DOUBLE, name STRING, brand STRING")
    base = spark.createDataFrame([(1, "Same", "B", "")], "query_id INT, name STRING, brand STRING, embedding_text STRING")
    picked = [r.cand_rank for r in D.diversify(cand, 6).orderBy("rank").collect()]
    assert picked[:3] == [1, 601, 602] and len(picked) == 6
    got = [(r.phase, r.id) for r in D.select_diverse(cand, base, 6).orderBy("rank").collect()]
    assert len(got) == 6 and all(int(i[1:]) > 600 for _, i in got)
