"""Mixing, the pipeline and the registered queries."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from checks.compare import _plain, _rows, connect
from nearshelf.llm.encoding import Encoder
from nearshelf.llm.mixing import fit_rates, mix_sources
from nearshelf.llm.queries import ORACLES, QUERIES
from tests.llm.edges import edge_docs, edge_rows, empty_docs, plain, prose


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(rel.columns, rel.fetchall())
    assert _plain(None) is None


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def plain_rates(rows, weights, whole=None):
    """Projected gradient in plain Python."""
    total = sum(t for t, _ in rows)
    sizes = [sum(t * p[k] for t, p in rows) for k in range(len(weights))]
    tokens = max(total, sizes[whole] / weights[whole]) if whole is not None else total
    free = [weights[p.index(max(p))] > 0 for _, p in rows]
    rate = [1.0 if f else 0.0 for f in free]
    for _ in range(400):
        gap = [(sum(t * p[k] * r for (t, p), r in zip(rows, rate)) - weights[k] * tokens) * (weights[k] > 0) for k in range(len(weights))]
        if max(map(abs, gap)) <= 1e-4 * total:
            break
        rate = [max(0.0, r - sum(p[k] * gap[k] / sizes[k] for k in range(len(weights)))) if f else 0.0 for r, (_, p), f in zip(rate, rows, free)]
    return rate


@pytest.mark.parametrize("weights,whole", [((0.5, 0.5, 0.0), None), ((0.9, 0.1, 0.0), "a"), ((0.2, 0.3, 0.5), None)])
def test_rates_against_plain_steps(spark, weights, whole):
    rng, rows = random.Random(1), []
    for k in range(200):
        p = [0.02, 0.02, 0.02]
        p[rng.choice([0, 0, 0, 1, 2])] = 0.96
        rows.append((rng.randint(0, 500), p))
    members = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(rows)], "doc_id long, n_tokens long, posterior array<double>").repartition(3)
    got = {r["doc_id"]: r["rate"] for r in fit_rates(members, dict(zip("abc", weights)), whole=whole, every=3).collect()}
    want = plain_rates(rows, weights, 0 if whole else None)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in range(200)) and min(got.values()) >= 0
    if min(weights) > 0:
        total = sum(t for t, _ in rows)
        for k, w in enumerate(weights):
            assert abs(sum(t * p[k] * got[n] for n, (t, p) in enumerate(rows)) - w * total) < 0.01 * total


@pytest.mark.parametrize("whole", [None, "good"])
def test_soft_posteriors_meet_targets(spark, whole):
    weights, rng, rows = {"good": 0.95, "poor": 0.05, "toxic": 0.0}, random.Random(7), []
    for _ in range(1500):
        k, soft = rng.choices([0, 1, 2], [68, 29, 3])[0], [rng.gammavariate(0.6, 1) for _ in range(3)]
        soft[k] += 2.5
        rows.append((rng.randint(50, 500), [x / sum(soft) for x in soft]))
    members = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(rows)], "doc_id long, n_tokens long, posterior array<double>").repartition(3)
    rate = {r["doc_id"]: r["rate"] for r in fit_rates(members, weights, whole=whole).collect()}
    good, poor = (sum(t * p[k] * rate[n] for n, (t, p) in enumerate(rows)) for k in (0, 1))
    total = sum(t for t, _ in rows)
    assert min(rate.values()) >= 0
    if whole:
        assert all(rate[n] >= 1 for n, (_, p) in enumerate(rows) if p[0] == max(p))
        assert good >= sum(t * p[0] for t, p in rows) - 2e-4 * total and abs(0.05 * good - 0.95 * poor) < 2e-4 * total
    else:
        assert abs(good - 0.95 * total) < 2e-4 * total and abs(poor - 0.05 * total) < 2e-4 * total


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, None), (12, 1, 1), (8, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mix_sources(edge_docs(spark), labels).collect()
    assert len(out) == len(edge_rows()) and all(abs(sum(r["posterior"]) - 1) < 1e-6 and r["rate"] >= 0 for r in out)
    assert [r["n_tokens"] for r in out if r["doc_id"] == 4] == [9000] and [r["n_tokens"] for r in out if r["doc_id"] == 1] == [0]
    assert len(mix_sources(edge_docs(spark), labels.limit(0)).collect()) == len(edge_rows())
    assert mix_sources(empty_docs(spark), labels).count() == 0


def test_posteriors_on_held_out_labels(spark):
    def doc(k):
        domain = k % 3
        return (k, prose(k, 60) + [" fine text", " %% junk junk", " vile slur"][domain] * 3, int(domain != 1), int(domain == 2))

    rows = [doc(k) for k in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 200], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mix_sources(docs, labels).collect()}
    names = ["good", "poor", "toxic"]
    assert sum(got[k]["domain"] == names[k % 3] for k in range(200, 300)) >= 95
    assert not any(got[k]["kept"] for k in got if got[k]["domain"] == "toxic")


def test_pipeline_effects(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, sf_dir), "test-stage")
        assert kept.columns == docs.columns and kept.exceptAll(before).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).orderBy("doc_id").collect()
    whole, start = Encoder(public_tokenizers.path("byte_bpe_50k.json")).whole, 0
    for r, t in zip(kept.orderBy("doc_id").collect(), tokens, strict=True):
        n = len(whole([r["text"]])[0]) + 1
        assert (t["doc_id"], t["start"], t["n_tokens"]) == (r["doc_id"], start, n)
        start += n
    assert corpus_pipeline.run(spark, sf_dir).count() == len(tokens)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    left = docs.join(labels, "doc_id")
    good = left.where("quality = 1 AND toxic = 0").select("doc_id")
    assert kept.join(labels.where("toxic = 1"), "doc_id", "left_semi").count() <= 0.05 * labels.where("toxic = 1").count()
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.75 * good.count()


def test_pipeline_edges(spark, tmp_path, sf_dir):
    for n, docs in enumerate((edge_docs(spark), empty_docs(spark))):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"edge-stage-{n}")
    assert plain(docs.collect()) == []
