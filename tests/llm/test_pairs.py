"""Operators that compare documents: Jaccard join, line dedup, decontamination, repeated bytes."""

import hashlib
import random
import tracemalloc
import time
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import nearshelf.llm.suffix_dedup as suffix_dedup
from nearshelf.llm.components import components
from nearshelf.llm.decontaminate import ImpactIndex, find_contamination, overlap, terms
from nearshelf.llm.jaccard_join import keep_first, similar_components
from nearshelf.llm.line_dedup import dedup_lines, near_lines
from nearshelf.llm.suffix_dedup import repeated_bytes, repeats_in_block
from tests.llm.edges import edge_docs, edge_rows, empty_docs, plain, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def smallest(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 4), (7, 6)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = smallest({x for link in real for x in link}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_components(rows, width, percent):
    """Of rows with one doc_id, the first text counts."""
    texts = {}
    for i, t in rows:
        if i is not None and (i not in texts or texts[i] is None or (t is not None and t < texts[i])):
            texts[i] = t
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = smallest(sets, links)
    return {i: (len(sets[i]), of[i]) for i in sets}


def near_copies(seed, n, words, edits):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(copy))
            what = rng.randrange(3)
            copy[k:k + 1] = [] if what == 0 else [prose(rng.random(), 1)] if what == 1 else [copy[k].upper(), prose(rng.random(), 1)]
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_against_all_pairs(spark, width, percent):
    shared = prose(77, 60)
    texts = near_copies(1, 90, 150, 5) + near_copies(2, 40, 30, 3) + near_copies(3, 30, 8, 2) + [shared + " " + prose(k, 60) for k in range(500, 540)]
    texts += [prose(9, k) for k in range(1, 8)] * 2
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts))
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=width, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, width, percent)


def short_families(seed):
    """Texts of 17 to 25 four-word shingles, each family cut at the ends from one text, with other words put there."""
    rng = random.Random(seed)
    texts = []
    for f in range(40):
        w, x, y, z = [f"f{f}w{k}" for k in range(40)], f"f{f}x", f"f{f}y", f"f{f}z"
        texts += [[x, *w[1:22], y], w[:22], [x, *w[1:21], z], [x, *w[1:20]]]
        for _ in range(4):
            n = rng.randint(17, 25) + 3
            a = rng.randint(0, 3)
            part = w[a:a + n]
            part[:1] = rng.choice([[x], [y], part[:1]])
            part[-1:] = rng.choice([[y], [z], part[-1:]])
            texts.append(part)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("percent", [80, 85])
def test_jaccard_of_short_families(spark, percent):
    rows = list(enumerate(short_families(percent)))
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, 4, percent)


def test_jaccard_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = similar_components(edge_docs(spark), width=4, percent=85).collect()
    assert len(got) == len(rows)
    want = plain_components(rows, 4, 85)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert similar_components(empty_docs(spark)).count() == 0
    kept = [r["doc_id"] for r in keep_first(edge_docs(spark), width=4, percent=85).collect()]
    assert sorted(kept, key=repr) == sorted((i for i, _ in rows if i is None or want[i][1] == i), key=repr)


def plain_line_dedup(rows, min_words):
    lines = [((i, n), tuple(WORDS.findall(x))) for i, t in rows if t is not None and i is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[1]]
    first = {}
    for at, w in sorted(lines):
        first.setdefault(w, at)
    near = set()
    for (a, at_a), (b, at_b) in combinations([x for x in first.items() if len(x[0]) >= min_words], 2):
        short, long = sorted((a, b), key=len)
        same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        one = len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))
        if same or one:
            near.add(max(at_a, at_b))
    return {(at, "copy") for at, w in lines if at > first[w]} | {(at, "near") for at in near}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(3)
    base = [prose(k, n).split() for k, n in enumerate([3, 4, 5, 5, 6, 7, 12, 30])] + [["a"] * 5, ["a"] * 6, ["a", "b"] * 4]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(5):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [w[k], rng.choice("abc")], [rng.choice("abc")]])
            lines.append("  ".join(w))
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    got = near_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {((r["doc_id"], r["line_no"]), r["kind"]) for r in got} == plain_line_dedup(rows, 5) and len(got) == len(set(got))


def test_line_dedup_of_a_document_with_very_many_lines(spark):
    lines = [f"line {k} of a long document" if k % 2 else "the same line again and again" for k in range(200_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    got = dedup_lines(docs).first()
    assert time.time() - began < 90
    assert (got["n_lines"], got["n_copies"]) == (200_000, 99_999)
    # Lines that differ in one word are near copies of the first one, too.
    assert got["text"].split("\n") == lines[:2]


def test_line_dedup_edges(spark):
    once = [r for r in edge_rows() if r[0] not in (7, 11)]
    docs = spark.createDataFrame(once, edge_docs(spark).schema)
    drop = defaultdict(dict)
    for (i, n), kind in plain_line_dedup([(r[0], r[1]) for r in once], 5):
        drop[i][n] = kind
    got = dedup_lines(docs).select("doc_id", "text", "n_lines", "n_copies", "n_near").collect()
    want = []
    for r in once:
        gone, parts = drop.get(r[0], {}), (r[1] or "").split("\n")
        text = "\n".join(x for n, x in enumerate(parts) if n not in gone) if r[1] is not None else None
        kinds = Counter(gone.values())
        want.append((r[0], text, len(parts) if r[1] is not None else 0, kinds["copy"], kinds["near"]))
    assert plain(got) == plain(want)
    assert dedup_lines(edge_docs(spark)).count() == len(edge_rows()) and dedup_lines(empty_docs(spark)).count() == 0


def plain_repeats(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for i, b in data:
        spans = []
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        left = b"".join(b[x:y] for x, y in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(b)]))
        out.append((i, len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most,length", [(2000, 200), (0, 200), (2, 20)])
def test_repeated_bytes_against_counts(spark, monkeypatch, most, length):
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", most)
    passage = prose(4, 60)
    texts = [prose(k, 30) + passage + prose(k + 100, 20) for k in range(12)] + near_copies(6, 10, 150, 4) + ["ab" * 300, "x" * 250, passage[:210], "y" * 199]
    rows = list(enumerate(texts)) + [(r[0], r[1]) for r in edge_rows()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3)
    got = repeated_bytes(docs, length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert plain(got) == plain(plain_repeats(rows, length))


def test_repeated_bytes_of_nothing(spark):
    assert repeated_bytes(empty_docs(spark)).count() == 0


def test_block_expansion():
    rng = random.Random(1)
    for _ in range(40):
        length, letters = rng.choice([5, 8, 13]), rng.choice([b"a", b"ab", b"abcd", bytes([0, 255])])
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 8))]
        counts, starts = [rng.choice([1, 1, 2]) for _ in pieces], [rng.randint(1, len(p) - length + 1) for p in pieces]
        seen = Counter()
        for p, c, n in zip(pieces, counts, starts):
            for k in range(n):
                seen[p[k:k + length]] += c
        want = [[seen[p[k:k + length]] >= 2 for k in range(n)] for p, n in zip(pieces, starts)]
        assert [x.tolist() for x in repeats_in_block(pieces, counts, starts, length)] == want


def test_search_finds_what_scoring_all_items_finds():
    rng = random.Random(2)
    vocabulary = prose(8, 60).split()
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 25))] for _ in range(150)]
    held = Counter(t for w in items for t in set(w))
    index = ImpactIndex([(n, w, [], held) for n, w in enumerate(items)], len(items), 15.0, 1.2, 0.75, 0.3)
    for _ in range(60):
        asked = sorted({index.number[t] for t in rng.sample(vocabulary, rng.randint(1, 30)) if t in index.number})
        score = Counter()
        for t in asked:
            for n, x in zip(index.items[t], index.impact[t]):
                score[n] += x
        for least in (0.3, 0.5, 0.9):
            assert [n for n, _ in index.search(asked, least)] == sorted(n for n, x in score.items() if x >= least - 1e-9)


def test_contamination(spark):
    items = [(1, f"{prose(31, 20)}. {prose(32, 8)}."), (2, prose(33, 30)), (2, prose(34, 12) + "? " + prose(35, 4)), (3, None), (4, ""), (5, "a b"), (None, prose(36, 15))]
    benchmark = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double")
    edited = items[1][1].split()
    edited[10] = "changed"
    docs = [(10, prose(40, 300) + " " + items[0][1].upper() + " " + prose(41, 300)), (11, prose(42, 50) + "\n" + " ".join(edited)), (12, items[2][1]),
            (13, items[0][1].split(". ")[0] + " " + prose(43, 50)), (14, prose(44, 500)), (15, None), (16, ""), (None, items[6][1]), (12, items[2][1])]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, score int")
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(table, benchmark).collect()}
    assert got == {(10, 1), (11, 2), (12, 2), (None, None)}
    assert find_contamination(empty_docs(spark), benchmark).count() == 0 and find_contamination(table, benchmark.limit(0)).count() == 0


def test_contamination_of_test_data(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], " ".join(terms(r["text"]))) for r in benchmark.collect()]
    whole = {(r["doc_id"], i) for r in docs.collect() for i, t in items if f" {t} " in f" {' '.join(terms(r['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(docs, benchmark).collect()}
    assert whole and whole <= got
    assert overlap(set(), {1}) == 1


def test_a_block_takes_few_bytes_for_each_of_its_own():
    rng = random.Random(3)
    base = [bytes(rng.choice(b"abcdefgh") for _ in range(600)) for _ in range(80)]
    pieces = [b[:k] + bytes([k % 256]) + b[k + 1:] for b in base for k in (50, 250, 450)]
    repeats_in_block(pieces[:3], [1] * 3, [401] * 3, 200)
    tracemalloc.start()
    repeats_in_block(pieces, [1] * len(pieces), [401] * len(pieces), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * 601 * len(pieces)
