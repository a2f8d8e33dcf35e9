"""Phrases, filling in the middle, packing."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearshelf.llm import collocations
from nearshelf.llm.collocations import mine_phrases
from nearshelf.llm.fill_in_middle import ERROR, RankIndex, boundaries, fill_in_middle, restored
from nearshelf.llm.packing import WordIds, differencing, pack_documents, packed
from tests.llm.edges import edge_docs, edge_rows, empty_docs, plain, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")
LOW = {65 + i: 97 + i for i in range(26)}


def plain_phrases(rows, longest, least, top, share):
    """Every phrase of every piece counted, every longer phrase compared."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i:i + k]] = max(most[p[i:i + k]], a)
        rows_of = []
        for p, a in candidates.items():
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if 100 * most[p] < share * a:
                rows_of.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def mined(docs, **kw):
    return plain(mine_phrases(docs, **kw).drop("n_words").collect())


@pytest.mark.parametrize("top,share,longest,held", [(5, 80, 4, None), (100_000, 50, 3, None), (300, 80, 4, 40)])
def test_phrases_against_every_phrase(spark, monkeypatch, top, share, longest, held):
    if held:
        # Sums leave a task many times, some of them after being summed with later rows.
        monkeypatch.setattr(collocations, "CHUNK", 500)
        monkeypatch.setattr(collocations, "CODES", held)
        monkeypatch.setattr(collocations, "PHRASES", held)
    rng = random.Random(top)
    words = ["a", "b", "é", "Of", "the", "x" * 40, "日本", "q", "zz"] + [prose(k, 1) for k in range(30)]
    sayings = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(25)]

    def text():
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(sayings) if rng.random() < 0.4 else rng.choice(words) if rng.random() < 0.7 else prose(rng.random(), 1))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]))
        return "".join(out)

    rows = [(text(), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(400)] + [("c d c d c d " * 9, "rep"), (None, "en"), ("", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = mined(docs, least=4, top=top, share=share, longest=longest)
    assert got == plain(plain_phrases(rows, longest, 4, top, share)) and len(got) > 10


def test_phrase_edges(spark):
    rows = [(r[1], r[2]) for r in edge_rows()]
    assert mined(edge_docs(spark), least=2, top=50) == plain(plain_phrases(rows, 4, 2, 50, 80))
    assert mine_phrases(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        mine_phrases(empty_docs(spark), longest=5)


@pytest.mark.parametrize("seed", range(4))
def test_rank_index_gives_every_offset(seed):
    rng = np.random.default_rng(seed)
    offsets = np.cumsum(rng.choice([0, 1, 3, 7, 5_000] if seed else [2], 9_999))
    index = RankIndex(offsets)
    assert (index[np.arange(len(offsets))] == offsets).all()
    assert index.residuals.nbytes == len(offsets) and np.abs(index.residuals).max() <= ERROR
    assert len(RankIndex(np.zeros(0)).first) == 0
    if seed == 0:
        assert len(index.first) == -(-len(offsets) // 1024)


def test_boundaries_are_those_of_the_tokens():
    texts = ["", "ab", "cd e", "", "日本x1 ", "𝔘é", "a\nb", ""]
    starts, first = boundaries(pa.array(texts, pa.large_string()))
    at = 0
    for k, t in enumerate(texts):
        assert (starts[first[k]:first[k + 1] + 1] - at).tolist() == [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)] + [len(t)]
        at += len(t)
    assert boundaries(pa.array([""], pa.large_string()))[0].tolist() == [0]


def plain_middle(doc_id, text):
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not t or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, len(t), "plain", None, None, text or "")
    if h4 % 100 < 20:
        return (doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_plain_cuts(spark):
    texts = ["a<", "<P", "P>x", "<<S>>", "no <M> here", ">", "<" * 40 + "P" * 40, "é𝔘 " * 30, "x" * 3_000 + " y", "\r\n\x00 "]
    rows = [(i, texts[i % len(texts)]) for i in range(150)] + [(r[0], r[1]) for r in edge_rows()]
    docs = spark.createDataFrame([(i, t, "f", 5) for i, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    out = fill_in_middle(docs)
    assert plain(out.collect()) == plain(plain_middle(i, t) for i, t in rows)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    back = out.select("doc_id", restored(F.col("form"), F.col("output")))
    assert plain(back.collect()) == plain((i, t or "") for i, t in rows)
    assert fill_in_middle(empty_docs(spark)).count() == 0


def test_words_have_the_tokenizers_ids():
    texts = ["", "  ", "a\x0bb c\x1cd", "It's we'll don't 3.14,x", "　x y\u0085z", "<|endoftext|> a<|startoftext|>b.", "é ́x Á. ΑΣ. ΑΣ", "İstanbul ǅ. ﬁ",
             "x...y!? ,a 'S 'll", "日本語。テキスト. x", "ᄀ ᅡ", "a\tb\nc\r\nd", " ​ x​y ", prose(5, 900), *(r[1] or "" for r in edge_rows())]
    fresh = Tokenizer.from_file(WORDS)
    want = [fresh.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    encoder = WordIds(WORDS)
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array(texts, pa.large_string()), 1)
        assert [ids[b - n:b].tolist() for n, b in zip(sizes, np.cumsum(sizes))] == want
    ids, sizes = encoder.encode(pa.array([], pa.large_string()), 1)
    assert len(ids) == len(sizes) == 0


@pytest.mark.parametrize("sizes,windows,most", [([8, 7, 6, 5, 4], 2, 16), ([5, 5, 5, 5, 5, 5], 3, 10), ([9] + [1] * 9, 2, 9), ([3], 2, 3)])
def test_differencing(sizes, windows, most):
    window = differencing(sizes, windows)
    assert np.bincount(window, sizes, windows).max() == most and sum(np.bincount(window, sizes)) == sum(sizes)


def test_windows_rise_with_the_capacity():
    items = [(k, 0, np.arange(60, dtype=np.uint32), 60) for k in range(5)]
    got = packed(items, 100, share=10**9)
    assert len(got) == 5 and all(len(w) == 1 for w in got)
    got = packed([(k, 0, np.arange(40, dtype=np.uint32), 40) for k in range(5)], 100)
    assert len(got) == 2 and all(sum(len(x[2]) for x in w) == 100 for w in got)


@pytest.mark.parametrize("capacity,windows", [(64, 4), (2_048, 64)])
def test_packing_keeps_every_id(spark, capacity, windows):
    rng = random.Random(capacity)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(100 + k, prose(k, rng.choice([1, 30, 200, 1_000]))) for k in range(150)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(2)
    pieces = pack_documents(docs, tokenizer_path=WORDS, capacity=capacity, windows=windows).collect()
    fresh = Tokenizer.from_file(WORDS)
    want = Counter((i, tuple(fresh.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    # Pieces of one document follow each other; rows with one doc_id are told apart by their texts.
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, parts in by_doc.items():
        texts = [ids for (d, ids), k in want.items() if d == doc for _ in range(k)]
        assert Counter((len(ids), a) for ids in texts for a in range(len(ids))) == Counter(
            (r["doc_tokens"], r["start"] + k) for r in parts for k in range(r["length"]))
        assert Counter(x for ids in texts for x in ids) == Counter(x for r in parts for x in np.frombuffer(r["ids"], "<u4").tolist())
        if len(texts) == 1:
            whole = b"".join(bytes(r["ids"]) for r in sorted(parts, key=lambda r: r["start"]))
            assert whole == np.array(texts[0], "<u4").tobytes()
    assert set(by_doc) == {i for i, _ in rows}
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at.bit_count() == 1 else capacity - at
    assert padding <= 0.02 * total
    assert pack_documents(empty_docs(spark), tokenizer_path=WORDS).count() == 0


def test_packing_checksums(spark, sf_dir):
    from nearshelf.llm.queries import QUERIES

    fresh = Tokenizer.from_file(WORDS)
    ids = {r["doc_id"]: np.array(fresh.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
           for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op13_packing"](spark, sf_dir).collect():
        a = r["start"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][a:a + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
