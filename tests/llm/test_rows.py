"""Operators that judge row by row: quality rules, secrets, languages, tokens, URLs."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nearshelf.llm.encoding import Encoder
from nearshelf.llm.language_id import Pieces, identify_language
from nearshelf.llm.quality_rules import COMMON_WORDS, quality_rules
from nearshelf.llm.secret_scan import BASE, MORE, Rule, scan_secrets, spans_text, trigram_query
from nearshelf.llm.token_shards import WaveletMatrix, count_tokens, find_token, read_documents, token_at, write_token_shards
from nearshelf.llm.url_filter import filter_urls
from tests.llm.edges import edge_docs, edge_rows, empty_docs, plain, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def quality_row(doc_id, text):
    t = text or ""
    w = WORDS.findall(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts(spark):
    got = quality_rules(edge_docs(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert plain(got) == plain(quality_row(r[0], r[1]) for r in edge_rows())


def test_quality_keeps_columns_and_empty_tables(spark):
    docs = edge_docs(spark)
    out = quality_rules(docs)
    assert set(docs.columns) - {"n_words", "_text", "kept"} <= set(out.columns)
    assert quality_rules(empty_docs(spark)).count() == 0


def test_quality_divergence(spark):
    clean = [(i, "the of and " + prose(i, 100), "en") for i in range(40)]
    odd = [(100, "### $$$ " + " ".join("@@%%" * 3 for _ in range(90)) + "".join(f" {k}" for k in range(60)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and all(got[i] for i in range(40))


def test_quality_without_common_words(spark):
    rng = random.Random(4)

    def text(lang, share, n=120):
        other = prose(rng.random(), n).split()
        return " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < share else w for w in other)

    rows = [(k, text(lang, 0.27), lang) for k, lang in enumerate(["en", "de"] * 60)]
    salad, wrong = text("en", 0.0), text("de", 0.27)
    menu = " ".join(f"{w}, {v} and" if k % 12 == 0 else f"{w}, {v}" for k, (w, v) in enumerate(zip(prose(8, 60).split(), prose(9, 60).split())))
    rows += [(1000, salad, "en"), (1001, wrong, "en"), (1002, menu, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(docs, max_common_share=corpus_pipeline.COMMON_SHARE).collect()}
    assert all(got[k] for k in range(120)) and not any(got[k] for k in (1000, 1001, 1002))


def plain_spans(text, rules):
    out = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), n, m.end(), r.kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets_against_plain_search(spark):
    key, other = "AKIA" + "Q1W2E3R4T5Y6", "ghp_" + "a1B2" * 9
    texts = [None, "", "secret: token: abcdefghij", f"é𝔘 {key} AKIAB AKIA", f'API_KEY = "{other}" x', "0123456789abcdef" * 2, "0" * 31 + " " + "f" * 70,
             "passwd=short password=longenough1 SECRET:'also-long-enough'", f"{other}{other}", "apikey:" + "x" * 8 + " token" * 50, "x" * 5000 + key]
    docs = spark.createDataFrame([(i % 9 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kinds int")
    got = scan_secrets(docs).select("doc_id", spans_text(F.col("base_spans")).alias("b"), spans_text(F.col("spans")).alias("s")).collect()
    assert plain(got) == plain((i % 9 or None, plain_spans(t or "", BASE), plain_spans(t or "", [*BASE, *MORE])) for i, t in enumerate(texts))
    assert scan_secrets(empty_docs(spark)).count() == 0


def test_secrets_of_a_long_text_with_many_matches(spark):
    rng = random.Random(6)
    text = " ".join(f"{rng.getrandbits(128):032x}" if k % 2 else prose(k, 3) for k in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, text[:2_000])], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["s"] for r in scan_secrets(docs).select("doc_id", spans_text(F.col("spans")).alias("s")).collect()}
    assert time.time() - began < 60
    assert got == {1: plain_spans(text, [*BASE, *MORE]), 2: plain_spans(text[:2_000], [*BASE, *MORE])} and got[1].count("hex") > 19_000


def test_quality_query_rejects_texts_without_common_words(spark, tmp_path):
    from nearshelf.llm.queries import QUERIES

    rng = random.Random(4)

    def text(lang, share, n=120):
        return " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < share else w for w in prose(rng.random(), n).split())

    rows = [(k, text(lang, 0.27), lang) for k, lang in enumerate(["en", "de"] * 60)]
    rows += [(1000, text("en", 0.0), "en"), (1001, text("de", 0.27), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op2_quality_rules"](spark, str(tmp_path)).collect()}
    assert all(got[k] for k in range(120)) and not got[1000] and not got[1001]


def test_trigram_queries():
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query("[0-9a-f]{32,}") is None and trigram_query("(abc|x)y*") is None
    assert trigram_query("ab(c|d)e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]
    assert trigram_query("abc(de)?fgh") == [frozenset({"abc", "bcd", "cde", "def", "efg", "fgh"}), frozenset({"abc", "bcf", "cfg", "fgh"})]


def test_own_rules_without_trigrams(spark):
    docs = spark.createDataFrame([(1, "7a 7b")], "doc_id long, text string")
    got = scan_secrets(docs, base=(Rule("d", "[0-9][a-z]"),), more=()).select(spans_text(F.col("spans")).alias("s")).first()
    assert got["s"] == "d:0:2,d:3:5"


TEXTS = ["", " ", "a  b", " a", "a ", "\n", "\n\na", "a\n b", "x y z", "it's don't  we'll\n\n x", "<|endoftext|> a", "e\u0301\u00a0\u00df\u0085k",
         "123 456,7 --- !!", "a\x1cb \x01c", "\u65e5\u672c\u8a9e. \u30c6", "\nx", "x\n", "x.y, z!... (w).", "l'\u00e9t\u00e9, fin;", "a, a. a", "word " * 300]


def test_pieces_have_the_tokenizers_ids():
    encoder = Encoder(BPE)
    for texts in (TEXTS, list(reversed(TEXTS)), [prose(k, 50) for k in range(20)]):
        ids, sizes = encoder.encode(pa.array(texts, pa.large_string()), 2)
        ends = np.cumsum(sizes)
        assert [ids[b - n:b].tolist() for n, b in zip(sizes, ends)] == [x + [2] for x in encoder.whole(texts)]


def test_added_tokens_have_the_librarys_ids():
    texts = ["<|endoftext|>", "a <|endoftext|> b.", "a<|endoftext|>, b\nc", "<|endoftext|", "a b", *TEXTS]
    ids, sizes = Encoder(BPE).encode(pa.array(texts, pa.large_string()), 2)
    fresh = Tokenizer.from_file(BPE)
    want = [fresh.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids[b - n:b].tolist() for n, b in zip(sizes, np.cumsum(sizes))] == want
    assert want[0] == [50256, 2]


@pytest.mark.parametrize("bits,n", [(1, 1), (3, 40), (16, 3000), (17, 600)])
def test_wavelet_matrix(bits, n):
    a = np.random.default_rng(n).integers(0, min(1 << bits, 70_000), n)
    m = WaveletMatrix.of(a, bits)
    assert (m.sequence() == a).all()
    for i in range(0, n, max(1, n // 50)):
        t = int(a[i])
        assert m.access(i) == t and m.rank(t, i) == (a[:i] == t).sum() and m.select(t, m.rank(t, i)) == i
    assert m.select(int(a[0]), n) == -1 and m.rank(1 << bits, n) == 0


def test_token_files(spark, tmp_path):
    out = str(tmp_path / "tokens")
    docs = edge_docs(spark)
    write_token_shards(docs, out, tokenizer_path=BPE, shard_tokens=500)
    whole = Encoder(BPE).whole
    want, start, tokens = [], 0, []
    for r in sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(whole([r[1] or ""])[0] + [2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        tokens.append((r[0], ids))
        start += len(ids)
    got = read_documents(spark, out)
    assert plain(got.collect()) == plain(want)
    t = int(tokens[-1][1][0])
    assert [r["n"] for r in count_tokens(spark, out, [t]).collect()] == [sum(int((x == t).sum()) for _, x in tokens)]
    assert plain(find_token(spark, out, t).collect()) == plain((d, i) for d, x in tokens for i in np.flatnonzero(x == t).tolist())
    assert plain(token_at(spark, out, 1).collect()) == plain((d, 1, int(x[1])) for d, x in tokens if len(x) > 1)
    empty = str(tmp_path / "none")
    write_token_shards(empty_docs(spark), empty, tokenizer_path=BPE)
    assert read_documents(spark, empty).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "\u2581", "\u2581a"]
    p = np.array([[0.2], [0.3], [0.1], [0.1], [0.3]])
    scaled = p * np.power(500.0, [[1], [2], [1], [1], [2]])
    got = np.exp(Pieces(pieces).log_likelihoods(["\u2581ab", "b", "\u2581aba"], scaled))[:, 0]
    ab = 0.1 * 0.2 * 0.1 + 0.1 * 0.3 + 0.3 * 0.1
    assert np.allclose(got, [ab, 0.1, ab * 0.2])


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify_language(docs, model=PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_long_words_sum_over_all_segmentations(monkeypatch):
    import nearshelf.llm.language_id as L

    made = np.random.default_rng(3)
    listed = sorted({L.MARK} | {L.MARK[:k % 2] + "".join(made.choice(list("abc"), 1 + k % 5)) for k in range(60)})
    finder = Pieces(listed)
    probability = made.random((len(listed), 3)) / len(listed)
    scaled = probability * np.power(L.SCALE, [len(p) for p in listed])[:, None]
    words = [L.MARK + "".join(made.choice(list("abcd"), n)) for n in (1, 20, 48, 49, 50, 97, 400)]

    def plain(word, column):
        ahead = [0.0]
        for end in range(1, len(word) + 1):
            ways = [ahead[end - len(p)] + np.log(probability[k, column]) for k, p in enumerate(listed) if len(p) <= end and word[end - len(p):end] == p]
            if word[end - 1] not in listed:
                ways.append(ahead[end - 1] + np.log(L.FLOOR))
            ahead.append(np.logaddexp.reduce(ways))
        return ahead[-1]

    want = [[plain(w, c) for c in range(3)] for w in words]
    assert np.allclose(finder.log_likelihoods(words, scaled), want, rtol=1e-9)
    monkeypatch.setattr(L, "PLACES", 7)
    monkeypatch.setattr(L, "LONG", 0)
    assert np.allclose(finder.log_likelihoods(words, scaled), want, rtol=1e-9)


def test_language_edges(spark):
    rows = {r["lang_pred"] for r in identify_language(edge_docs(spark), model=PIECES).where("doc_id IN (1, 2, 3)").collect()}
    assert rows == {"und"}
    got = identify_language(edge_docs(spark), model=PIECES).collect()
    assert len(got) == len(edge_rows()) and all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    nothing = identify_language(edge_docs(spark).withColumn("lang", F.lit(None).cast("string")), model=PIECES)
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert identify_language(empty_docs(spark), model=PIECES).count() == 0


def test_urls(spark):
    urls = [(1, "HTTP://A.Example.NET/en/x?y=1"), (2, "x://net"), (3, "x://net/"), (4, "https://sub.example.com/de/1#t"), (5, "https://bexample.com/de/1"),
            (6, "http://w.org/fr/"), (7, None), (8, ""), (9, "no scheme"), (10, "a://b://c/d"), (11, "http://h?p=1"), (11, "http://h?p=1"), (None, "http://x.net/en")]
    got = filter_urls(spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string"))
    rows = plain(got.select("page_id", "host", "path", "rule").collect())
    assert rows == plain([(1, "a.example.net", "/en/x", "example.net/en/"), (2, "net", "", None), (3, "net", "/", "net/"), (4, "sub.example.com", "/de/1", "example.com/de/"),
                          (5, "bexample.com", "/de/1", None), (6, "w.org", "/fr/", "org/fr/"), (7, "", "", None), (8, "", "", None), (9, "", "", None), (10, "b:", "//c/d", None),
                          (11, "h", "", None), (11, "h", "", None), (None, "x.net", "/en", "net/")])
    verdicts = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert (verdicts[1], verdicts[3], verdicts[4], verdicts[6]) == ("allow", "block", "block", "allow") and set(verdicts.values()) <= {"allow", "block"}
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_on_held_out_labels(spark):
    def url(k):
        bad = k % 2
        return (f"http://{'x-y-z-' * (2 if bad else 0)}h{k % 7}.test{k % 3}.info/{'a/' * (1 + 4 * bad)}{k}" + ("?a=1&b=2&c=3" if bad else ""), bad)

    labels = spark.createDataFrame([url(k) for k in range(400)], "url string, blocked int")
    pages = spark.createDataFrame([(k, url(k)[0]) for k in range(400, 500)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages, labels=labels, rules=()).collect()}
    assert sum(got[k] == ("block" if k % 2 else "allow") for k in got) >= 95


def test_slices_hold_the_same_texts():
    from nearshelf.llm.batches import slices
    from nearshelf.llm.shingles import shingle_sets

    texts = [prose(k, k % 40) + " É ß\tX" * (k % 3) for k in range(200)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": pa.array(range(len(texts)))})
    cut = list(slices([batch], size=300))
    assert len(cut) > 20 and [n for b in cut for n in b.column("n").to_pylist()] == list(range(len(texts)))
    parts = [s.tolist() for b in cut for s in shingle_sets(b.column("text"), 2)]
    assert parts == [s.tolist() for s in shingle_sets(batch.column("text"), 2)]
    lower = {65 + i: 97 + i for i in range(26)}
    for t, s in zip(texts, parts):
        w = WORDS.findall((t or "").translate(lower))
        assert len(s) == (len(set(zip(w, w[1:]))) if len(w) > 1 else len(w))
