"""Repeated 200-byte strings, by a Burrows-Wheeler transform of what can repeat.

A string belongs to the smallest hash of its shorter grams (its minimizer); equal
strings have equal minimizers. Neighbouring strings of one minimizer are one stretch
of bytes. Stretches with equal bytes are one class; classes that share a minimizer are
set side by side and indexed, many groups to a block. On a block's transform, intervals
are extended backward breadth-first, which finds the common prefixes of neighbouring
suffixes by increasing length; those not found before the minimum length are as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.batches import release, slices
from nearshelf.llm.shingles import mixed
from nearshelf.llm.tables import small, written

#: Part of the string that a gram is, starts hashed at a time, bytes of a block.
GRAM_SHARE, SEGMENT, BLOCK_BYTES = 2, 1 << 19, 1_500_000
#: A minimizer with more classes than this is refined to the whole string, whose equal occurrences are one class.
MOST_CLASSES = 2_000
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return (np.cumprod(np.concatenate((one, np.full(n, base)))), np.cumprod(np.concatenate((one, np.full(n, inverse)))))


def gram_hashes(data: np.ndarray, size: int, powers) -> np.ndarray:
    """A hash of every gram of size bytes."""
    up, down = powers
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    return mixed((total[size:] - total[:-size]) * down[:len(data) - size + 1])


def window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every window of size numbers."""
    n = len(x) - size + 1
    padded = np.concatenate((x, np.full(-len(x) % size, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, size)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1:size - 1 + n])


def stretches(data: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """start, number of strings, minimizer, and whether the minimizer stands there twice, of the stretches of some bytes."""
    hashes, width = gram_hashes(data, gram, powers), length - gram + 1
    least = window_minima(hashes, width)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.concatenate((start, [len(least)])))
    value = least[start]
    known = np.unique(value)
    table = np.zeros(1 << 16, bool)
    table[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(table[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, hashes[place]), len(known) - 1)
    hit = known[at] == hashes[place]
    keys = np.sort((at[hit] << 32) + place[hit])
    own = np.searchsorted(known, value) << 32
    twice = np.searchsorted(keys, own + start + count + width - 1) - np.searchsorted(keys, own + start) > 1
    return start, count, value, twice


def _scan(length: int, gram: int):
    """row, start, n, minimizer, bytes' hash, inner: the stretches of every text."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        powers = _powers(SEGMENT + length)
        for batch in slices(batches):
            rows = [[] for _ in range(6)]
            for doc, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                held = text.as_buffer() if text.is_valid else b""
                data = np.frombuffer(held, np.uint8)
                for a in range(0, len(data) - length + 1, SEGMENT):
                    part = data[a:a + SEGMENT + length - 1]
                    start, count, value, twice = stretches(part, length, gram, powers)
                    view = memoryview(part)
                    rows[0].append(np.full(len(start), doc, np.int64))
                    rows[1].append(start + a)
                    rows[2].append(count.astype(np.int32))
                    rows[3].append(value.view(np.int64))
                    rows[4].append(np.fromiter((xxhash.xxh3_64_intdigest(view[x:x + n + length - 1]) for x, n in zip(start.tolist(), count.tolist())), np.uint64, len(start)).view(np.int64))
                    rows[5].append(twice)
            if rows[0]:
                names = ("row", "start", "n", "minimizer", "print", "inner")
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in zip(names, rows)})

    return run


SCAN = "row bigint, start bigint, n int, minimizer bigint, print bigint, inner boolean"


def _ranks(key: np.ndarray) -> np.ndarray:
    """The place of each key among the different keys."""
    by = np.argsort(key)
    ordered = key[by]
    new = np.zeros(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    rank = np.empty(len(key), np.int32)
    rank[by] = np.cumsum(new, dtype=np.int32)
    return rank


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes, in order of their first depth symbols at least (symbols under 512, the last one 0 and alone)."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(6, symbols.dtype)))
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key |= padded[k:k + n]
    rank = _ranks(key)
    known = 7
    while known < depth and rank.max() < n - 1:
        key = rank * np.int64(n + 1)
        if known < n:
            key[:n - known] += rank[known:] + 1
        rank = _ranks(key)
        known *= 2
    del key
    return np.argsort(rank, kind="stable").astype(np.int32)


def distinct_before(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the order, whether it shares fewer than length symbols with the row before.

    On the transform (the symbol before each suffix), the interval of a string w holds
    the intervals of all cw. Intervals are extended level by level; where one ends first
    at level l, the rows around its end share l symbols. Levels stop at length.
    Rows are numbered in 32 bits, as a level holds some ten numbers for each.
    """
    n = len(order)
    before = symbols[order - 1]
    back = np.empty(n, np.int32)
    back[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        size = high - low
        row = np.arange(size.sum(), dtype=np.int32)
        row += np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        to = back[row]
        by = np.argsort(to)
        to, letter = to[by], before[row[by]]
        del row
        of = np.repeat(np.arange(len(low), dtype=np.int32), size)[by]
        del by
        begins = np.concatenate(([True], (of[1:] != of[:-1]) | (letter[1:] != letter[:-1])))
        low = to[begins]
        high = to[np.concatenate((begins[1:], [True]))] + np.int32(1)
        new = ~found[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        found[high] = True
    return found[:n]


def repeats_in_block(pieces: list[bytes], counts: list[int], starts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first starts[i] strings of length bytes occur twice or more, piece i standing for counts[i] copies."""
    sizes = np.array([len(p) for p in pieces])
    symbols = np.zeros(sizes.sum() + len(pieces) + 1, np.uint16)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    weight = np.zeros(len(symbols), np.int64)
    for a, p, c, n in zip(first.tolist(), pieces, counts, starts):
        symbols[a:a + len(p)] = np.frombuffer(p, np.uint8)
        symbols[a:a + len(p)] += 2
        symbols[a + len(p)] = 1
        weight[a:a + n] = c
    order = suffix_order(symbols, length)
    group = np.cumsum(distinct_before(symbols, order, length)) - 1
    held = weight[order]
    again = np.empty(len(symbols), bool)
    again[order] = (held > 0) & (np.bincount(group, weights=held)[group] >= 2)
    return [again[a:a + n] for a, n in zip(first.tolist(), starts)]


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"a": a, "b": b} for a, b in edge.reshape(-1, 2).tolist()]


CLASS = "minimizer bigint, print bigint, n int, ranges array<struct<a:int,b:int>>"


def _blocks(length: int):
    """Classes in order of their minimizers, taken together until a block is full at the end of a minimizer."""
    def judged(rows):
        flags = repeats_in_block([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length)
        return [(r[0], r[1], r[2], _runs(f)) for r, f in zip(rows, flags) if f.any()]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        rows, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if size >= BLOCK_BYTES and r[0] != rows[-1][0]:
                    yield pd.DataFrame(judged(rows), columns=["minimizer", "print", "n", "ranges"])
                    rows, size = [], 0
                    release()
                rows.append(r)
                size += len(r[4])
        if rows:
            yield pd.DataFrame(judged(rows), columns=["minimizer", "print", "n", "ranges"])
        del rows
        release()

    return run


def _cut(length: int, whole: bool):
    """Bytes of the asked stretches; or, if whole, a 128-bit key of every string in them."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        for batch in batches:
            out = []
            for text, asked in zip(batch["text"], batch["asked"]):
                data = text.encode()
                for x in asked:
                    a, n = x["start"], x["n"]
                    piece = data[a:a + n + length - 1]
                    if whole:
                        keys = [xxhash.xxh3_128_digest(piece[k:k + length]) for k in range(n)]
                        out += [(x["minimizer"], x["print"], n, x["c"], k, key) for k, key in enumerate(keys)]
                    else:
                        out.append((x["minimizer"], x["print"], n, x["c"], piece))
            yield pd.DataFrame(out, columns=["minimizer", "print", "n", "c", *(["k", "key"] if whole else ["piece"])])
            del out, batch
            release()

    return run


def _finish(length: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in slices(batches):
            out = []
            for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist()):
                data = bytes(text.as_buffer()) if text.is_valid else b""
                spans: list[list[int]] = []
                for m in sorted((m["a"], m["b"]) for m in marks or []):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)),
                pa.array([r[3] for r in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r[4] for r in out], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    return run


def repeated_bytes(docs: DataFrame, *, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end exclusive), kept_sha256 of every row of docs.

    Texts are UTF-8 bytes; matches never cross rows. A byte is removed if a string of
    length bytes covers it that also starts at another place, in this row or another;
    overlapping places count, and all strings are judged on the texts as given. spans
    are the maximal removed runs, kept_sha256 is of the bytes left, joined.

    A null text counts as empty; texts shorter than length lose nothing. Rows that
    repeat a doc_id, or have none, are rows like any other; equal rows repeat each other.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    long = keyed.where(F.octet_length("text") >= length).select("row", "text")
    gram = max(1, length // GRAM_SHARE)
    found = written(long.mapInArrow(_scan(length, gram), SCAN), "stretches")
    again = found.groupBy("minimizer").agg(F.count("*").alias("c"), F.max("inner").alias("inner")).where("c > 1 OR inner").select("minimizer")
    shared = written(found.join(again, "minimizer"), "shared-stretches")
    classes = shared.groupBy("minimizer", "print", "n").agg(
        F.count("*").alias("c"), F.min(F.struct("row", "start")).alias("at"), F.max("inner").alias("inner"))
    sizes = classes.groupBy("minimizer").agg(F.count("*").alias("d"))
    classes = written(classes.join(sizes, "minimizer").where("d > 1 OR c > 1 OR inner"), "classes")
    asked = classes.where("d > 1 OR inner").select("at.row", "at.start", "minimizer", "print", "n", "c", (F.col("d") > MOST_CLASSES).alias("many"))
    asked = written(asked.groupBy("row").agg(F.collect_list(F.struct("start", "n", "minimizer", "print", "c", "many")).alias("asked")), "asked-stretches")
    held = long.join(small(asked), "row")

    def part(many: bool) -> DataFrame:
        return held.withColumn("asked", F.filter("asked", lambda x: x["many"] == F.lit(many))).where(F.size("asked") > 0).select("text", "asked")

    pieces = part(False).mapInPandas(_cut(length, False), "minimizer bigint, print bigint, n int, c bigint, piece binary")
    blocks = pieces.dropDuplicates(["minimizer", "print", "n"]).repartition("minimizer").sortWithinPartitions("minimizer").mapInPandas(_blocks(length), CLASS)
    whole = part(True).mapInPandas(_cut(length, True), "minimizer bigint, print bigint, n int, c bigint, k int, key binary")
    whole = whole.dropDuplicates(["minimizer", "print", "n", "k"])
    twice = whole.join(whole.groupBy("key").agg(F.sum("c").alias("all")).where("all > 1").select("key"), "key")
    refined = twice.groupBy("minimizer", "print", "n").agg(F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("ranges"))
    simple = classes.where("d = 1 AND NOT inner").select("minimizer", "print", "n", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("ranges"))
    ranges = written(blocks.unionByName(refined).unionByName(simple), "repeated-ranges")
    marks = shared.join(ranges, ["minimizer", "print", "n"]).select("row", "start", F.explode("ranges").alias("r")).select(
        "row", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b")).alias("m"))
    marks = written(marks.groupBy("row").agg(F.collect_set("m").alias("marks")), "marks")
    return keyed.join(small(marks), "row", "left").select("doc_id", "text", "marks").mapInArrow(
        _finish(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
