"""Token ids of a corpus as one wavelet matrix per shard, in files that Spark writes and reads.

A shard is one row of a Parquet table: a bit plane per bit of an id, highest first,
each with the ones counted before every block, and the documents with their lengths.
Tokens are read, counted and found from the planes without unpacking the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearshelf.llm.batches import slices
from nearshelf.llm.encoding import Encoder
from nearshelf.llm.worker import kept

SHARD = ("part int, shard int, bits int, n_tokens bigint, zeros array<bigint>, planes array<binary>, ranks array<binary>, "
         "doc_ids array<bigint>, lengths array<bigint>")
#: Bits between two entries of a rank directory.
BLOCK = 512
#: Text encoded at a time, in bytes.
CHUNK = 8_000_000


class WaveletMatrix:
    """Bit planes of a sequence of ids; each plane's zeros move before its ones in the next."""

    def __init__(self, n: int, zeros, planes, ranks):
        self.n, self.zeros, self.bits = int(n), [int(z) for z in zeros], len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = (rest & rest.dtype.type(1 << level)) != 0
            plane = np.packbits(one)
            padded = np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(-1, BLOCK // 8)
            ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(padded).sum(1, dtype=np.int64)))).astype(np.uint32).tobytes())
            low = np.compress(~one, rest)
            zeros.append(len(low))
            planes.append(plane.tobytes())
            rest = np.concatenate((low, np.compress(one, rest)))
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        at = block * BLOCK // 8
        whole, left = plane[at:i >> 3], i & 7
        tail = int(plane[i >> 3]) >> (8 - left) if left else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(whole).sum()) + tail.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane, by halving on the counts."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            low, high = (low, mid) if (ones if bit else mid + 1 - ones) > k else (mid + 1, high)
        return low

    def access(self, i: int) -> int:
        """The id at a position."""
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out, i = 2 * out + bit, self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            oa, ob = self._ones(level, a), self._ones(level, b)
            if token >> (self.bits - 1 - level) & 1:
                a, b = self.zeros[level] + oa, self.zeros[level] + ob
            else:
                a, b = a - oa, b - ob
        return a, b

    def rank(self, token: int, end: int) -> int:
        """How often an id stands before a position."""
        a, b = self._range(token, end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id, -1 past the last."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def sequence(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        rest = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before = np.empty(self.n, kind)
            z = self.zeros[level]
            before[np.flatnonzero(~one)] = rest[:z]
            before[np.flatnonzero(one)] = rest[z:] | kind(1 << (self.bits - 1 - level))
            rest = before
        return rest.astype(np.uint32)


def _shards(path: str, bits: int, end_id: int, shard_tokens: int):
    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = kept(("encoder", path), lambda: Encoder(path))
        part, number = TaskContext.get().partitionId(), 0
        ids, docs, lengths, held = [], [], [], 0

        def flush(some, names, sizes):
            matrix = WaveletMatrix.of(some, bits)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "bits": pa.array([bits], pa.int32()),
                "n_tokens": pa.array([matrix.n], pa.int64()), "zeros": pa.array([matrix.zeros], pa.list_(pa.int64())),
                "planes": pa.array([[p.tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
                "ranks": pa.array([[r.tobytes() for r in matrix.ranks]], pa.list_(pa.binary())),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([sizes], pa.list_(pa.int64()))})

        for batch in slices(batches, size=CHUNK):
            found, sizes = encoder.encode(batch.column("text").cast(pa.large_string()), end_id)
            at = 0
            for name, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                docs.append(name)
                lengths.append(n)
                at += n
                if held + at >= shard_tokens:
                    yield flush(np.concatenate([*ids, found[:at]]), docs, lengths)
                    found, at, held, ids, docs, lengths, number = found[at:], 0, 0, [], [], [], number + 1
            if len(found):
                ids.append(found)
                held += len(found)
        if docs:
            yield flush(np.concatenate(ids), docs, lengths)

    return build


def write_token_shards(docs: DataFrame, out: str, *, tokenizer_path: str, vocabulary: int = 50_257, end_id: int = 2,
                       shard_tokens: int = 2_000_000, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the token ids of docs, in ascending doc_id order, as wavelet matrices under out.

    Each text is encoded whole and ends with end_id. A null text counts as empty. Rows
    without doc_id come first; rows with one doc_id stay side by side, ordered by text.
    A document is never split, so a shard holds shard_tokens and one document at most.
    tokenizer_path names a file that every worker can open. No row, no shard.
    """
    bits = max(1, (max(vocabulary - 1, end_id)).bit_length())
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_shards(tokenizer_path, bits, end_id, shard_tokens), SHARD).write.option("compression", "zstd").parquet(out)


def _matrices(batches: Iterator):
    for batch in batches:
        for r in batch.itertuples(index=False):
            yield r, WaveletMatrix(r.n_tokens, r.zeros, r.planes, r.ranks)


def _documents(batches: Iterator) -> Iterator:
    import pandas as pd

    for r, matrix in _matrices(batches):
        ids = matrix.sequence()
        lengths = np.asarray(r.lengths, np.int64)
        ends = np.cumsum(lengths)
        view = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(view[4 * (e - n):4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())]
        yield pd.DataFrame({"part": r.part, "shard": r.shard, "doc_id": pd.array(list(r.doc_ids), "Int64"),
                            "first": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})


def shard_starts(spark: SparkSession, out: str) -> DataFrame:
    """part, shard, before: ids in all shards before this one."""
    sizes = spark.read.parquet(out).select("part", "shard", "n_tokens")
    # One number per written partition passes through the driver.
    parts, so_far = [], 0
    for r in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        parts.append((r["part"], so_far))
        so_far += r["n"]
    from pyspark.sql import Window

    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = spark.createDataFrame(parts, "part int, part_start bigint")
    return sizes.join(F.broadcast(starts), "part").select(
        "part", "shard", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("before"))


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from its decoded ids."""
    rows = spark.read.parquet(out).mapInPandas(
        _documents, "part int, shard int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(shard_starts(spark, out)), ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, out: str, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each asked id in the whole corpus."""
    def count(batches):
        import pandas as pd

        for _, m in _matrices(batches):
            yield pd.DataFrame({"token": tokens, "n": [m.rank(t, m.n) for t in tokens]})

    return spark.read.parquet(out).mapInPandas(count, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, out: str, token: int) -> DataFrame:
    """doc_id, position: where an id stands, position counted from the document's first id."""
    def find(batches):
        import pandas as pd

        for r, m in _matrices(batches):
            at = np.array([m.select(token, k) for k in range(m.rank(token, m.n))], np.int64)
            ends = np.cumsum(np.asarray(r.lengths, np.int64))
            doc = np.searchsorted(ends, at, "right")
            yield pd.DataFrame({"doc_id": pd.array([r.doc_ids[d] for d in doc], "Int64"), "position": at - (ends - r.lengths)[doc]})

    return spark.read.parquet(out).mapInPandas(find, "doc_id bigint, position bigint")


def token_at(spark: SparkSession, out: str, position: int) -> DataFrame:
    """doc_id, position, token: one id of every document long enough, read from the planes."""
    def pick(batches):
        import pandas as pd

        for r, m in _matrices(batches):
            first = np.cumsum(np.asarray(r.lengths, np.int64)) - r.lengths
            rows = [(d, position, m.access(int(a) + position)) for d, a, n in zip(r.doc_ids, first, r.lengths) if position < n]
            yield pd.DataFrame({"doc_id": pd.array([x[0] for x in rows], "Int64"), "position": pd.array([x[1] for x in rows], "Int64"),
                                "token": pd.array([x[2] for x in rows], "Int64")})

    return spark.read.parquet(out).mapInPandas(pick, "doc_id bigint, position bigint, token int")
