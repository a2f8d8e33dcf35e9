"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are put in one order over the corpus, rare before frequent. Two sets that
are similar enough share a shingle in short prefixes of both, l shingles in prefixes
longer by l - 1. Each set chooses l by what its prefix would cost: the rows its lists
give and the pairs left to verify. Prefix lengths depend on both sizes, so lists are
kept by shingle and size class of the smaller set.

Only components are asked for, so pairs inside one are not listed: equal sets are one,
then every set is verified against one central set of its lists, and the join runs
between different components only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearshelf.llm.batches import slices
from nearshelf.llm.components import components
from nearshelf.llm.shingles import shingle_sets
from nearshelf.llm.tables import small, written

#: Cells of the frequency sketch (its size never grows) and cells per row of it.
CELLS, CELL_ROW = 1 << 20, 1 << 14
#: Most shingles that two prefixes may have to share; sets under LEAST_SIZE shingles ask for 1.
LEVELS, LEAST_SIZE = 3, 20
#: Ratio of neighbouring size classes, and the cost of verifying a pair in rows of the join.
CLASS_RATIO, VERIFY_COST = 1.06, 1.0


def _signatures(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            sizes, prints = [], []
            for s in shingle_sets(batch.column("text"), width):
                cells += np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(s) > CELLS // 8 else 0
                if 0 < len(s) <= CELLS // 8:
                    cells[(s & np.uint64(CELLS - 1)).astype(np.int64)] += 1
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "print": pa.array(prints, pa.binary()),
                "row": pa.nulls(len(sizes), pa.int32()), "cells": pa.nulls(len(sizes), pa.binary())})
        used = [r for r in range(CELLS // CELL_ROW) if cells[r * CELL_ROW:(r + 1) * CELL_ROW].any()]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(len(used), pa.int64()), "n": pa.nulls(len(used), pa.int64()), "print": pa.nulls(len(used), pa.binary()),
            "row": pa.array(used, pa.int32()),
            "cells": pa.array([zlib.compress(cells[r * CELL_ROW:(r + 1) * CELL_ROW].astype("<u8").tobytes(), 1) for r in used], pa.binary())})

    return run


def _summed(batches: Iterator) -> Iterator:
    """Sum of the sketches that a task reads."""
    import pandas as pd

    cells: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, packed in zip(batch["row"].tolist(), batch["cells"]):
            found = np.frombuffer(zlib.decompress(packed), "<u8")
            cells[row] = cells[row] + found if row in cells else found
    yield pd.DataFrame({"row": list(cells), "cells": [zlib.compress(c.tobytes(), 1) for c in cells.values()]})


def _sketch(table: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each cell; CELLS numbers, whatever the corpus."""
    parts = table.where("row IS NOT NULL").select("row", "cells")
    rows = parts.mapInPandas(_summed, "row int, cells binary").repartition("row").mapInPandas(_summed, "row int, cells binary").collect()
    out = np.zeros(CELLS, np.uint64)
    for r in rows:
        out[r["row"] * CELL_ROW:(r["row"] + 1) * CELL_ROW] += np.frombuffer(zlib.decompress(r["cells"]), "<u8")
    return out


def _prefixes(width: int, percent: int, shared):
    """doc_id, n, token, pos (from 1): the longest prefix that any partner may ask for."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells = np.minimum(shared.value, np.uint64((1 << 24) - 1)) << np.uint64(40)
        for batch in slices(batches):
            ids, sizes, tokens, docs = batch.column("doc_id").to_numpy(), [], [], []
            for k, s in enumerate(shingle_sets(batch.column("text"), width)):
                n = len(s)
                if n:
                    order = np.argsort(cells[(s & np.uint64(CELLS - 1)).astype(np.int64)] | (s >> np.uint64(24)), kind="stable")
                    least = -(-percent * n // 100)
                    # Sets of LEAST_SIZE or more ask for up to LEVELS, also of smaller ones that they can be similar to.
                    found = s[order[:min(n, n - least + (LEVELS if 100 * n >= percent * LEAST_SIZE else 1))]]
                    tokens.append(found)
                    docs.append(ids[k])
                    sizes.append((len(found), n))
            if tokens:
                count = np.array([c for c, _ in sizes])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(np.repeat(np.array(docs, np.int64), count)),
                    "n": pa.array(np.repeat(np.array([n for _, n in sizes], np.int32), count)),
                    "token": pa.array(np.concatenate(tokens).view(np.int64)),
                    "pos": pa.array((np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1).astype(np.int32))})

    return run


def _sets(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            found = list(shingle_sets(batch.column("text"), width))
            ends = np.cumsum([0] + [len(s) for s in found]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            rest = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict({**rest, "set": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return run


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double") + 0.5) / float(np.log(CLASS_RATIO))).cast("int")


def _class_begin(c: Column) -> Column:
    """No size in the class is smaller."""
    return F.greatest(F.lit(1.0), F.floor(F.exp(c * float(np.log(CLASS_RATIO))) - 1.5))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of these sizes must share: ceil(t / (1 + t) * (n + m)); sizes may be lower bounds."""
    return F.ceil(F.lit(float(percent)) * (n + m) / float(100 + percent) - 1e-6)


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """r, s: pairs of sets in different components whose prefixes share as many shingles as r asks for."""
    n, size_class = F.col("n"), _size_class(F.col("n"))
    lowest = F.greatest(F.lit(1.0), F.ceil(n * percent / 100.0))
    level = F.greatest(F.lit(1), F.col("pos") - (n - F.col("least"))).cast("int")
    index = lists.withColumns({"class": size_class, "least": _overlap(n, n, percent)}).withColumn("level", level).where(F.col("level") <= LEVELS)
    probe = lists.withColumn("class", F.explode(F.sequence(_size_class(lowest), size_class)))
    probe = probe.withColumn("least", _overlap(n, F.greatest(lowest, _class_begin(F.col("class"))), percent)).withColumn("level", level).where(F.col("level") <= LEVELS)
    keys, levels = ["token", "class"], range(1, LEVELS + 1)
    # A set can share k shingles in its prefix of level k only if so many of them stand in other prefixes at all.
    able = index.groupBy("doc_id").agg(*[F.count(F.when(F.col("level") <= k, 1)).alias(f"able{k}") for k in levels])
    index = index.join(able, "doc_id").withColumn("fit", F.array(*[(F.col("level") <= k) & (F.col(f"able{k}") >= k) for k in levels]))
    index = written(index.where(F.exists("fit", lambda x: x)).select(*keys, "doc_id", "n", "pos", "component", "fit"), "index-lists")
    own = written(index.groupBy(*keys, "component").agg(*[F.count(F.when(F.get("fit", F.lit(k - 1)), 1)).alias(f"own{k}") for k in levels]), "list-sizes")
    whole = own.groupBy(*keys).agg(*[F.sum(f"own{k}").alias(f"all{k}") for k in levels])
    # What counts is only what a list holds of other components.
    probe = probe.join(whole, keys).join(own, [*keys, "component"], "left").withColumns(
        {f"index{k}": F.col(f"all{k}") - F.coalesce(f"own{k}", F.lit(0)) for k in levels})
    probe = written(probe.where(F.greatest(*[f"index{k}" for k in levels]) > 0).select(
        *keys, "doc_id", "n", "pos", "level", "component", *[f"index{k}" for k in levels]), "probes")
    cost = [F.sum(F.when(F.col("level") <= k, F.col(f"index{k}")).otherwise(0)) for k in levels]
    # Rows of the join, and pairs of which each takes k rows at least, weighted by their verification.
    choice = [F.struct((c + VERIFY_COST * c / k).alias("cost"), F.lit(k).alias("need")) for k, c in enumerate(cost, 1)]
    chosen = probe.groupBy("doc_id", "n").agg(F.array_min(F.array(*choice))["need"].alias("need")).select(
        "doc_id", F.when(F.col("n") >= LEAST_SIZE, F.least("need", lowest.cast("int"))).otherwise(1).alias("need"))
    asked = probe.join(chosen, "doc_id").where("level <= need").select(
        *keys, F.col("doc_id").alias("r"), F.col("n").alias("n_r"), F.col("pos").alias("i"), F.col("component").alias("c_r"), "need")
    enough = asked.groupBy("r", "class").agg(F.count("*").alias("has"), F.first("need").alias("least")).where("has >= least").select("r", "class")
    asked = asked.join(enough, ["r", "class"], "left_semi")
    held = index.select(*keys, F.col("doc_id").alias("s"), F.col("n").alias("n_s"), F.col("pos").alias("j"), F.col("component").alias("c_s"), "fit")
    # The first shingles that a similar pair shares, as many as r needs, all leave room for the rest of its overlap.
    most = F.least("i", "j", "need") + F.least(F.col("n_r") - F.col("i"), F.col("n_s") - F.col("j"))
    met = (F.col("c_r") != F.col("c_s")) & F.get("fit", F.col("need") - 1) & (
        (F.col("n_s") < F.col("n_r")) | ((F.col("n_s") == F.col("n_r")) & (F.col("s") < F.col("r")))) & (
        100 * F.col("n_s") >= percent * F.col("n_r")) & (most >= _overlap(F.col("n_r"), F.col("n_s"), percent))
    pairs = asked.hint("shuffle_merge").join(held, [asked[k] == held[k] for k in keys] + [met]).groupBy("r", "s", "need").agg(F.count("*").alias("shared"))
    return pairs.where("shared >= need").select("r", "s")


def similar_components(docs: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    A document's set has its distinct shingles of width words; with fewer words the whole
    sequence is one. Two documents link when their sets' Jaccard similarity is percent
    or more; component_id is the smallest doc_id reachable by links, itself included.
    Documents without words, or null text, have no shingle and link with nothing.

    Rows without doc_id link with nothing and have no component. Of rows that repeat a
    doc_id one counts for all, the one with the first text in order (null last).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = written(rows.mapInArrow(_signatures(width), "doc_id bigint, n bigint, print binary, row int, cells binary"), "signatures")
    signed = table.where("row IS NULL").select("doc_id", "n", "print")
    repeated = written(signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not repeated.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        again = rows.join(repeated, "doc_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        rows = rows.join(repeated, "doc_id", "left_anti").unionByName(again)
        once = again.mapInArrow(_signatures(width), "doc_id bigint, n bigint, print binary, row int, cells binary").where("row IS NULL")
        counted = written(signed.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").unionByName(once.select("doc_id", "n", "print")), "signatures")
    else:
        counted = signed.where("doc_id IS NOT NULL")
    same = written(counted.where("n > 0").groupBy("n", "print").agg(F.min("doc_id").alias("lead")), "leads")
    led = written(counted.join(same, ["n", "print"], "left").select("doc_id", "n", F.coalesce("lead", "doc_id").alias("lead")), "led")
    copies = written(led.where("doc_id <> lead OR n = 0").select("doc_id"), "copies")
    single = rows.where("doc_id IS NOT NULL").join(small(copies), "doc_id", "left_anti")

    shared = spark.sparkContext.broadcast(_sketch(table))
    prefixes = written(single.mapInArrow(_prefixes(width, percent, shared), "doc_id bigint, n int, token bigint, pos int"), "prefixes")
    # Most shingles stand in one prefix only: a bare count sorts them out before wider rows are grouped.
    held = prefixes.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token")
    lists = written(prefixes.join(held, "token"), "prefix-lists")
    middle = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "doc_id")).alias("centre")).select("token", F.col("centre.doc_id").alias("centre"), F.col("centre.n").alias("m"))

    # One central set for each set: the one in which most of its lists begin earliest.
    # Similar sets of LEAST_SIZE shingles or more share LEVELS of them in these prefixes, so fewer votes are in vain.
    fits = (F.col("doc_id") != F.col("centre")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    votes = lists.join(middle, "token").where(fits).groupBy("doc_id", "centre").agg(F.count("*").alias("votes"), F.min(F.least("n", "m")).alias("least"))
    votes = votes.where((F.col("votes") >= LEVELS) | (F.col("least") < LEAST_SIZE))
    best = written(votes.groupBy("doc_id").agg(F.max_by("centre", F.struct("votes", -F.col("centre"))).alias("centre")), "centres")
    to = best.select("doc_id", F.col("centre").alias("at"), F.lit(False).alias("own")).unionByName(
        best.select(F.col("centre").alias("doc_id"), F.col("centre").alias("at"), F.lit(True).alias("own")).distinct())
    sets = written(single.join(small(written(to, "to-centre")), "doc_id").mapInArrow(_sets(width), "doc_id bigint, at bigint, own boolean, set array<bigint>"), "sets")
    centres = sets.where("own").select("at", F.col("set").alias("other"))
    near = sets.where("NOT own").join(centres, "at").where(_similar(F.col("set"), F.col("other"), percent))
    found = components(written(near.select(F.col("doc_id").alias("a"), F.col("at").alias("b")), "near-centres"))

    placed = lists.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    pairs = written(_cross_pairs(written(placed.select("doc_id", "n", "token", "pos", "component"), "placed-lists"), percent), "pairs")
    asked = written(pairs.select(F.col("r").alias("doc_id")).unionByName(pairs.select(F.col("s").alias("doc_id"))).distinct(), "asked")
    wanted = written(single.join(small(asked), "doc_id").mapInArrow(_sets(width), "doc_id bigint, set array<bigint>"), "sets")
    left, right = wanted.select(F.col("doc_id").alias("r"), F.col("set").alias("a")), wanted.select(F.col("doc_id").alias("s"), F.col("set").alias("b"))
    linked = pairs.join(left, "r").join(right, "s").where(_similar(F.col("a"), F.col("b"), percent)).select("r", "s")
    of = found.select(F.col("id"), "component")
    across = linked.join(of.select(F.col("id").alias("r"), F.col("component").alias("c_r")), "r", "left").join(
        of.select(F.col("id").alias("s"), F.col("component").alias("c_s")), "s", "left")
    merged = components(across.select(F.coalesce("c_r", "r").alias("a"), F.coalesce("c_s", "s").alias("b")))
    joined = led.join(of.withColumnRenamed("id", "lead").withColumnRenamed("component", "c1"), "lead", "left").withColumn("c1", F.coalesce("c1", "lead"))
    joined = joined.join(merged.withColumnRenamed("id", "c1").withColumnRenamed("component", "c2"), "c1", "left")
    result = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c2", "c1").alias("component_id"))
    ids = signed.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("n")).alias("_n"))
    if repeated.isEmpty():
        return result.unionByName(ids.where("doc_id IS NULL").select("doc_id", F.col("_n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")))
    return ids.join(result, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", "_n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose component has a smaller doc_id; other columns stay. Rows without doc_id stay."""
    found = similar_components(docs, width=width, percent=percent)
    drop = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    return docs.join(small(drop), docs["doc_id"].cast("bigint") == drop["_id"], "left_anti")
