"""Exact cosine top-k over a table stored by cells, reading only cells that can hold a match.

Every row lies in the cell of its nearest centre, and a cell knows its radius, the largest
angle between its centre and a row. A row of a cell is at least (angle to the centre -
radius) away from a query, by the triangle inequality on angles. So a query reads its
nearest cells first, and then only those whose bound reaches its k-th best score so far.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from nearshelf import fixed_values as V
from nearshelf.functions import blocks
from nearshelf.operators.search import (
    BROADCAST_BYTES, _final_rank, _usable_queries, narrow_hits, query_chunks, usable_vectors, with_floors, with_payload,
)
from nearshelf.session import work_folder

#: Rows that the centres are fitted on, at most, and the most cells of a table.
SAMPLE_ROWS, MOST_CELLS = 50_000, 4_096
#: Angles of nearly equal vectors are known to this precision only.
ANGLE_ERROR = 1e-6
#: Each round of a search reads this many times as many cells as the one before.
WIDER = 4


def _centres(rows: DataFrame, n: int, dim: int, cells: int, seed: int) -> np.ndarray:
    """Unit vectors of a k-means over a sample of bounded size."""
    sample = rows.select("embedding").sample(min(1.0, 1.2 * SAMPLE_ROWS / max(1, n)), seed).limit(SAMPLE_ROWS)
    sample = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=5, seed=seed).fit(sample)
    found = np.array(model.clusterCenters()).reshape(-1, dim)
    lengths = np.linalg.norm(found, axis=1)
    return found[lengths > 0] / lengths[lengths > 0, None]


def write_cells(catalog: DataFrame, path: str, *, dim: int, cells: int | None = None, seed: int = 1) -> None:
    """Stores catalog (id, embedding and other columns) by cells under path.

    Rows without a usable vector are left out, as no search finds them. The centres are
    fitted on SAMPLE_ROWS rows; every row is assigned to one. By default there are about as many
    cells as rows in a cell. A cell with very many rows is several files.
    """
    spark = catalog.sparkSession
    rows = usable_vectors(catalog, "embedding", dim)
    n = rows.count()
    room = min(MOST_CELLS, BROADCAST_BYTES // (8 * dim))
    wanted = max(1, min(room, cells or round(math.sqrt(n))))
    centres = _centres(rows, n, dim, wanted, seed) if n and wanted > 1 else np.eye(1, dim)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            near = blocks.unit_rows(batch.column("embedding"), dim) @ shared.value.T
            best = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(best.astype(np.int32))],
                                             [*batch.schema.names, "angle", "cell"])

    schema = T.StructType([*rows.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    # Adaptive execution parts a cell that is too large for one task.
    rows.mapInArrow(assign, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    # One row per cell; the centres went to every task already.
    sizes = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell INT, centre ARRAY<DOUBLE>")
    known.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str, catalog_schema: T.StructType) -> DataFrame:
    """The stored rows, with their cell."""
    return spark.read.schema(T.StructType([*catalog_schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/rows")


def _bounds(vectors: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each query to each centre, and the highest cosine that a row of the cell can have."""
    angle = np.arccos(np.clip(vectors @ centres.T, -1, 1))
    return angle, np.cos(np.maximum(0, angle - radius[None, :] - ANGLE_ERROR))


def cosine_topk_cells(queries: DataFrame, path: str, catalog_schema: T.StructType, k: int, *, dim: int, payload: tuple[str, ...] = (),
                      digits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """cosine_topk over a table that write_cells stored. Same rows, same order.

    Queries go to the stored rows in chunks of bounded size. A chunk needs a few
    rounds; each reads the next nearest cells of its queries that can still hold a match.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # MOST_CELLS rows at most
    stored = read_cells(spark, path, catalog_schema)
    q = _usable_queries(queries, dim)
    out = narrow_hits(q, stored)
    folder = work_folder(spark, "hits")
    spark.createDataFrame([], out).write.parquet(f"{folder}/part=none")
    number = cells.column("cell").to_numpy()
    centres = np.array(cells.column("centre").to_pylist(), np.float64).reshape(-1, dim)
    radius, size = cells.column("radius").to_numpy(), cells.column("n").to_numpy()
    # A query brings a vector, a number per hit and a bit per cell.
    rows = max(1, broadcast_bytes // (8 * dim + 16 * k + 2 * len(number) + 1))
    for at, table in enumerate(query_chunks(q, rows)):
        if table.num_rows and len(number):
            _search_chunk(stored, table, number, centres, radius, size, out, f"{folder}/part={at}", k, dim, digits)
    hits = spark.read.schema(T.StructType([*out.fields, T.StructField("part", T.StringType())])).parquet(folder).drop("part")
    return with_payload(_final_rank(hits, k, []), stored, list(payload))


def _search_chunk(stored: DataFrame, table: pa.Table, number, centres, radius, size, out: T.StructType, folder: str,
                  k: int, dim: int, digits: int | None) -> None:
    spark = stored.sparkSession
    off = (V.PRICE_MIN_OFF, V.PRICE_MAX_OFF)
    bare = blocks.query_block(with_floors(table, None, k), ["query_id", "variant_no"], dim, off)
    angle, bound = _bounds(bare.vectors, centres, radius)
    bound += 1e-9 + (0.5 * 10.0 ** -digits if digits is not None else 0)
    order = np.argsort(angle, axis=1, kind="stable")
    # The nearest cells that hold k rows together.
    first = (np.cumsum(size[order], axis=1) < k).sum(axis=1) + 1
    read, floored, widen = np.zeros(angle.shape, bool), with_floors(table, None, k), 1
    while True:
        floors = floored.column("floor").to_numpy()
        ahead = ~read & (bound >= floors[:, None])
        if not ahead.any():
            return
        place = np.cumsum(np.take_along_axis(ahead, order, axis=1), axis=1)
        chosen = np.zeros_like(ahead)
        np.put_along_axis(chosen, order, place <= (first * widen)[:, None], axis=1)
        chosen &= ahead
        read |= chosen
        wide = np.zeros((len(chosen), int(number.max()) + 1), bool)
        wide[:, number] = chosen
        # The query block travels as its Arrow table; its unit vectors are made once per task.
        shared = spark.sparkContext.broadcast((floored, wide))

        def search(batches):
            asking, wanted = shared.value
            block = blocks.query_block(asking, ["query_id", "variant_no"], dim, off)
            yield from blocks.best_of_cells(batches, block, wanted.copy(), k, dim, digits, out.names)

        asked = [int(c) for c in number[chosen.any(axis=0)]]
        rows = stored.where(F.col("cell").isin(asked)).select("id", F.col("price").cast("double").alias("price"), "embedding", "cell")
        rows.mapInArrow(search, out).write.mode("append").parquet(folder)
        floored = with_floors(table, spark.read.schema(out).parquet(folder), k)
        widen *= WIDER
