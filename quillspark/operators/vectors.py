"""Exact cosine neighbours of a stated set of queries: vectors are scanned once, in blocks of queries of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
COSINE, NEIGHBOURS = 0.92, 32
#: Query vectors that are sent to the tasks at once.
QUERIES = 4096


def _usable(v: str) -> Column:
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(i, j, similarity, rank): the k rows of highest cosine for each query, itself included, ties to the smaller id.

    Each task keeps the k best of what it scans for each query; those meet by query. A zero vector has similarity 0 with all."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & _usable("v"))
    k = max(2, k)
    out = None
    n = rows.where("asks").count()
    for turn in range(n // QUERIES + 1):
        block = rows.where("asks").where(F.pmod(F.xxhash64("id"), F.lit(n // QUERIES + 1)) == turn).select("id", "v").collect()
        if not block:
            continue
        found = rows.select("id", "v").mapInArrow(_best(np.array([r.id for r in block]), _unit(np.array([r.v for r in block])), k), "i long, j long, similarity double")
        out = found if out is None else out.union(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "i long, j long, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _best(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                j, x = np.array(b.column(0)), _unit(np.array(b.column(1).to_pylist(), np.float64))
                sim = np.round(q @ x.T, 12)
                order = np.lexsort((np.broadcast_to(j, sim.shape), -sim), axis=1)[:, :k]
                yield pa.RecordBatch.from_pydict({"i": np.repeat(ids, order.shape[1]), "j": j[order].ravel(), "similarity": np.take_along_axis(sim, order, 1).ravel()})

    return run


def similar_pairs(neighbours: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(i, j, similarity) with j > i of neighbours that are similar enough; a pair counts if i's list has j."""
    return neighbours.where((F.col("j") > F.col("i")) & (F.col("similarity") >= threshold)).select("i", "j", "similarity").distinct()
