"""Approximate search by cells: an inverted file of vectors by their nearest centroid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .exact import BROADCAST_BYTES, rank_within, topk_in_groups, vectors_of, with_distance

#: Pairs of vectors and centroids whose distances a task holds at once.
_TILE = 1 << 19


def train(records: DataFrame, cells: int, iterations: int = 5, vector: str = "embedding", id: str = "id") -> np.ndarray:
    """Centroids by Lloyd's iterations over all records, from those of the least hashes; each iteration is one aggregation, and the
    driver holds the centroids only."""
    r = records.select(F.col(id).cast("long").alias("id"), V.as_vector(F.col(vector)).alias("v"))
    first = r.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    c = np.array([x["v"] for x in first], dtype=np.float64)
    for _ in range(iterations if len(c) else 0):
        shared = records.sparkSession.sparkContext.broadcast(c)

        def sums(batches, shared=shared):
            c = shared.value
            n, total = np.zeros(len(c), dtype=np.int64), np.zeros_like(c)
            for b in batches:
                if b.num_rows:
                    v = vectors_of(b.column(1))
                    near = nearest_cells(v, c, 1)[:, 0]
                    n += np.bincount(near, minlength=len(c))
                    np.add.at(total, near, v)
            there = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there]), pa.array(total[there].tolist(), type=pa.list_(pa.float64()))], names=["cell", "n", "total"])

        part = r.mapInArrow(sums, "cell long, n long, total array<double>")
        whole = part.select("cell", "n", F.posexplode("total").alias("d", "x")).groupBy("cell", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        c = c.copy()
        for x in whole.collect():  # cells times dimensions
            c[x["cell"], x["d"]] = x["x"] / x["n"]
    return c


def nearest_cells(v: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) numbers of the nearest centroids, of equals the first; near ties are settled by the exact order of sums. In tiles of _TILE pairs."""
    step = max(1, _TILE // max(1, len(centroids)))
    if len(v) > step:
        return np.concatenate([nearest_cells(v[lo : lo + step], centroids, n) for lo in range(0, len(v), step)])
    d = V.distance_matrix("l2", v, centroids)
    n = min(n, len(centroids))
    if n < len(centroids):
        slack = 1e-9 * (1 + np.abs(d).max(initial=0))
        limit = np.partition(d, n - 1, axis=1)[:, n - 1] + slack
        a, c = np.nonzero(d <= limit[:, None])
        exact = np.full_like(d, np.inf)
        exact[a, c] = V.distance_rows("l2", v[a], centroids[c])
        d = exact
    else:
        a, c = np.divmod(np.arange(d.size), d.shape[1])
        d = V.distance_rows("l2", v[a], centroids[c]).reshape(d.shape)
    return d.argsort(axis=1, kind="stable")[:, :n].copy()  # else all of it stays


def assign(records: DataFrame, centroids: np.ndarray, vector: str = "embedding", name: str = "cell") -> DataFrame:
    """Each record with the number of its nearest centroid (the first of equals), by matrix products over Arrow batches."""
    if centroids.size * 8 > BROADCAST_BYTES:
        raise ValueError("too many centroids")
    shared = records.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=np.float64).reshape(len(v), shared.value.shape[1])
        return pd.Series(np.concatenate([nearest_cells(x[k : k + 4096], shared.value, 1)[:, 0] for k in range(0, len(x), 4096)] or [[]]).astype(np.int32))

    return records.withColumn(name, cell(V.as_vector(F.col(vector))))


def assign_fast(records: DataFrame, centroids: np.ndarray, vector: str = "embedding", id: str = "id") -> DataFrame:
    """(id, cell) of each record."""
    return assign(records, centroids, vector).select(F.col(id).cast("long").alias("id"), "cell")


def probes(query: Sequence[float], centroids: np.ndarray, nprobe: int) -> list[int]:
    return nearest_cells(np.array([query], dtype=np.float64), centroids, nprobe)[0].tolist()


def search(assigned: DataFrame, query: Sequence[float], k: int, centroids: np.ndarray, nprobe: int = 4, metric: str = "cosine", vector: str = "embedding", id: str = "id") -> DataFrame:
    """(id, dist) of the k nearest within the ``nprobe`` nearest cells. A table partitioned by cell is pruned to those."""
    near = assigned.filter(F.col("cell").isin(probes(query, centroids, nprobe)))
    return with_distance(near, query, metric, vector).select(id, "dist").orderBy("dist", id).limit(k)


def batch_search(assigned: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobe: int = 4, metric: str = "cosine", vector: str = "embedding", id: str = "id") -> DataFrame:
    """(qid, rank, id, dist): each query (qid, vector) meets the records of its cells, cell by cell and in blocks of a large one."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=np.float64).reshape(len(v), shared.value.shape[1])
        return pd.Series([r for k in range(0, len(x), 4096) for r in nearest_cells(x[k : k + 4096], shared.value, nprobe).tolist()], dtype=object)

    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").alias("qv")).withColumn("g", F.explode(cells(V.as_vector(F.col("qv")))))
    r = assigned.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.col("cell").alias("g"))
    return rank_within(topk_in_groups(r, q, k, metric), k, "dist", "id").select("qid", "rank", "id", "dist")
