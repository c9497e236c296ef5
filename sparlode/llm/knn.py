"""Operator 1, exact k-nearest-neighbour join by Voronoi partitioning (Lu et al. 2012).

Pivots, a sample of the data, cut the space into Voronoi cells. For each cell a summary is kept: how many vectors, the least
and greatest distance to the pivot, and the k + 1 least ones. From the summaries alone comes, for each query cell, a bound
theta that the distance to the k-th neighbour of none of its queries exceeds, tightened by the true distances of the queries to a
bounded sample of the data; a data vector s of another cell is sent to the query cell only if the triangle inequality lets it lie
within theta of some query there. Cells are put together to blocks of some ten thousand queries, so one replica of a data vector
serves many queries, and the candidates of a block are cut into slices by the hash of their id. Each task meets its candidates as a
stream: it holds one block and its best k so far, however many come. The bests of the slices are merged last.

Neighbours are exact: candidates are compared in single precision with a margin, and what is within it again in double
precision. Where distances don't concentrate few vectors travel; where they do (random high-dimensional ones) the bounds
prune little, and no exact method can avoid it: the join then costs queries times data in multiplications, over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, drop_path, need, save, whole_id


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows, summed over the dimensions in their order."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        x = a[..., d] - b[..., d]
        total += x * x
    return np.sqrt(total)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = -2.0 * (a @ b.T)
    out += np.einsum("ij,ij->i", a, a)[:, None]
    out += np.einsum("ij,ij->i", b, b)[None, :]
    return out


def usable(rows: DataFrame, id: str, vector: str, dim: int | None, kind: str) -> tuple[DataFrame, int]:
    """(id, vec) with one row for each id, of the vectors of ``dim`` numbers under 1e100 in size (default: the most common length)."""
    v = col(vector).cast(kind)
    r = rows.select(whole_id(rows, id).alias("id"), v.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    if dim is None:
        first = r.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = first[0] if first else 1
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100))
    return r.filter((F.size("vec") == dim) & fine).groupBy("id").agg(F.min("vec").alias("vec")), dim


def kth_of_sample(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    """For each row a distance that that to its k-th neighbour doesn't exceed; infinite if the sample is too small."""
    out = np.full(len(x), np.inf)
    for lo in range(0, len(x), 2048):
        sq = _squares(x[lo : lo + 2048], sample)
        # The error of the product, with room.
        sq += 1e-12 * (np.einsum("ij,ij->i", x[lo : lo + 2048], x[lo : lo + 2048])[:, None] + np.einsum("ij,ij->i", sample, sample)[None, :])
        if exclude_self:
            sq[ids[lo : lo + 2048, None] == sample_ids[None, :]] = np.inf
        if sq.shape[1] >= k:
            out[lo : lo + 2048] = np.sqrt(np.maximum(np.partition(sq, k - 1, axis=1)[:, k - 1], 0))
    return out


def _assign(dim: int, pivots: np.ndarray, sample: tuple | None = None, k: int = 1, exclude_self: bool = False):
    """Batches of (id, vec) to (id, vec, cell, to_pivot, upper). Without a sample upper is infinite."""

    def assign(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b.column(1), dim)
            cell = np.empty(len(x), dtype=np.int32)
            for lo in range(0, len(x), 4096):
                cell[lo : lo + 4096] = _squares(x[lo : lo + 4096], pivots).argmin(axis=1)
            upper = np.full(len(x), np.inf) if sample is None else kth_of_sample(b.column(0).to_numpy(), x, *sample, k, exclude_self)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(distances(x, pivots[cell])), pa.array(upper)], names=["id", "vec", "cell", "to_pivot", "upper"])

    return assign


def bounds(pivots: np.ndarray, query: dict[int, tuple], data: dict[int, list[float]], k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """(theta of each cell, distances between pivots). query: cell to (greatest distance to the pivot, count, bound from the sample); data: cell to
    its least distances."""
    between = distances(pivots[:, None, :], pivots[None, :, :])
    theta = np.full(len(pivots), -1.0)
    cells = np.array([c for c, near in data.items() for _ in near], dtype=np.int64)
    near = np.array([d for x in data.values() for d in x])
    want = k + exclude_self
    for c, (most, _, sampled) in query.items():
        upper = most + between[c, cells] + near
        found = np.partition(upper, want - 1)[want - 1] if len(upper) >= want else np.inf
        theta[c] = min(found, sampled) * (1 + 1e-9) + 1e-9
    return theta, between


def blocks_of(between: np.ndarray, counts: dict[int, int], size: int) -> tuple[dict[int, tuple[int, int]], list[list[int]]]:
    """Cell to (first block, how many), and the cells of each block: a cell of over ``size`` queries is cut into several blocks,
    small ones share a block with cells whose pivots are near."""
    left, chain = set(counts), []
    while left:
        c = min(left, key=lambda x: (between[chain[-1], x], x)) if chain else min(left)
        chain.append(c)
        left.remove(c)
    of: dict[int, tuple[int, int]] = {}
    members: list[list[int]] = []
    room = 0
    for c in chain:
        if counts[c] > size:
            many = math.ceil(counts[c] / size)
            of[c] = (len(members), many)
            members += [[c]] * many
            room = 0
        else:
            if counts[c] > room:
                members.append([])
                room = size
            members[-1] = [*members[-1], c]
            of[c] = (len(members) - 1, 1)
            room -= counts[c]
    return of, members


def slice_of(ids: np.ndarray, slices: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)


def replicate(theta: np.ndarray, between: np.ndarray, query: dict[int, tuple], members: list[list[int]], slices: int):
    """Data rows to the blocks that they may matter to; ``part`` is block * slices + slice."""
    cells = sorted(query)

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            home, d = b.column(2).to_numpy(), b.column(3).to_numpy()
            own = slice_of(b.column(0).to_numpy(), slices)
            need = {c: (np.abs(between[c, home] - d) - query[c][0] <= theta[c]) | (home == c) for c in cells}
            for block, inside in enumerate(members):
                send = np.nonzero(np.logical_or.reduce([need[c] for c in inside]))[0]
                if len(send):
                    part = b.take(pa.array(send))
                    yield pa.RecordBatch.from_arrays([pa.array(block * slices + own[send]), pa.array(np.ones(len(send), dtype=np.int8)), part.column(0), part.column(1)], names=["part", "side", "id", "vec"])

    return run


class _Block:
    """The queries of one block and their best k so far."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.vecs, self.k, self.exclude = ids, vecs, k, exclude_self
        self.near = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.norm = np.einsum("ij,ij->i", vecs, vecs)

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        for lo in range(0, len(self.ids), 4096):
            self._add(slice(lo, lo + 4096), ids, vecs)

    def _add(self, at: slice, ids: np.ndarray, vecs: np.ndarray) -> None:
        """The queries of one part of the block against some data."""
        norm, own = np.einsum("ij,ij->i", vecs, vecs), self.norm[at]
        # The error of single precision, with room: some units of 2**-23 of the squares for each of the dimensions.
        margin = 2.0**-20 * math.sqrt(vecs.shape[1]) * (own.max() + norm.max()) + 1e-30
        kind = np.float32 if max(own.max(), norm.max()) < 1e30 else np.float64
        sq = self.vecs[at].astype(kind) @ vecs.astype(kind).T
        sq *= -2
        sq += norm.astype(kind)[None, :]
        limit = (np.square(self.near[at, -1]) - own + margin).astype(kind)
        if len(ids) > 4 * self.k and np.isinf(limit).any():
            first = np.partition(sq, self.k, axis=1)[:, self.k]
            limit = np.minimum(limit, first + kind(2 * margin))
        q, c = np.nonzero(sq <= limit[:, None])
        q += at.start
        if self.exclude:
            other = self.ids[q] != ids[c]
            q, c = q[other], c[other]
        for lo in range(0, len(q), 500_000):
            self._merge(q[lo : lo + 500_000], c[lo : lo + 500_000], ids, vecs)

    def _merge(self, q, c, ids, vecs) -> None:
        d, w = distances(self.vecs[q], vecs[c]), ids[c]
        fine = (d < self.near[q, -1]) | ((d == self.near[q, -1]) & (w < self.who[q, -1]))
        q, d, w = q[fine], d[fine], w[fine]
        if not len(q):
            return
        rows = np.unique(q)
        q = np.concatenate([q, np.repeat(rows, self.k)])
        d = np.concatenate([d, self.near[rows].ravel()])
        w = np.concatenate([w, self.who[rows].ravel()])
        order = np.lexsort((w, d, q))
        q, d, w = q[order], d[order], w[order]
        start = np.searchsorted(q, rows)
        take = start[:, None] + np.arange(self.k)
        self.near[rows], self.who[rows] = d[take], w[take]

    def rows(self) -> pa.RecordBatch:
        there = np.isfinite(self.near)
        q, r = np.nonzero(there)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array((r + 1).astype(np.int32)), pa.array(self.who[q, r]), pa.array(self.near[q, r])], names=["query_id", "rank", "neighbor_id", "distance"])


def _solve(dim: int, k: int, exclude_self: bool):
    """Rows sorted by part, queries (side 0) before data (side 1)."""

    def solve(batches):
        block, now, ids, vecs = None, None, [], []

        def close():
            nonlocal block
            if block is None and ids:
                block = _Block(np.concatenate(ids), np.concatenate(vecs), k, exclude_self)
            if block is not None:
                yield block.rows()

        for b in batches:
            if b.num_rows == 0:
                continue
            of, side, who = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            x = _matrix(b.column(3), dim)
            edges = np.nonzero(np.diff(of) | np.diff(side))[0] + 1
            for s, e in zip(np.r_[0, edges], np.r_[edges, len(of)], strict=True):
                if of[s] != now:
                    yield from close()
                    block, now, ids, vecs = None, of[s], [], []
                if side[s] == 0:
                    ids.append(who[s:e])
                    vecs.append(x[s:e])
                else:
                    if block is None and ids:
                        block = _Block(np.concatenate(ids), np.concatenate(vecs), k, exclude_self)
                    if block is not None:
                        for lo in range(s, e, 4096):
                            block.add(who[lo : min(e, lo + 4096)], x[lo : min(e, lo + 4096)])
        yield from close()

    return solve


def knn_join(
    spark: SparkSession, queries: DataFrame, data: DataFrame | None = None, *, k: int = 10, id: str = "vec_id", vector: str = "embedding",
    exclude_self: bool | None = None, pivots: int | None = None, block: int | None = None, slice_bytes: int = 256 << 20, dim: int | None = None,
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest data rows of every query, by Euclidean distance, exact.

    Without ``data`` the queries are searched among themselves. With ``exclude_self`` (default: without data) a row of the query's
    own id is no neighbour. Null id, null vector, vectors of another length than ``dim`` (default: the most common), with nulls,
    NaN, infinities or numbers of 1e100 or more: neither query nor neighbour. Ties: the lesser id. Repeated ids: one row, that
    with the least vector. Fewer than k others: all of them. Empty table: no rows. There are no texts; extra columns don't
    matter. Ids must be whole numbers. At most ``pivots`` pivots (default: the root of the data's rows, from 16 to 512), 16 times as
    many sampled vectors and as many summaries of k + 1 distances go to the driver. ``block``: queries of a block (default: 64 MB of them).
    """
    need(queries, id, vector)
    own = data is None
    exclude = own if exclude_self is None else exclude_self
    kinds = {x.schema[vector].dataType.simpleString() for x in (queries, data) if x is not None}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    q, dim = usable(queries, id, vector, dim, kind)
    q, q_path = save(spark, q, "knn-queries")
    d, d_path = (q, None) if own else save(spark, usable(data, id, vector, dim, kind)[0], "knn-data")
    schema = "query_id long, rank int, neighbor_id long, distance double"
    n = d.count()
    pivots = pivots or min(512, max(16, math.isqrt(n)))
    sample = d.orderBy(F.xxhash64("id"), "id").limit(16 * pivots).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    near = (np.array([r[0] for r in sample], dtype=np.int64), np.array([r[1] for r in sample], dtype=np.float64))
    p = np.unique(near[1][:pivots], axis=0)
    cells = f"id long, vec {kind}, cell int, to_pivot double, upper double"
    qa, qa_path = save(spark, q.mapInArrow(_assign(dim, p, near, k, exclude), cells), "knn-query-cells")
    da, assigned_path = (qa, None) if own else save(spark, d.mapInArrow(_assign(dim, p), cells), "knn-data-cells")
    q_sum = {r[0]: (r[1], r[2], r[3]) for r in qa.groupBy("cell").agg(F.max("to_pivot"), F.count("*"), F.max("upper")).collect()}
    ranked = da.select("cell", "to_pivot", F.row_number().over(Window.partitionBy("cell").orderBy("to_pivot", "id")).alias("n")).filter(F.col("n") <= k + 1)
    d_sum = {r[0]: list(r[1]) for r in ranked.groupBy("cell").agg(F.collect_list("to_pivot")).collect()}
    theta, between = bounds(p, q_sum, d_sum, k, exclude)
    of, members = blocks_of(between, {c: x[1] for c, x in q_sum.items()}, block or max(1, (64 << 20) // (4 * dim)))
    if not members:
        return spark.createDataFrame([], schema)
    slices = max(math.ceil(n * dim * 4 / slice_bytes), math.ceil(spark.sparkContext.defaultParallelism / len(members)))
    first = F.create_map(*(F.lit(x) for c, (f, _) in of.items() for x in (c, f)))
    many = F.create_map(*(F.lit(x) for c, (_, m) in of.items() for x in (c, m)))
    home = (first[F.col("cell")] + F.pmod(F.xxhash64("id"), many[F.col("cell")])).cast("long")
    left = qa.select(F.explode(F.sequence(home * slices, home * slices + slices - 1)).alias("part"), F.lit(0).cast("byte").alias("side"), "id", "vec")
    right = da.mapInArrow(replicate(theta, between, q_sum, members, slices), f"part long, side byte, id long, vec {kind}")
    tasks = max(1, min(len(members) * slices, 10_000))
    solved = left.unionByName(right).repartition(tasks, "part").sortWithinPartitions("part", "side").mapInArrow(_solve(dim, k, exclude), schema)
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    merged = solved.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out, _ = save(spark, merged.select("query_id", "rank", "neighbor_id", "distance"), "knn")
    for x in (q_path, d_path, qa_path, assigned_path):
        if x:
            drop_path(spark, x)
    return out
