"""Exact nearest neighbours: one query, or a table of them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..storage_util import save

#: A query table of up to this many bytes is broadcast as one matrix.
BROADCAST_BYTES = 64 << 20
#: It is, if it wants up to so many rows.
BROADCAST_HITS = 1 << 18
#: A task of a pair join holds up to so many bytes of queries and their nearest, and meets up to so many records.
BLOCK_BYTES = 64 << 20
BLOCK_RECORDS = 1 << 20
#: Sizes of up to so many groups are broadcast.
_GROUPS = 200_000
#: Queries and records of one matrix product, and pairs whose distances are computed exactly at once.
_TILE = (512, 2048)
_PAIRS = 1 << 16


def with_distance(records: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "embedding", name: str = "dist") -> DataFrame:
    return records.withColumn(name, V.distance(metric, F.col(vector), query))


def topk(records: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", vector: str = "embedding", id: str = "id") -> DataFrame:
    """(id, dist): the k nearest, ties by id. A heap of k in each task, then one merge."""
    return with_distance(records.select(id, vector), query, metric, vector).select(id, "dist").orderBy("dist", id).limit(k)


def rank_within(pool: DataFrame, k: int | None, *order, by: str | None = "qid", name: str = "rank") -> DataFrame:
    """The first k rows of each ``by`` in the order, with their rank from 1; partial top-k before the shuffle."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    ranked = pool.withColumn(name, F.row_number().over(w.orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def batch_topk(
    records: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *, vector: str = "embedding", id: str = "id",
    qid: str = "qid", query_vector: str = "vector", exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(qid, rank, id, dist) for each query of the table.

    Queries of up to ``broadcast_bytes`` and up to BROADCAST_HITS wanted rows go to every task as one matrix, and a task keeps k rows for
    each query: the records are read once and only tasks x queries x k narrow rows are shuffled. A larger table meets the records block by
    block, see ``topk_in_groups``.
    """
    spark = records.sparkSession
    q = queries.select(F.col(qid).alias("qid"), F.col(query_vector).alias("qv"))
    size = q.agg(F.sum(F.size("qv") * 8), F.count("*")).first()
    if not size[1] or k < 1:
        return spark.createDataFrame([], "qid long, rank int, id long, dist double")
    r = records.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    if size[0] <= broadcast_bytes and size[1] * k <= BROADCAST_HITS:
        r, q = r.withColumn("v", V.as_vector(F.col("v"))), q.withColumn("qv", V.as_vector(F.col("qv")))
        near = r.mapInArrow(_matcher(spark, q, k, metric, exclude_self), "qid long, id long, dist double")
    else:
        near = topk_in_groups(r.withColumn("g", F.lit(0)), q.withColumn("g", F.lit(0)), k, metric, exclude_self)
    return rank_within(near, k, "dist", "id").select("qid", "rank", "id", "dist")


class _Side:
    """Vectors as the matrix products and the exact sums need them."""

    def __init__(self, metric: str, ids: np.ndarray, v: np.ndarray):
        v = np.asarray(v, dtype=np.float64)
        self.ids, self.t, self.odd = ids, np.ascontiguousarray(v.T), np.empty(0, dtype=np.int64)
        self.squares = np.zeros(len(ids))
        for x in self.t:
            self.squares += x * x
        self.m = v
        if metric == "cosine":
            # Products of unit vectors in single precision; squares that leave the range of doubles tell nothing of the direction.
            n = np.sqrt(self.squares)
            fine = (self.squares > 1e-280) & (self.squares < 1e280)
            self.odd = np.flatnonzero(~fine & (self.squares != 0))
            self.m = np.where(fine[:, None], v / np.where(fine, n, 1.0)[:, None], 0.0).astype(np.float32)


class _Best:
    """The k nearest so far of a few queries (at most _TILE[0])."""

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.q, self.k, self.metric, self.exclude = _Side(metric, qids, queries), k, metric, exclude_self
        self.minus = -2 * self.q.m if metric == "l2" else -self.q.m
        self.dist, self.who = np.full((len(qids), k), np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
        self.wait, self.waiting = [], 0

    def add(self, x: _Side, room: np.ndarray) -> None:
        """By a matrix product first, which is written to ``room``; what may be among the nearest is computed again in the exact order of sums."""
        q, k, dim = self.q, self.k, len(x.t)
        d = np.matmul(self.minus, x.m.T, out=room[: len(q.ids) * len(x.ids)].reshape(len(q.ids), len(x.ids)))
        if self.metric == "cosine":
            limit, slack = self.dist[:, -1] - 1, (dim + 8) * 2.0**-23
        elif self.metric == "ip":
            d -= (4 * (dim + 4) * 2.0**-53 * np.sqrt(q.squares.max(initial=0))) * np.sqrt(x.squares)
            limit, slack = self.dist[:, -1], 0.0
        else:
            share = 4 * (dim + 4) * 2.0**-53
            d += (q.squares * (1 - share))[:, None]
            d += x.squares * (1 - share)
            limit, slack = self.dist[:, -1], 0.0
        limit = (limit + slack).astype(d.dtype)
        hit = d <= limit[:, None]
        if len(x.ids) > 2 * k + 2 and np.count_nonzero(hit) > 2 * (k + 1) * len(d):
            hit &= d <= self._nearest_here(d, x, slack)[:, None]
        if len(q.odd):
            hit[q.odd] = True
        if len(x.odd):
            hit[:, x.odd] = True
        found = np.flatnonzero(hit)
        for lo in range(0, len(found), _PAIRS):
            a, c = np.divmod(found[lo : lo + _PAIRS], len(x.ids))
            if self.exclude:
                other = q.ids[a] != x.ids[c]
                a, c = a[other], c[other]
            e, i = self._exact(x, a, c), x.ids[c]
            nearer = (e < self.dist[a, -1]) | ((e == self.dist[a, -1]) & (i < self.who[a, -1]))
            if nearer.any():
                self.wait.append((a[nearer], e[nearer], i[nearer]))
                self.waiting += len(self.wait[-1][0])
                if self.waiting > self.dist.size // 2:
                    self._merge()

    def _nearest_here(self, d: np.ndarray, x: _Side, slack: float) -> np.ndarray:
        """What the k nearest of these records don't exceed: one more than k, as a query may be among them."""
        kth = np.partition(d, self.k, axis=1)[:, self.k]
        if self.metric == "cosine":
            return kth + d.dtype.type(2 * slack)
        # The products are lower bounds: what they leave out is added twice.
        most = x.squares.max() if self.metric == "l2" else np.sqrt(x.squares.max() * self.q.squares.max())
        return kth + 16 * (len(x.t) + 4) * 2.0**-53 * (most + (self.q.squares if self.metric == "l2" else 0.0))

    def _exact(self, x: _Side, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The distances of pairs, as V.distance_rows has them."""
        total = np.zeros(len(a))
        for p, r in zip(self.q.t, x.t, strict=True):
            total += (r[c] - p[a]) ** 2 if self.metric == "l2" else r[c] * p[a]
        if self.metric == "l2":
            return total
        if self.metric == "ip":
            return -total
        na, nb = x.squares[c], self.q.squares[a]
        n = np.sqrt(na) * np.sqrt(nb)
        return np.where((na == 0) | (nb == 0), 1.0, 1 - total / np.where(n == 0, 1.0, n))

    def _merge(self) -> None:
        if self.wait:
            _keep(self.dist, self.who, self.k, *(np.concatenate(x) for x in zip(*self.wait, strict=True)))
        self.wait, self.waiting = [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._merge()
        a, c = np.nonzero(np.isfinite(self.dist))
        return self.q.ids[a], self.who[a, c], self.dist[a, c]


class _Block:
    """The same for any number of queries, tile by tile: what it holds beside the queries and their nearest doesn't grow with them."""

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, metric: str, exclude_self: bool):
        step, self.room = _TILE[0], None
        self.metric, self.tiles = metric, [_Best(qids[lo : lo + step], queries[lo : lo + step], k, metric, exclude_self) for lo in range(0, len(qids), step)]

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        if self.room is None:
            self.room = np.empty(_TILE[0] * _TILE[1], dtype=np.float32 if self.metric == "cosine" else np.float64)
        for lo in range(0, len(ids), _TILE[1]):
            x = _Side(self.metric, ids[lo : lo + _TILE[1]], v[lo : lo + _TILE[1]])
            for t in self.tiles:
                t.add(x, self.room)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for t in self.tiles:
            rows = t.rows()
            for lo in range(0, len(rows[0]), _PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + _PAIRS]) for x in rows], names=["qid", "id", "dist"])


def vectors_of(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matcher(spark: SparkSession, q: DataFrame, k: int, metric: str, exclude_self: bool):
    rows = q.orderBy("qid").toArrow()
    qids = rows.column("qid").to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast(vectors_of(rows.column("qv")))

    def match(batches):
        best = _Block(qids, shared.value, k, metric, exclude_self)
        for b in batches:
            if b.num_rows:
                best.add(b.column(0).to_numpy(), vectors_of(b.column(1)))
        yield from best.batches()

    return match


def topk_in_groups(records: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool = False, block: int | None = None) -> DataFrame:
    """(qid, id, dist): for each query (qid, qv, g) at least the k nearest of the records (id, v, g) of its groups.

    The queries of a group are cut into blocks by the hash of the id, of BLOCK_BYTES with their nearest at most (or of ``block`` queries), and as
    small as it takes to busy all cores; its records into blocks of BLOCK_RECORDS. Each pair of blocks is a unit of its own: its task holds
    the queries, the records stream by, and k rows leave it for each query. So a group of any size fits, and a record is shuffled once for each block of queries.
    """
    spark = records.sparkSession
    kind = "array<float>" if dict(records.dtypes)["v"] == dict(queries.dtypes)["qv"] == "array<float>" else "array<double>"
    r, q = records.withColumn("v", F.col("v").cast(kind)), queries.withColumn("qv", F.col("qv").cast(kind))
    n = r.groupBy("g").agg(F.count("*").alias("rows")).join(q.groupBy("g").agg(F.count("*").alias("asked"), F.max(F.size("qv")).alias("dim")), "g")
    n = save(n, "group-sizes")
    pairs, groups = n.agg(F.coalesce(F.sum(F.col("rows").cast("double") * F.col("asked")), F.lit(0.0)), F.count("*")).first()
    each = pairs / (2 * spark.sparkContext.defaultParallelism)  # so many pairs to a unit
    most = F.lit(block) if block else F.greatest(F.lit(1), F.floor(BLOCK_BYTES / (12 * F.col("dim") + 32 * k)))
    fair = most if block else F.least(most, F.greatest(F.lit(_TILE[0]), F.ceil(each / F.col("rows"))))
    n = n.select("g", F.ceil(F.col("rows") / (block or BLOCK_RECORDS)).cast("int").alias("rn"), F.ceil(F.col("asked") / fair).cast("int").alias("qn"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    few = groups <= _GROUPS  # narrow rows, numbered in one task
    n = n.withColumn("first", F.coalesce(F.sum(F.col("rn") * F.col("qn")).over(before), F.lit(0)) if few else F.pmod(F.xxhash64("g"), F.lit(_GROUPS)))
    n = save(n, "units")
    parts = max(1, min(_GROUPS // 10, n.agg(F.sum(F.col("rn") * F.col("qn"))).first()[0] or 1))
    n = F.broadcast(n) if few else n
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    unit = F.col("first") + F.col("qb") * F.col("rn") + F.col("rb")
    r = r.join(n, "g").select("g", "first", "rn", F.pmod(F.xxhash64("id"), "rn").alias("rb"), every("qn").alias("qb"), "id", "v")
    q = q.join(n, "g").select("g", "first", "rn", every("rn").alias("rb"), F.pmod(F.xxhash64("qid"), "qn").alias("qb"), F.col("qid").cast("long").alias("id"), F.col("qv").alias("v"))
    if few:
        at = lambda rows, side: rows.select((unit * 2 + side).cast("long").alias("at"), "id", "v")
    else:  # units have no numbers of their own then
        at = lambda rows, side: rows.select((F.xxhash64("g", "qb", "rb").bitwiseAND(F.lit((1 << 62) - 1)) * 2 + side).alias("at"), "id", "v")
    both = at(q, 0).union(at(r, 1)).repartitionById(parts, F.pmod(F.floor(F.col("at") / 2), F.lit(parts)).cast("int")).sortWithinPartitions("at")

    def match(batches):
        unit, held, best = None, [], None
        for b in batches:
            at, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
            for lo, hi in itertools.pairwise(cuts):
                if at[lo] >> 1 != unit:
                    if best is not None:
                        yield from best.batches()
                    unit, held, best = at[lo] >> 1, [], None
                v = vectors_of(b.column(2).slice(lo, hi - lo))
                if not at[lo] & 1:
                    held.append((ids[lo:hi], v))
                elif held:
                    if best is None:
                        best = _Block(*(np.concatenate(x) for x in zip(*held, strict=True)), k, metric, exclude_self)
                        held = [()]
                    best.add(ids[lo:hi], v)
        if best is not None:
            yield from best.batches()

    return both.mapInArrow(match, "qid long, id long, dist double")


def _keep(best_d, best_i, k, a, d, i) -> None:
    rows = np.unique(a)
    a = np.concatenate([a, np.repeat(rows, k)])
    d, i = np.concatenate([d, best_d[rows].ravel()]), np.concatenate([i, best_i[rows].ravel()])
    order = np.lexsort((i, d, a))
    take = np.searchsorted(a[order], rows)[:, None] + np.arange(k)
    best_d[rows], best_i[rows] = d[order][take], i[order][take]


def within_radius(records: DataFrame, query: Sequence[float], radius: float, metric: str = "cosine", vector: str = "embedding", id: str = "id") -> DataFrame:
    """(id, dist) of all records with a distance of at most the radius."""
    return with_distance(records.select(id, vector), query, metric, vector).filter(F.col("dist") <= radius).select(id, "dist")
