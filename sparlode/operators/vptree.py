"""Vantage-point trees over all vectors, for finding where to start a search."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..storage_util import save
from .exact import BROADCAST_BYTES, rank_within, vectors_of


class VpTree:
    """Inner nodes: a vantage point, the median distance of the others, those within it and those beyond."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, metric: str = "cosine", seed: int = 0):
        self.ids, self.vectors, self.metric = np.asarray(ids, dtype=np.int64), np.asarray(vectors, dtype=np.float64), metric
        self.radius = np.zeros(len(ids))
        self.inside, self.outside = np.full(len(ids), -1), np.full(len(ids), -1)
        self.root = self._build(seed)

    def _from(self, k: int, others) -> np.ndarray:
        return V.distance_rows(self.metric, np.broadcast_to(self.vectors[k], (len(others), self.vectors.shape[1])), self.vectors[others])

    def _build(self, seed: int) -> int:
        rng, root = np.random.default_rng(seed), -1
        todo = [(np.arange(len(self.ids)), None, None)]
        while todo:
            items, parent, side = todo.pop()
            if not len(items):
                continue
            pick = int(rng.integers(len(items)))
            node, rest = int(items[pick]), np.delete(items, pick)
            if parent is None:
                root = node
            else:
                side[parent] = node
            if len(rest):
                d = self._from(node, rest)
                self.radius[node] = np.sort(d)[len(d) // 2]
                within = d <= self.radius[node]
                if within.all() and len(rest) > 1 and d.max() == d.min():
                    # Equal distances: all are inside, as a chain.
                    todo.append((rest, node, self.inside))
                else:
                    todo += [(rest[within], node, self.inside), (rest[~within], node, self.outside)]
        return root

    def met(self, query, most: int) -> list[tuple[float, int]]:
        """(distance, id) of up to ``most`` records that a walk meets, the query's side first; nearest first."""
        q = np.asarray(query, dtype=np.float64)
        found, todo = [], [self.root]
        while todo and len(found) < most:
            node = todo.pop()
            if node < 0:
                continue
            d = float(V.distance_rows(self.metric, q[None], self.vectors[node][None])[0])
            found.append((d, int(self.ids[node])))
            near, far = (self.inside[node], self.outside[node]) if d <= self.radius[node] else (self.outside[node], self.inside[node])
            todo += [int(far), int(near)]
        return sorted(found)

    def seeds(self, query, most: int) -> list[int]:
        return [i for _, i in self.met(query, most)]


class _Top:
    """The nodes of a tree that walks of up to ``most`` nodes can meet: those with fewer than ``most`` above them. Numbered from the root, 0."""

    def __init__(self, ids, vectors, radius, inside, outside):
        self.ids, self.vectors, self.radius, self.inside, self.outside = ids, vectors, radius, inside, outside

    @staticmethod
    def of(tree: VpTree, most: int) -> _Top:
        level, nodes = [tree.root] if tree.root >= 0 else [], []
        for _ in range(most):
            nodes += level
            level = [int(c) for n in level for c in (tree.inside[n], tree.outside[n]) if c >= 0]
            if not level:
                break
        place = np.full(len(tree.ids) + 1, -1)  # the last stands for no node
        place[nodes] = np.arange(len(nodes))
        at = np.array(nodes, dtype=np.int64)
        return _Top(tree.ids[at], tree.vectors[at], tree.radius[at], place[tree.inside[at]], place[tree.outside[at]])

    def walk(self, metric: str, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, most) distances and ids of what the walk of each row of q meets, as VpTree.met has them; infinite where it ends before."""
        dist, who = np.full((len(q), most), np.inf), np.full((len(q), most), np.iinfo(np.int64).max)
        if not len(self.ids):
            return dist, who
        todo, top, met = np.zeros((len(q), most + 2), dtype=np.int64), np.ones(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        rows = np.arange(len(q))
        while len(rows):
            top[rows] -= 1
            node = todo[rows, top[rows]]
            d = V.distance_rows(metric, q[rows], self.vectors[node])
            dist[rows, met[rows]], who[rows, met[rows]] = d, self.ids[node]
            met[rows] += 1
            within = d <= self.radius[node]
            near, far = np.where(within, self.inside[node], self.outside[node]), np.where(within, self.outside[node], self.inside[node])
            for side in (far, near):
                some = rows[side >= 0]
                todo[some, top[some]] = side[side >= 0]
                top[some] += 1
            rows = rows[(top[rows] > 0) & (met[rows] < most)]
        return dist, who


def _nearest_met(trees: list[_Top], metric: str, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, up to most) distances and ids: of what the walks through all trees meet, the nearest; ties by id."""
    dist, who = zip(*(t.walk(metric, q, most) for t in trees), strict=True)
    dist, who = np.concatenate(dist, axis=1), np.concatenate(who, axis=1)
    order = np.lexsort((who, dist), axis=1)[:, :most]
    return np.take_along_axis(dist, order, axis=1), np.take_along_axis(who, order, axis=1)


def _searched(queries: DataFrame, trees: list[_Top], metric: str, most: int) -> DataFrame:
    """(qid, rank, id) for each query (qid, vector), by trees that every task has."""
    shared = queries.sparkSession.sparkContext.broadcast(trees)
    step = max(1, min(4096, (1 << 20) // max(1, len(trees) * most)))

    def run(batches):
        for b in batches:
            qids, v = b.column(0).to_numpy(), vectors_of(b.column(1)) if b.num_rows else None
            for lo in range(0, b.num_rows, step):
                dist, who = _nearest_met(shared.value, metric, v[lo : lo + step], most)
                a, r = np.nonzero(who < np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(qids[lo : lo + step][a]), pa.array((r + 1).astype(np.int32)), pa.array(who[a, r])], names=["qid", "rank", "id"])

    return queries.select(F.col("qid").cast("long"), V.as_vector(F.col("vector")).alias("v")).mapInArrow(run, "qid long, rank int, id long")


class VpForest:
    """Trees of about ``size`` records (id, v) each, by the hash of the id, over all records; built where their records are."""

    def __init__(self, records: DataFrame, trees: int, metric: str, seed: int, size: int):
        self.records, self.trees, self.metric, self.seed, self.size = records, trees, metric, seed, size

    def seeds(self, query, most: int) -> list[int]:
        q = self.records.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, vector array<double>")
        return [r["id"] for r in self.search(q, most).orderBy("rank").collect()]

    def _tops(self, most: int) -> DataFrame:
        """(tree, node, id, v, radius, inside, outside)"""
        metric, seed = self.metric, self.seed

        def run(key, rows):
            rows = rows.sort_by("id")
            t = _Top.of(VpTree(rows.column("id").to_numpy(), vectors_of(rows.column("v")), metric, seed), most)
            n = len(t.ids)
            return pa.table({
                "tree": pa.array([key[0].as_py()] * n, pa.int32()), "node": np.arange(n), "id": t.ids, "v": pa.array(list(t.vectors), pa.list_(pa.float64())), "radius": t.radius, "inside": t.inside, "outside": t.outside,
            })

        r = self.records.select("id", "v", F.expr(f"int(pmod(xxhash64(id), {self.trees}))").alias("tree"))
        made = r.groupBy("tree").applyInArrow(run, "tree int, node long, id long, v array<double>, radius double, inside long, outside long")
        return save(made, "vantage-points")

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        """(qid, rank, id): of what the walks through all trees meet, the nearest. Each tree is built once, in a task of its own. A walk of few nodes
        meets the tops of the trees only: those go to every task, up to 64 MB; else they are cut into parts of so many bytes, whose
        hits are merged."""
        tops = self._tops(most)
        sizes = tops.groupBy("tree").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).orderBy("tree").collect()
        parts, room = [[]], BROADCAST_BYTES
        for s in sizes:
            room -= s["n"] * (8 * s["dim"] + 48)
            if room < 0 and parts[-1]:
                parts.append([])
                room = BROADCAST_BYTES - s["n"] * (8 * s["dim"] + 48)
            parts[-1].append(s["tree"])
        found = [_searched(queries, self._fetch(tops, p), self.metric, most) for p in parts]
        if len(found) == 1:
            return found[0]
        met = reduce(DataFrame.unionByName, found).select("qid", "id")
        v = self.records.select("id", "v")
        q = queries.select(F.col("qid").cast("long").alias("qid"), V.as_vector(F.col("vector")).alias("qv"))
        met = met.join(v, "id").join(q, "qid").select("qid", "id", V.distance(self.metric, F.col("qv"), F.col("v")).alias("dist"))
        return rank_within(met, most, "dist", "id").select("qid", F.col("rank").cast("int").alias("rank"), "id")

    @staticmethod
    def _fetch(tops: DataFrame, trees: list[int]) -> list[_Top]:
        rows = tops.filter(F.col("tree").between(trees[0], trees[-1])).orderBy("tree", "node").toArrow() if trees else None
        out = []
        for tree in trees:
            t = rows.filter(pc.equal(rows.column("tree"), tree))
            out.append(_Top(*(vectors_of(t.column(c)) if c == "v" else t.column(c).to_numpy() for c in ("id", "v", "radius", "inside", "outside"))))
        return out


def build(records: DataFrame, metric: str = "cosine", size: int = 20_000, seed: int = 0, vector: str = "embedding", id: str = "id") -> VpTree | VpForest:
    """One tree, which the driver holds, of up to ``size`` records; a forest of such trees of more."""
    records = records.select(F.col(id).alias("id"), V.as_vector(F.col(vector)).alias("v"))
    rows = records.limit(size + 1).count()
    if rows > size:
        return VpForest(records, math.ceil(records.count() / size), metric, seed, size)
    rows = records.orderBy(F.xxhash64("id"), "id").collect()
    return VpTree(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1), metric, seed)


def search_seeds(tree: VpTree | VpForest, queries: DataFrame, most: int) -> DataFrame:
    """(qid, rank, id) for each query (qid, vector)."""
    return tree.search(queries, most) if isinstance(tree, VpForest) else _searched(queries, [_Top.of(tree, most)], tree.metric, most)
