import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlode.operators import exact, graph, ivf, vptree


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    return points(spark, [(i, rng.normal(size=4).tolist()) for i in range(300)]).cache()


def test_diversity(spark):
    r = points(spark, [(1, [0, 0, 0])] + [(i, [i, i, i]) for i in range(2, 8)])
    edges = spark.createDataFrame([(0, 1, i, 3.0 * i * i) for i in range(2, 8)], graph.EDGES)
    assert [(x["src"], x["dst"]) for x in graph.select_edges(edges, r, 5, "l2").collect()] == [(1, 2)]
    assert graph.prune(edges, r, 6, "l2").count() == 6 and graph.prune(edges, r, 5, "l2").count() == 1


def test_remove_and_entry(spark):
    edges = spark.createDataFrame([(0, a, b, 1.0) for a in range(1, 5) for b in range(1, 5) if a != b], graph.EDGES)
    left = graph.remove(edges, spark.createDataFrame([(2,)], "id long"))
    assert left.filter("src = 2 or dst = 2").count() == 0 and left.count() == 6
    assert {r["dst"] for r in graph.neighbors(left, 1).collect()} == {3, 4}
    assert graph.entry_point(spark.createDataFrame([(5, 1), (3, 2), (4, 2)], "id long, level int")) == 3
    assert graph.entry_point(spark.createDataFrame([], "id long, level int")) is None


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(100)]
    root = {i: i for i in range(150)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    edges = spark.createDataFrame([(0, a, b, 0.0) for a, b in pairs], graph.EDGES)
    got = {r["id"]: r["component"] for r in graph.components(edges, spark.range(150)).collect()}
    assert got == {i: find(i) for i in range(150)}
    assert not graph.connected(edges, spark.range(150)) and graph.connected(edges.limit(1))


def test_levels(spark):
    rows = graph.levels(spark.range(20_000)).groupBy("level").count().collect()
    share = {r["level"]: r["count"] / 20_000 for r in rows}
    assert share[0] == pytest.approx(15 / 16, abs=0.01) and share[1] == pytest.approx(15 / 256, abs=0.01)


def test_graph_search(spark, cloud):
    edges, lv = graph.build(cloud, m=8, m0=16, ef_construction=30, metric="l2")
    assert edges.filter("layer = 0").groupBy("src").count().agg(F.max("count")).first()[0] <= 16
    q = points(spark, [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(20)]).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    start = graph.descend(edges, lv, cloud, [0.0] * 4, "l2")
    found = graph.beam_search(edges, cloud, q, start, 10, 60, "l2")
    want = exact.batch_topk(cloud, q, 10, "l2")
    assert found.join(want, ["qid", "id"]).count() >= 0.9 * want.count()
    assert graph.beam_search(edges, cloud, q, start, 10, 4, "l2").groupBy("qid").count().filter("count <> 4").count() == 0  # at most ef


def test_line_search_and_delete(spark):
    r = points(spark, [(i, [i, 0, 0]) for i in range(1, 21)])
    q = spark.createDataFrame([(0, [15.1, 0.0, 0.0])], "qid long, vector array<double>")
    edges = graph.bidirectional(graph.knn_edges(r, 3, "l2"))
    assert {x["id"] for x in graph.beam_search(edges, r, q, 1, 2, 10, "l2").collect()} == {15, 16}
    gone = graph.remove(edges, spark.createDataFrame([(15,)], "id long"))
    assert {x["id"] for x in graph.beam_search(gone, r.filter("id <> 15"), q, 20, 2, 10, "l2").collect()} == {16, 14}


def test_cells(spark, cloud):
    c = ivf.train(cloud, 12)
    a, b = ivf.assign(cloud, c).select("id", "cell"), ivf.assign_fast(cloud, c)
    assert sorted(a.collect()) == sorted(b.collect())
    q = [0.1, 0.2, 0.3, 0.4]
    assigned = ivf.assign(cloud, c)
    assert ivf.search(assigned, q, 5, c, 12, "l2").collect() == exact.topk(cloud, q, 5, "l2").collect()
    qs = spark.createDataFrame([(1, q)], "qid long, vector array<double>")
    one = [(r["id"], r["dist"]) for r in ivf.search(assigned, q, 5, c, 3, "l2").collect()]
    assert one == [(r["id"], r["dist"]) for r in ivf.batch_search(assigned, qs, 5, c, 3, "l2").orderBy("rank").collect()]


def test_vantage_points(spark, cloud):
    t = vptree.build(points(spark, [(1, [0, 0]), (2, [1, 1]), (3, [5, 5]), (4, [9, 9])]), "l2")
    assert 1 <= len(t.seeds([0.2, 0.1], 2)) <= 2 and sorted(t.seeds([0, 0], 99)) == [1, 2, 3, 4]
    assert vptree.VpTree(np.array([], dtype=int), np.zeros((0, 2))).seeds([0, 0], 3) == []
    same = vptree.VpTree(np.arange(3000), np.ones((3000, 2)), "l2")
    assert len(same.seeds([1, 1], 4000)) == 3000
    q = cloud.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    got = vptree.search_seeds(vptree.build(cloud, "l2"), q, 40)
    assert got.count() == 300 * 40 and got.filter("rank = 1 and qid = id").count() > 60


def test_a_forest_covers_all_records(cloud):
    forest = vptree.build(cloud, "l2", size=50)
    assert isinstance(forest, vptree.VpForest) and sorted(forest.seeds([0, 0, 0, 0], 400)) == list(range(300))
    q = cloud.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    got = vptree.search_seeds(forest, q, 5)
    assert got.count() == 300 * 5 and got.select("id").distinct().count() > 50
    assert got.filter("rank = 1 and qid = id").count() > 60


def test_walks_of_all_queries_at_once(spark, cloud, monkeypatch):
    """The same seeds as tree by tree and query by query; records are shuffled once, not once for each block of queries."""
    rows = sorted((r["id"], list(r["embedding"])) for r in cloud.collect())
    bucket = {r["id"]: r["b"] for r in cloud.select("id", F.expr("int(pmod(xxhash64(id), 6))").alias("b")).collect()}
    trees = []
    for b in range(6):
        mine = [(i, v) for i, v in rows if bucket[i] == b]
        trees.append(vptree.VpTree(np.array([i for i, _ in mine]), np.array([v for _, v in mine]), "l2"))
    q = cloud.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    for most, bytes in ((5, 64 << 20), (60, 64 << 20), (5, 5000)):
        monkeypatch.setattr(vptree, "BROADCAST_BYTES", bytes)
        found = vptree.search_seeds(vptree.build(cloud, "l2", size=50), q, most)
        assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == {i: [n for _, n in sorted(x for t in trees for x in t.met(v, most))[:most]] for i, v in rows}
