import numpy as np
import pytest

from sparlode.llm.knn import _assign, blocks_of, bounds, distances, knn_join, kth_of_sample, replicate


def brute(rows, k, others=None):
    out = {}
    for i, v in rows:
        d = sorted((float(distances(np.array(v, dtype=float), np.array(w, dtype=float))), j) for j, w in (rows if others is None else others) if others is not None or j != i)
        out[i] = [(j, x) for x, j in d[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["neighbor_id"], r["distance"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("spread,block", [(0.05, 40), (3.0, 4096), (3.0, 7)])
def test_is_exact_on_clusters_and_noise(spark, spread, block):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 5)) * 4
    rows = [(i, (centers[i % 6] + rng.normal(size=5) * spread).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(knn_join(spark, df, k=4, pivots=12, block=block)) == brute(rows, 4)


def test_two_tables_in_single_precision(spark):
    rng = np.random.default_rng(4)
    make = lambda n, base: [(base + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    q, d = make(40, 0), make(150, 1000)
    schema = "vec_id long, embedding array<float>"
    got = knn_join(spark, spark.createDataFrame(q, schema), spark.createDataFrame(d, schema), k=7, pivots=9)
    assert found(got) == brute(q, 7, d)


def test_ties_go_to_the_lesser_id_and_repeated_rows_count_once(spark):
    rows = [(i, [0.0, 0.0]) for i in range(20)] + [(100 + i, [float(i), 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows + rows[:7], "vec_id long, embedding array<double>")
    assert found(knn_join(spark, df, k=3, pivots=4)) == brute(rows, 3)


def test_nulls_lengths_and_extremes(spark):
    good = [(1, [1.0, 2.0]), (2, [1e90, 0.0]), (3, [1.0, 2.5]), (4, [1e-40, 0.0])]
    bad = [(None, [1.0, 1.0]), (5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, cell string, block int")
    assert found(knn_join(spark, df, k=5, pivots=3)) == brute(good, 5)
    assert knn_join(spark, df.limit(0), k=5).collect() == []
    assert knn_join(spark, df.filter("vec_id = 1"), k=5).collect() == []


def test_bounds_hold_for_every_query():
    rng = np.random.default_rng(0)
    x, p, k = rng.normal(size=(200, 3)), rng.normal(size=(5, 3)), 3
    cell = distances(x[:, None], p[None]).argmin(1)
    to = distances(x, p[cell])
    query = {c: (to[cell == c].max(), int((cell == c).sum()), np.inf) for c in range(5) if (cell == c).any()}
    data = {c: np.sort(to[cell == c])[: k + 1].tolist() for c in query}
    theta, _ = bounds(p, query, data, k, True)
    kth = np.sort(distances(x[:, None], x[None]), axis=1)[:, k]
    assert all(kth[i] <= theta[cell[i]] for i in range(200))
    ids = np.arange(200)
    upper = kth_of_sample(ids, x, ids[:50], x[:50], k, True)
    assert (kth <= upper).all() and np.isinf(kth_of_sample(ids, x, ids[:2], x[:2], k, True)).all()


def test_few_rows_travel_where_data_cluster():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    centers, k = rng.normal(size=(40, 8)) * 10, 5
    x = centers[rng.integers(40, size=6000)] + rng.normal(size=(6000, 8)) * 0.3
    ids = np.arange(6000)
    p = x[:60]
    b = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist())], names=["id", "vec"])
    a = next(_assign(8, p, (ids[:960], x[:960]), k, True)([b]))
    cell, to, upper = (a.column(i).to_numpy() for i in (2, 3, 4))
    query = {c: (to[cell == c].max(), int((cell == c).sum()), upper[cell == c].max()) for c in set(cell.tolist())}
    theta, between = bounds(p, query, {c: np.sort(to[cell == c])[: k + 1].tolist() for c in query}, k, True)
    _, members = blocks_of(between, {c: q[1] for c, q in query.items()}, 300)
    sent = sum(r.num_rows for r in replicate(theta, between, query, members, 3)([a]))
    assert len(members) > 15 and len(x) <= sent < 0.2 * len(members) * len(x)


def test_slices_and_queries_within_the_data(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = found(knn_join(spark, df.filter("vec_id % 10 = 0"), df, k=6, exclude_self=True, block=15, slice_bytes=2000))
    assert got == {i: x for i, x in brute(rows, 6).items() if i % 10 == 0}
    with pytest.raises(ValueError):
        knn_join(spark, df.selectExpr("cast(vec_id as string) vec_id", "embedding"))


def test_blocks_hold_all_cells():
    between = np.abs(np.arange(6)[:, None] - np.arange(6)[None]).astype(float)
    of, members = blocks_of(between, {0: 5, 1: 3, 2: 25, 3: 4, 5: 1}, 10)
    assert of[2][1] == 3 and all(c in members[b] for c, (f, n) in of.items() for b in range(f, f + n))
    assert all(sum({0: 5, 1: 3, 3: 4, 5: 1}.get(c, 0) for c in m) <= 10 for m in members)
