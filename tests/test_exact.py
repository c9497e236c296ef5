import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sparlode.functions import vector as V
from sparlode.operators import exact

SHAPE = "id long, embedding array<double>"


def nearest(metric, rows, queries, k, exclude_self):
    """(qid, rank, id, dist) by brute force in the columns' order of sums."""
    out = []
    x = np.array([v for _, v in rows])
    for qid, q in queries:
        d = V.distance_rows(metric, x, np.broadcast_to(np.array(q), x.shape))
        best = sorted((d[n], i) for n, (i, _) in enumerate(rows) if np.isfinite(d[n]) and not (exclude_self and i == qid))
        out += [(qid, r + 1, i, float(e)) for r, (e, i) in enumerate(best[:k])]
    return sorted(out)


def odd_vectors():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(240, 6))
    v[::17] = 0  # no direction
    v[5::19] = v[5]  # ties
    v[7::23] *= 1e-170  # squares that vanish
    v[8::29] *= 1e-158  # that lose digits
    v[9::31] *= 1e120
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("bytes", [0, 1 << 20])
def test_join_by_brute_force(spark, monkeypatch, metric, exclude_self, bytes):
    """Many tiles, several blocks of queries and of records."""
    monkeypatch.setattr(exact, "_TILE", (16, 64))
    monkeypatch.setattr(exact, "BLOCK_RECORDS", 100)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SHAPE)
    got = exact.batch_topk(df, df, 5, metric, qid="id", query_vector="embedding", exclude_self=exclude_self, broadcast_bytes=bytes)
    assert sorted(tuple(r) for r in got.collect()) == nearest(metric, rows, rows, 5, exclude_self)


def test_far_from_the_origin(spark):
    """A product of matrices loses the differences of such vectors."""
    rng = np.random.default_rng(2)
    rows = [(i, (1e8 + rng.normal(size=4)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, SHAPE)
    for bytes in (0, 1 << 20):
        got = exact.batch_topk(df, df, 3, "l2", qid="id", query_vector="embedding", broadcast_bytes=bytes)
        assert sorted(tuple(r) for r in got.collect()) == nearest("l2", rows, rows, 3, False)


def test_memory_of_a_task_does_not_follow_the_pairs(spark):
    """20,000 queries against batches of records: far less than a matrix of all pairs of them."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(20_000, 8))
    q = spark.createDataFrame(pa.table({"qid": np.arange(len(v)), "qv": pa.array(v.tolist())}))
    match = exact._matcher(spark, q, 5, "cosine", False)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(v[:4096].tolist())], names=["id", "v"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in match([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 100_000 and peak < 100e6
