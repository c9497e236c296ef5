import numpy as np
import pytest

from sparlode.llm.sharding import permute, shard_rows, write_shards

from .conftest import prose


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    for seed in (0, 1, 12345):
        p = permute(np.arange(n), n, seed)
        assert sorted(p.tolist()) == list(range(n))
        assert (permute(p, n, seed, back=True) == np.arange(n)).all()
    assert len(permute(np.array([], dtype=np.int64), n)) == 0


def test_large_numbers_and_mixing():
    n = (1 << 60) - 3
    x = np.array([0, 1, 2, n - 1, n // 3], dtype=np.int64)
    assert (permute(permute(x, n, 9), n, 9, back=True) == x).all()
    p = permute(np.arange(10_000), 10_000, 3)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05
    assert (permute(np.arange(10_000), 10_000, 4) != p).mean() > 0.99
    with pytest.raises(ValueError):
        permute([5], 5)


def test_rows(spark, edge_docs, no_docs):
    rows = shard_rows(spark, edge_docs, shards=4, seed=2, carry=["text"]).collect()
    n = edge_docs.count()
    rows.sort(key=lambda r: r["row_number"])
    assert [r["row_number"] for r in rows] == list(range(n))
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in edge_docs.collect()), key=lambda i: (i is not None, i or 0))
    assert [r["position"] for r in rows] == permute(np.arange(n), n, 2).tolist()
    assert all((r["shard"], r["slot"]) == (r["position"] % 4, r["position"] // 4) for r in rows)
    assert shard_rows(spark, no_docs).collect() == []
    clash = shard_rows(spark, edge_docs.withColumnRenamed("id", "SLOT"), shards=4, seed=2, carry=["SLOT", "text"])
    assert clash.columns == ["doc_id", "row_number", "position", "shard", "slot", "SLOT_", "text"] and {r["SLOT_"] for r in clash.collect()} == {"i"}
    with pytest.raises(ValueError):
        shard_rows(spark, edge_docs.selectExpr("cast(doc_id as string) doc_id"))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 5)) for i in range(101)], "doc_id long, text string")
    write_shards(spark, docs, str(tmp_path / "s"), shards=5)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sizes = np.bincount([r["shard"] for r in back])
    assert sizes.max() - sizes.min() <= 1
    for k in range(5):
        files = list((tmp_path / "s" / f"shard={k}").glob("*.parquet"))
        assert len(files) == 1
        slots = [r["slot"] for r in spark.read.parquet(str(files[0])).collect()]
        assert slots == list(range(len(slots)))
