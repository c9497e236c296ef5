import json

import pytest
from pyspark.sql import functions as F

from sparlode.config import Config, IndexConfig, OptimizeRequest
from sparlode.errors import Corruption, DimensionMismatch, Internal, InvalidConfig, NotFound, SerdeError, StorageIO
from sparlode.operators.filters import Eq
from sparlode.plans.search import SearchRequest, search_database
from sparlode.sources.store import Database


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "db")


def live(db):
    return sorted(r["id"] for r in db.ids().collect())


def test_create_and_open(spark, path):
    with pytest.raises(StorageIO):
        Database.open(spark, path)
    with pytest.raises(InvalidConfig):
        Database.create(spark, path, 0)
    db = Database.create(spark, path, 8, Config(8, IndexConfig("l2", m=7)))
    with pytest.raises(StorageIO):
        Database.create(spark, path, 8)
    again = Database.open(spark, path)
    assert (again.dim, again.metric, again.config.index.m, again.config.index.m0) == (8, "l2", 7, 32)
    assert live(db) == [] and db.count() == 0 and db.get_record(1) is None
    (db.path / "manifest-000000000001.json").write_text("{")
    with pytest.raises(Corruption):
        Database.open(spark, path)


def test_rows_come_and_go(spark, path):
    db = Database.create(spark, path, 3)
    with pytest.raises(DimensionMismatch):
        db.insert_json([0.0] * 8, {})
    assert db.insert_json_batch([([1, 0, 0], {"n": 1}), ([0, 1, 0], {"n": 2}), ([0, 0, 1], {"n": 3})]) == [1, 2, 3]
    with pytest.raises(DimensionMismatch):
        db.insert_json_batch([([1, 0, 0], {}), ([1], {})])
    assert live(db) == [1, 2, 3]  # all or none
    with pytest.raises(NotFound):
        db.update_json(404, [0.0], {})  # whether it exists comes before its dimension
    with pytest.raises(DimensionMismatch):
        db.update_json(1, [0.0], {})
    with pytest.raises(NotFound) as e:
        db.remove(404)
    assert e.value.id == 404
    with pytest.raises(SerdeError):
        db.insert_json([0, 0, 0], {"x": float("nan")})
    db.update_json(1, [0.5, 0.5, 0], {"n": "new"})
    db.remove(2)
    again = Database.open(spark, path)
    assert live(again) == [1, 3] and again.get_record(1) == ([0.5, 0.5, 0.0], {"n": "new"}) and again.get_vector(2) is None and again.get_document(3) == {"n": 3}
    hit = search_database(again, SearchRequest([0.5, 0.5, 0], 1)).first()
    assert hit["id"] == 1 and json.loads(hit["document"]) == {"n": "new"} and hit["score"] == pytest.approx(1)
    with pytest.raises(NotFound):
        again.remove(2)


def test_compaction_and_ids(spark, path):
    db = Database.create(spark, path, 1)
    db.insert_json_batch([([float(i)], {"i": i}) for i in range(3)])
    db.remove(3)
    db.remove(2)
    report = db.optimize()
    assert report.records_compacted == 1 and report.space_reclaimed_bytes > 0 and len(db.manifest["segments"]) == 1
    assert db.insert_json([9.0], {}) == 4  # ids of deleted rows are never given again
    assert live(Database.open(spark, path)) == [1, 4] and db.check_health()["records"] == 2
    report = db.optimize(OptimizeRequest(checkpoint_only=True))
    assert report.records_compacted == 0 and report.space_reclaimed_bytes > 0
    assert db.optimize(OptimizeRequest(False, False, True)).graph_edges_repaired == 2 and live(db) == [1, 4]


def test_only_one_of_two_writers_commits(spark, path):
    Database.create(spark, path, 1)
    a, b = Database.open(spark, path), Database.open(spark, path)
    a.insert_json([1.0], {})
    with pytest.raises(Internal):
        b.insert_json([2.0], {})
    assert live(Database.open(spark, path)) == [1] and len(list((a.path / "segments").iterdir())) == 1
    assert Database.open(spark, path).insert_json([3.0], {}) == 2


def test_tables(spark, path):
    db = Database.create(spark, path, 2)
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.to_json(F.struct(F.col("id").alias("n"), F.lit("s").alias("source"))).alias("document"))
    assert db.insert_table(rows, [F.desc("id")]) == (1, 1000)
    assert db.get_document(1) == {"n": 999, "source": "s"} and db.count() == 1000 and db.check_health()["records"] == 1000
    assert db.insert_table(rows.limit(0), ["id"]) == (1001, 0)
    with pytest.raises(Exception, match="dimension mismatch"):
        db.insert_table(rows.withColumn("embedding", F.array(F.lit(1.0))), ["id"])
    assert Database.open(spark, path).count() == 1000
    plan = Database.open(spark, path).records().filter(F.col("id") == 5).select("document")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(id,5)" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_ann_only(spark, path):
    Database.create(spark, path, 1).insert_json([1.0], {"text": "apple"})
    db = Database.open_ann_only(spark, path)
    assert search_database(db, SearchRequest([1.0], 1)).count() == 1
    with pytest.raises(Internal):
        search_database(db, SearchRequest([1.0], 1, filter=Eq("a", 1)))


def test_derived_tables_end_with_their_version(spark, path):
    db = Database.create(spark, path, 1)
    db.insert_json([1.0], {})
    assert db.load_derived("graph") is None
    db.save_derived("graph", spark.range(3))
    assert Database.open(spark, path).load_derived("graph").count() == 3
    db.update_json(1, [2.0], {})
    assert db.load_derived("graph") is None
    (db.path / "manifest-000000000009.json").write_text(json.dumps(db.manifest | {"live": 7}))
    with pytest.raises(Corruption):
        Database.open(spark, path).check_health()


def test_a_reader_of_an_older_version_goes_on(spark, path):
    db = Database.create(spark, path, 1)
    db.insert_json_batch([([float(i)], {"text": f"apple {i}"}) for i in range(4)])
    pinned = db.records()
    db.update_json(1, [9.0], {})
    db.optimize()
    assert sorted(r["id"] for r in pinned.collect()) == [1, 2, 3, 4] and len(list((db.path / "segments").iterdir())) == 3
    (db.path / ".manifest-left-by-a-crash").write_text("{")
    assert db.insert_json([1.0], {}) == 5  # nothing of a crashed writer stands in the way
    db.vacuum()
    assert len(list((db.path / "segments").iterdir())) == len(db.manifest["segments"]) and live(Database.open(spark, path)) == [1, 2, 3, 4, 5]


def test_a_replayed_batch_of_a_stream_is_left_out(spark, path):
    db = Database.create(spark, path, 1)
    rows = spark.createDataFrame([(i, [float(i)], "{}") for i in range(3)], "k int, embedding array<float>, document string")
    assert db.insert_table(rows, [F.col("k")], stream=("s", 0)) == (1, 3)
    again = Database.open(spark, path)  # after a crash between the commit and the stream's own checkpoint
    assert again.insert_table(rows, [F.col("k")], stream=("s", 0)) == (4, 0) and again.count() == 3
    assert again.insert_table(rows, [F.col("k")], stream=("s", 1)) == (4, 3) and again.insert_table(rows, [F.col("k")], stream=("t", 0)) == (7, 3)


def test_indexes_are_kept_and_used(spark, path):
    import numpy as np

    rng = np.random.default_rng(0)
    db = Database.create(spark, path, 4)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), json.dumps({"text": f"apple n{i}", "source": "ab"[i % 2], "x": i % 3})) for i in range(600)], "k int, embedding array<float>, document string")
    db.insert_table(rows, [F.col("k")])
    asked = [SearchRequest([1, 0, 0, 0], 5), SearchRequest([1, 0, 0, 0], 5, "n7 apple"), SearchRequest([1, 0, 0, 0], 5, filter=Eq("source", "a")), SearchRequest([], 5, "n7")]
    want = [search_database(db, r).collect() for r in asked]
    assert db.postings() is None and db.cells() is None
    db.build_indexes(cells=20)
    db = Database.open(spark, path)
    assert len(db.cells()[0]) == 20 and db.postings()[1].count() == 600
    for r, w in zip(asked, want, strict=True):
        assert search_database(db, r).collect() == w  # few rows: exact
        r.ef_search = 1000
        assert search_database(db, r, exact_rows=10).collect() == w  # all cells
    near = search_database(db, SearchRequest([1, 0, 0, 0], 5, ef_search=100), exact_rows=10)  # two of twenty cells
    assert len({r["id"] for r in near.collect()} & {r["id"] for r in want[0]}) >= 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    db.insert_json([1.0, 0.0, 0.0, 0.0], {"text": "apple"})
    assert db.postings() is None and search_database(db, SearchRequest([1, 0, 0, 0], 1), exact_rows=10).first()["id"] == 601
