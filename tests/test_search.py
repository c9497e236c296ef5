import json

import pytest
from pyspark.sql import functions as F

from sparlode.errors import DimensionMismatch, Internal, InvalidConfig
from sparlode.functions.json import derive
from sparlode.operators import exact, lexical
from sparlode.operators.filters import And, Eq
from sparlode.plans.search import SearchRequest, search, search_batch, with_documents


def records(spark, docs):
    rows = [(i, [float(x) for x in v], json.dumps(d)) for i, v, d in docs]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, document string")
    return df.withColumn("d", derive("document")).select("id", "embedding", "d.*")


def hits(df):
    return [(r["id"], r["score"]) for r in df.collect()]


def test_exact_topk_and_radius(spark):
    r = records(spark, [(1, [1, 1, 1], {}), (2, [0.1, 0.1, 0.1], {}), (3, [5, 5, 5], {}), (4, [0.5, 0.5, 0.5], {})])
    got = exact.topk(r, [0, 0, 0], 2, "l2").collect()
    assert [x["id"] for x in got] == [2, 4] and got[0]["dist"] == pytest.approx(0.03, abs=1e-6)
    near = search(r, SearchRequest([0, 0, 0], 5, radius=0.8), dim=3, metric="l2").collect()
    assert [x["id"] for x in near] == [2, 4] and near[1]["score"] == -0.75
    edge = records(spark, [(1, [0, 0, 0], {"n": "near"}), (2, [1, 0, 0], {}), (3, [2, 0, 0], {})])
    assert [i for i, _ in hits(search(edge, SearchRequest([0, 0, 0], 5, radius=1.0), dim=3, metric="l2"))] == [1, 2]


def test_ties_by_id_and_inner_product(spark):
    r = records(spark, [(i, [1, 0], {}) for i in (5, 3, 9, 1)] + [(2, [3, 0], {})])
    assert hits(search(r, SearchRequest([1, 0], 3), dim=2, metric="ip")) == [(2, 3.0), (1, 1.0), (3, 1.0)]
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "qid long, vector array<double>")
    for size in (1 << 20, 0):
        got = exact.batch_topk(r, q, 2, "ip", broadcast_bytes=size).orderBy("qid", "rank").collect()
        assert [(x["qid"], x["rank"], x["id"]) for x in got] == [(7, 1, 2), (7, 2, 1), (8, 1, 1), (8, 2, 2)]
    assert exact.batch_topk(r, q.limit(0), 2).collect() == []


def test_filters(spark):
    r = records(spark, [(1, [1, 0], {"x": "a", "meta": {"source": "desk"}}), (2, [0, 1], {"x": "a", "meta": {"source": "web"}}), (3, [1, 1], {"x": "b", "meta": {"source": "desk"}}), (4, [1, 0], {"source": "desk", "x": "keep"}), (5, [1, 0], {"source": "desk", "x": "drop"})])
    one = lambda f, **how: [i for i, _ in hits(search(r, SearchRequest([1, 0], 5, filter=f), dim=2, **how))]
    assert one(And(Eq("x", "a"), Eq("meta.source", "desk"))) == [1]
    for pool in ("exact", "reference"):
        assert one(And(Eq("source", "desk"), Eq("x", "keep")), pool=pool) == [4]
        assert one(And(), pool=pool) == [1, 4, 5, 3, 2]
        assert one(Eq("source", "none"), pool=pool) == []
    # The reference's pool is cut before what isn't indexed is looked at.
    many = records(spark, [(i, [1, i / 1000], {"x": int(i > 60)}) for i in range(80)])
    assert hits(search(many, SearchRequest([1, 0], 1, filter=Eq("x", 1), ef_search=10), dim=2, pool="reference")) == []
    assert len(hits(search(many, SearchRequest([1, 0], 1, filter=Eq("x", 1)), dim=2))) == 1


def lexical_scores(spark, docs, query, allowed=None):
    r = records(spark, [(i, [1], d) for i, d in docs])
    fields = {"text": "text", "title": "title", "tags": "tags_text"}
    ok = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "id long")
    s = lexical.scores(lexical.postings(r, fields), lexical.lengths(r, fields), lexical.literal_terms(spark, query), allowed=ok)
    return [(x["id"], round(x["score"], 6)) for x in lexical.topk(s, 10).orderBy("rank").collect()]


def test_bm25f(spark):
    a = [(1, {"title": "Apple Guide", "text": "neutral text", "tags": ["fruit", "orchard"]}), (2, {"title": "Banana", "text": "other"})]
    assert lexical_scores(spark, a, "apple orchard") == [(1, 1.370117)]
    assert lexical_scores(spark, [(42, {"metadata": {"title": "Desktop Memory", "tags": ["rag"]}})], "desktop rag") == [(42, 0.690766)]
    b = [(1, {"text": "apple orchard notes"}), (2, {"text": "apple orchard guide"})]
    assert lexical_scores(spark, b, "apple", [2]) == [(2, 0.182322)]
    assert lexical_scores(spark, b, "apple apple")[0][1] == pytest.approx(2 * 0.182322, abs=2e-6) and lexical_scores(spark, b, "?!") == []


def test_hybrid(spark):
    r = records(spark, [(1, [1, 0, 0], {"text": "noise"}), (2, [0, 1, 0], {"text": "apple"})])
    ask = lambda **k: hits(search(r, SearchRequest([1, 0, 0], 2, "apple", **k), dim=3))
    assert ask(hybrid_alpha=0.2, lexical_top_k=10) == [(2, 0.8), (1, 0.2)]
    assert ask(hybrid_alpha=9) == [(1, 1.0), (2, 0.0)] and ask(hybrid_alpha=-9) == [(2, 1.0), (1, 0.0)] and ask()[0] == (1, 0.65)
    assert hits(search(r, SearchRequest([], 2, "apple"), dim=3)) == [(2, 1.0)]
    # Pools are normalised before the radius takes rows away.
    assert ask(radius=0.5) == [(1, 0.65)]
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "apple"), (2, [0.0, 1.0, 0.0], "nothing")], "qid long, vector array<double>, text string")
    got = search_batch(r, q, 2, alpha=0.2)
    assert sorted((x["qid"], x["rank"], x["id"], x["score"]) for x in got.collect()) == [(1, 1, 2, 0.8), (1, 2, 1, 0.2), (2, 1, 2, 0.2), (2, 2, 1, 0.0)]
    assert with_documents(got, r).count() == 4
    assert [x["id"] for x in search_batch(r, q.drop("vector"), 2).collect()] == [2]


def test_validation_and_its_order(spark):
    r = records(spark, [(1, [1, 0, 0], {"text": "apple"})])
    run = lambda **k: search(r, SearchRequest(**k), dim=3, ann_only=k.pop("ann", False))
    assert run(vector=[1], top_k=0).collect() == []
    with pytest.raises(DimensionMismatch) as e:
        run(vector=[1, 2])
    assert (e.value.expected, e.value.actual) == (3, 2)
    with pytest.raises(DimensionMismatch):
        run(vector=[], text_query="  ")
    with pytest.raises(InvalidConfig):
        run(vector=[], text_query="a", radius=1.0)
    for k in ({"text_query": "a"}, {"filter": Eq("a", 1)}):
        with pytest.raises(Internal):
            search(r, SearchRequest([1, 0], 1, **k), dim=3, ann_only=True)
    assert len(hits(search(r, SearchRequest([1, 0, 0], 1, "  "), dim=3, ann_only=True))) == 1
    with pytest.raises(InvalidConfig):
        search_batch(r, spark.range(1).withColumnRenamed("id", "qid"), 1)


def test_pool_sizes():
    assert SearchRequest([1.0], 10).pools() == (10, 10)
    assert SearchRequest([1.0], 10, "a").pools() == (200, 200)
    assert SearchRequest([1.0], 10, "a", lexical_top_k=3).pools() == (200, 10)
    assert SearchRequest([1.0], 10, "a").pools("reference") == (50, 200)
    assert SearchRequest([1.0], 10, "a", ef_search=80).pools("reference") == (80, 200)
    assert SearchRequest([1.0], 10, filter=And()).pools("reference", indexed_filter=True) == (200, 200)
    assert SearchRequest([], 10, "a", lexical_top_k=30).pools() == (0, 30)


def test_plan_is_narrow(spark, tmp_path):
    r = records(spark, [(i, [i, 1], {"text": "a", "source": "s"}) for i in range(5)])
    r.write.parquet(str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    plan = exact.topk(r, [1, 2], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<id:bigint,embedding:array<float>>" in plan
    assert r.filter(F.col("id") == 3).count() == 1


def test_equal_texts_are_scored_once(spark, monkeypatch):
    r = records(spark, [(1, [1], {"text": "alpha"}), (2, [1], {"text": "alpha beta beta"}), (3, [1], {"text": "gamma"}), (4, [1], {"text": "alpha"})])
    texts = ["Alpha beta", "beta, alpha", "alpha", "  ", None]
    q = spark.createDataFrame(list(enumerate(texts * 20)), "qid long, text string")
    asked, plain = [], lexical.scores
    monkeypatch.setattr(lexical, "scores", lambda post, lens, terms, **how: asked.append(terms.select("qid").distinct().count()) or plain(post, lens, terms, **how))
    got = sorted((x["qid"], x["rank"], x["id"]) for x in search_batch(r, q, 2).collect())
    assert asked == [2]
    ids = [[2, 1], [2, 1], [1, 4], [], []]
    assert got == [(n, rank + 1, i) for n in range(100) for rank, i in enumerate(ids[n % 5])]


def test_postings_of_any_fields(spark):
    """A token's field is told by its place; no function is called for each token."""
    d = spark.createDataFrame([(1, "a b a", "a", None), (2, None, "c c", "b a"), (2, "c", None, None), (3, "", "", "")], "id long, text string, title string, tags string")
    three = lexical.postings(d, {"title": "title", "text": "text", "tags": "tags"})
    assert "lambda" not in three._jdf.queryExecution().toString()
    rows = sorted((r["term"], r["id"], r["tf_text"], r["tf_title"], r["tf_tags"]) for r in three.collect())
    assert rows == [("a", 1, 2, 1, 0), ("a", 2, 0, 0, 1), ("b", 1, 1, 0, 0), ("b", 2, 0, 0, 1), ("c", 2, 1, 2, 0)]
    one = lexical.postings(d, {"title": "title"})
    assert sorted(tuple(r) for r in one.select("term", "id", "tf_text", "tf_title", "tf_tags").collect()) == [("a", 1, 0, 1, 0), ("c", 2, 0, 2, 0)]
