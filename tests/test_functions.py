import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlode.errors import SerdeError
from sparlode.functions import metrics, text
from sparlode.functions import vector as V
from sparlode.functions.json import canonical, derive, derive_one, extract_tags, extract_title, get_path, json_path, loads
from sparlode.operators import filters
from sparlode.operators.filters import And, Eq


@pytest.mark.parametrize("b,want", [([1.0, 0, 0], 0.029857), ([0.7, 0.3, 0], 0.012759), ([0, 0.2, 0.8], 0.941176), ([0, 0, 0], 1.0)])
def test_cosine(spark, b, want):
    df = spark.createDataFrame([([float(x) for x in b],)], "v array<double>")
    got = df.select(V.distance("cosine", F.col("v"), [0.8, 0.2, 0.0])).first()[0]
    assert got == pytest.approx(want, abs=1e-6)
    assert V.distance_rows("cosine", np.array([[0.8, 0.2, 0.0]]), np.array([b], dtype=float))[0] == got
    assert V.distance_matrix("cosine", np.array([[0.8, 0.2, 0.0]]), np.array([b], dtype=float))[0, 0] == pytest.approx(got)


def test_other_metrics_and_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    row = df.select(V.distance("l2", F.col("v"), [0.0, 0.0]), V.distance("ip", F.col("v"), [3.0, 1.0]), V.score("l2", F.lit(5.0)), V.score("ip", F.lit(-5.0)), V.score("cosine", F.lit(0.25))).first()
    assert tuple(row) == (5.0, -5.0, -5.0, 5.0, 0.75)


@pytest.mark.parametrize("args,source,want", [
    ((4, 1), "abcdefghij", ["abcd", "defg", "ghij", "j"]), ((6, 2), "ab. cdef gh", ["ab.", "b.", ".", " cdef ", "f gh", "gh", "h"]),
    ((6, 1), "abc\n\ndefgh", ["abc", "c", "", "\ndefgh", "h"]), ((4, 1), "\n\nabcdef", ["", "\nabc", "cdef", "f"]), ((4, 1), "", []),
])
def test_splitter(spark, args, source, want):
    assert text.split_text(source, *args) == want
    assert spark.createDataFrame([(source,)], "t string").select(text.split(F.col("t"), *args)).first()[0] == want


def test_splitter_tails():
    assert len(text.split_text("hello world. this is a memory.")) == 30
    assert len(text.split_text("x" * 1000)) == 67 and len(text.split_text("x" * 1000, tail="stop")) == 3
    assert text.split_text("é. ü ö", 4, 1)[0] == "é."  # offsets are characters


@pytest.mark.parametrize("t,want", [("ab", (-0.718792, -0.695225)), ("abc", (-0.894427, -0.447214)), ("", (0, 0)), ("é", (0.851875, 0.523745))])
def test_embedder(spark, t, want):
    assert text.embed_text(t, 2) == pytest.approx(want, abs=1e-5)
    assert spark.createDataFrame([(t,)], "t string").select(text.deterministic_embed(F.col("t"), 2)).first()[0] == pytest.approx(want, abs=1e-5)


def test_tokens(spark):
    s = "L'étion, Dans_Çouelle 42½ straße! 日本語"
    assert text.tokens_of(s) == spark.createDataFrame([(s,)], "t string").select(text.tokens(F.col("t"))).first()[0] == ["l", "étion", "dans", "çouelle", "42½", "straße", "日本語"]


def test_metrics(spark):
    schema = "qid int, id int, rank int"
    p = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 9, 3)], schema)
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 5, 1)], schema)
    got = {r["qid"]: r for r in metrics.quality(p, e).collect()}
    assert (got[0]["recall"], got[0]["mrr"], got[0]["ndcg"]) == (pytest.approx(0.666667, abs=1e-6), 1.0, pytest.approx(0.650592, abs=1e-6))
    assert tuple(got[1])[1:] == (0.0, 0.0, 0.0)
    values = spark.range(1, 11).withColumn("v", F.col("id").cast("double"))
    for pct, want in ((30, 3), (50, 5), (95, 10)):
        assert values.agg(metrics.nearest_rank("v", pct)).first()[0] == want == metrics.percentile(range(1, 11), pct)
    none = metrics.latency_stats(values.filter("id > 99"), "v").first()
    assert none["ops"] == 0 and none["mean_ms"] == none["p99"] == none["ops_per_sec"] == 0 == metrics.percentile([], 50)
    assert metrics.latency_stats(values, "v").first()["ops_per_sec"] == pytest.approx(10 * 1000 / 55)


def test_profile(spark):
    df = spark.createDataFrame([([3.0, -4.0],), ([],), ([0.6, 0.8],)], "v array<float>")
    rows = [r[0] for r in df.select(V.profile(F.col("v"))).collect()]
    assert rows[0]["l2_norm"] == 5 and rows[0]["mean_abs"] == 3.5 and rows[1]["style"] == "empty embedding" and rows[2]["style"].startswith("likely") and rows[0]["style"].startswith("dense")


def test_canonical_json():
    assert canonical({"b": 1, "a": 1.0, "c": [1, 2.5, None]}) == '{"a":1.0,"b":1,"c":[1,2.5,null]}'
    for a, b in ((1, 1.0), ("1", 1), (["a"], "a")):
        assert canonical(a) != canonical(b)
    for bad in ("{", "NaN", '{"a":Infinity}'):
        with pytest.raises(SerdeError):
            loads(bad)


DOCS = ['{"x":"keep","source":"desk","metadata":{"source":"m","n":{"k":1}}}', '{"x":1,"source":"desk"}', '{"x":1.0,"source":null,"tags":["a","b"]}', '{"metadata":["source"],"tags":"a"}', "{}"]
CASES = [
    (Eq("source", "desk"), 2), (Eq("source", None), 1), (Eq("x", 1), 1), (Eq("x", 1.0), 1), (Eq("tags", "a"), 1), (Eq("tags", ["a", "b"]), 1), (Eq("metadata.source", "m"), 1),
    (Eq("metadata.n", {"k": 1}), 1), (Eq("metadata.n.k", 1), 1), (And(), 5), (And(Eq("source", "desk"), And(Eq("x", "keep"))), 1), (Eq("nothing", None), 0),
]


def test_filters(spark):
    df = spark.createDataFrame([(d,) for d in DOCS], "document string").withColumn("payload", derive("document")["payload"])
    for f, n in CASES:
        assert df.filter(filters.plan(f).condition).count() == n == sum(filters.matches(f, loads(d)) for d in DOCS), f
    assert filters.plan(Eq("source", 1)).fully_indexed and not filters.plan(And(Eq("source", 1), Eq("x", 1))).fully_indexed and not filters.plan(And()).fully_indexed
    assert [r[0] for r in df.select(json_path(F.col("document"), "source")).collect()] == ['"desk"', '"desk"', "null", None, None]
    assert "payload" in df.filter(filters.plan(Eq("source", "desk")).condition)._jdf.queryExecution().optimizedPlan().toString()


def test_fields():
    assert extract_title({"title": 1, "metadata": {"title": "t"}}) == "t" and extract_title({"title": "a", "metadata": {"title": "t"}}) == "a"
    assert extract_tags({"tags": [1, 2], "metadata": {"tags": ["x"]}}) == [] and extract_tags({"tags": 1, "metadata": {"tags": "x"}}) == ["x"]
    assert get_path({"a": [{"b": 1}]}, "a.b") is get_path({}, "a")
    assert derive_one('{"text":5,"tags":["b",1,"c"]}') == {"document": '{"tags":["b",1,"c"],"text":5}', "text": "", "title": "", "tags_text": "b c", "payload": {"tags": '["b",1,"c"]'}}
