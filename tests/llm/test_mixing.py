import math
import random

import pytest

from sparlode.llm.mixing import _hashes, _token, flight, inclusion, land, mix, token_count, tokens_of
from sparlode.llm.queries import op5_mixing

from .conftest import prose


def test_inclusion():
    p = inclusion({"a": (10, 1000), "b": (10, 100), "c": (3, 0), "d": (5, 50)}, {"a": 1, "b": 1, "c": 1})
    assert p == {"a": pytest.approx(0.1), "b": 1.0, "c": 1.0, "d": 0.0}
    p = inclusion({"a": (10, 1000), "b": (10, 100)}, None, 0.5)
    assert p["b"] == 1.0 and p["a"] == pytest.approx((1000**0.5 * 100 / 100**0.5) / 1000)
    with pytest.raises(ValueError):
        inclusion({"a": (1, 1)}, {"a": -1})


@pytest.mark.parametrize("p", [0.1, 0.5, 0.9])
def test_flight_keeps_both_totals(p):
    rng = random.Random(1)
    sizes = [rng.randint(1, 2000) for _ in range(800)]
    held, decided = [], []
    for i, n in enumerate(sizes):
        flight(held, [p, n, i], 3, decided)
        assert len(held) <= 2
        assert sum(x[0] for x in held + decided) == pytest.approx(p * (i + 1), abs=1e-6)
        assert sum(x[0] * x[1] for x in held + decided) == pytest.approx(p * sum(sizes[: i + 1]), rel=1e-6)
    decided += land(held, 3)
    chosen = [x for x in decided if x[0] == 1.0]
    assert len(decided) == 800 and abs(len(chosen) - 800 * p) <= 1
    assert abs(sum(x[1] for x in chosen) - p * sum(sizes)) <= 2 * max(sizes)


def test_inclusion_is_fair():
    counts = [0] * 12
    for seed in range(1500):
        held, decided = [], []
        for i in range(12):
            flight(held, [0.3, 5 + i * i, i], seed, decided)
        for x in decided + land(held, seed):
            counts[x[2]] += x[0]
    assert all(0.24 < c / 1500 < 0.36 for c in counts)


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.randint(5, 300)), "ab"[i % 3 == 0]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/mix-in")
    docs = spark.read.parquet(path)
    out = mix(spark, docs, targets={"a": 1, "b": 3}, count="n").collect()
    tokens = {s: sum(tokens_of(t) for _, t, x in rows if x == s) for s in "ab"}
    share = inclusion({s: (0, tokens[s]) for s in "ab"}, {"a": 1, "b": 3})
    for s in "ab":
        mine = [r for r in out if r["source"] == s]
        assert abs(len(mine) - share[s] * sum(x == s for _, _, x in rows)) <= 1
        assert abs(sum(r["n"] for r in mine) - share[s] * tokens[s]) <= 600
    assert len({r["doc_id"] for r in out}) == len(out) and all(r["n"] == tokens_of(r["text"]) for r in out)
    assert sorted(r["doc_id"] for r in mix(spark, docs, targets={"a": 1, "b": 3}).collect()) == sorted(r["doc_id"] for r in out)


def test_tokens(spark):
    texts = ["", None, " a  b\u3000c\n", "日本語 テキスト x", "a語b", "\U00020001\U00020002 é", "\x1f\x85\xa0", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(token_count(df["t"])).collect()] == [tokens_of(t) for t in texts] == [0 if t is None else len(_token.findall(t)) for t in texts] == [0, 0, 3, 8, 3, 3, 0, 1]


def plain_sample(units, p: dict, bucket: int, seed: int = 11) -> dict:
    """The method without Spark: key to how many copies stay. units: (hash, hash, source, tokens, copies, key)."""
    buckets = max(1, math.ceil(sum(u[4] for u in units) / bucket))
    taken, left = {}, {}
    for b in range(buckets):
        held, decided = {}, []
        for a, c, s, t, m, i in sorted((u for u in units if u[0] % buckets == b), key=lambda u: u[:2]):
            taken[i] = int(p[s] * m + 1e-9)
            rest = p[s] * m - taken[i]
            flight(held.setdefault(s, []), [rest if rest > 1e-9 else 0.0, t, (a, c), i], seed, decided)
        for x in decided:
            taken[x[3]] += int(x[0])
        for s, us in held.items():
            left.setdefault(s, []).extend(us)
    for us in left.values():
        held, decided = [], []
        for x in sorted(us, key=lambda x: x[2]):
            flight(held, x, seed, decided)
        for x in decided + land(held, seed):
            taken[x[3]] += int(x[0])
    return {i: n for i, n in taken.items() if n}


def sums_of(units) -> dict:
    totals = {}
    for _, _, s, t, m, _ in units:
        d, n = totals.get(s, (0, 0))
        totals[s] = (d + m, n + m * t)
    return totals


def test_the_sample_is_that_of_the_rows(spark):
    """A copy of the method without Spark decides alike, whatever the order and the files."""
    rows = [(i, prose(i, 5 + i % 90), "abc"[i % 3]) for i in range(700)] + [(5000, prose(1, 20), "a")] * 40 + [(5001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = dict(targets={"a": 2, "b": 3, "c": 1, None: 1}, bucket=100)
    got = [sorted(map(tuple, mix(spark, d, **how).collect()), key=repr) for d in (docs.repartition(3), docs.orderBy(docs["doc_id"].desc()).coalesce(1), docs.repartition(7, "text"))]
    assert got[0] == got[1] == got[2]
    units = [(r[3], r[4], r[2], tokens_of(r[1]), rows.count((r[0], r[1], r[2])), r[0]) for r in docs.select("*", *_hashes(docs)).distinct().collect()]
    count = {}
    for r in got[0]:
        count[r[0]] = count.get(r[0], 0) + 1
    assert count == plain_sample(units, inclusion(sums_of(units), how["targets"]), 100) and 0 < count[5000] < 40


def test_shuffled_joins_decide_alike(spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 90), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    few = [sorted(r["doc_id"] for r in mix(spark, docs, share=x, broadcast_rows=n).collect()) for x in (0.2, 0.8) for n in (0, 1000)]
    assert few[0] == few[1] and few[2] == few[3] and len(few[0]) < 100 < 200 < len(few[2])


def test_edges(spark, edge_docs, no_docs):
    clash = mix(spark, spark.createDataFrame([(1, "a b", "s", 7)], "doc_id long, text string, source string, n long"), count="n")
    assert clash.columns == ["doc_id", "text", "source", "n", "n_"] and [r["n_"] for r in clash.collect()] == [2]
    out = mix(spark, edge_docs)
    assert out.schema == edge_docs.schema and 0 < out.count() <= edge_docs.count()
    everything = mix(spark, edge_docs, targets={"a": 0, "b": 1, None: 1}).collect()
    assert not any(r["source"] == "a" for r in everything)
    assert mix(spark, no_docs).collect() == [] and mix(spark, edge_docs, targets={}).collect() == []


def test_query(spark, sf, documents):
    out = op5_mixing(spark, sf).collect()
    texts = {r["doc_id"]: (r["source"], tokens_of(r["text"])) for r in documents.collect()}
    assert len({r["doc_id"] for r in out}) == len(out) and all(texts[r["doc_id"]] == (r["source"], r["n_tokens"]) for r in out)
    totals = {}
    for s, n in texts.values():
        d, t = totals.get(s, (0, 0))
        totals[s] = (d + 1, t + n)
    for s, p in inclusion(totals).items():
        mine = [r["n_tokens"] for r in out if r["source"] == s]
        assert abs(len(mine) - p * totals[s][0]) <= 1 + 1e-9
        assert abs(sum(mine) - p * totals[s][1]) <= 2 * max(n for x, n in texts.values() if x == s)


def test_budget_and_small_sources():
    even = {str(s): (500, 200_000) for s in range(20)}

    def kept(totals, **how):
        p = inclusion(totals, **how)
        return sum(p[s] * t for s, (_, t) in totals.items()) / sum(t for _, t in totals.values())

    for stray in (5, 500, 20_000):
        assert kept({**even, None: (1, stray)}) > 0.99 and inclusion({**even, None: (1, stray)})[None] == 1.0
    large = {**even, "large": (100_000, 40_000_000)}
    assert kept(large) < 0.3 and kept(large, least=0.8) == pytest.approx(0.8) and kept(large, share=0.5) == pytest.approx(0.5)
    assert kept(large, tokens=2_200_000) == pytest.approx(0.05) and set(inclusion(large, share=1.0).values()) == {1.0}
    p = inclusion({"a": (1, 1000), "b": (1, 1000), "c": (1, 90)}, {"a": 1, "b": 2, "c": 2}, tokens=990)
    assert p == {"a": pytest.approx(0.3), "b": pytest.approx(0.6), "c": 1.0}
    with pytest.raises(ValueError):
        inclusion(even, share=1.5)


def test_query_with_a_stray_document(spark, tmp_path):
    rows = [(i, prose(i, 200), f"s{i % 4}") for i in range(400)] + [(400, "one two three four five", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op5_mixing(spark, str(tmp_path)).count() == 401
