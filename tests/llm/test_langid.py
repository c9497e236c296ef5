import math
import re
from collections import Counter

import pytest

from sparlode.llm.langid import UNDECIDED, Model, fit, identify, train
from sparlode.llm.queries import op4_language


def test_known_words_first_then_shorter_grams():
    m = fit([("aa", Counter({"bonga": 9, "bongu": 5, "zz": 3})), ("bb", Counter({"tirri": 9, "tirra": 5, "zz": 3}))])
    assert m.word("bonga") == m.words["bonga"]
    longest = m.word("bongan")
    grams = [m.grams[4][g] for g in ("^bong", "bonga") if g in m.grams[4]]
    assert longest == tuple(sum(x) / len(grams) for x in zip(*grams, strict=True))
    assert m.word("xbo") == m.grams[1]["bo"]  # no longer gram of ^xbo$ is known, nor another of two letters
    assert m.word("語語") == m.word("語語") and len(m.word("語語")) == 2
    assert m.detect("bongan bongab")[0] == "aa" and m.detect("tirrik")[0] == "bb" and m.detect("zz")[0] == "aa"


def plain_score(train: list[tuple[str, str]], text: str) -> dict[str, float]:
    """The method once more, from the texts alone: word frequencies, then the longest known grams of each unknown word."""
    langs, words = sorted({k for k, _ in train}), [(k, w) for k, t in train for w in re.findall(r"[^\W\d_]+", t.lower())]

    def logs(items, least):
        tables = {k: Counter(x for y, x in items if y == k) for k in langs}
        known = [x for x, n in Counter(x for _, x in items).items() if n >= least]
        size = {k: sum(tables[k][x] + 0.5 for x in known) for k in langs}
        return {x: {k: math.log((tables[k][x] + 0.5) / size[k]) for k in langs} for x in known}

    by_word = logs(words, 2)
    grams = {n: logs([(k, p[i : i + n]) for k, w in words for p in [f"^{w}$"] for i in range(len(p) - n + 1)], 3) for n in range(1, 6)}
    total = dict.fromkeys(langs, 0.0)
    asked = re.findall(r"[^\W\d_]+", text.lower())
    for w in asked:
        found = [by_word[w]] if w in by_word else []
        for n in range(5, 0, -1):
            found = found or [grams[n][g] for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in grams[n]]
        for k in langs:
            total[k] += sum(f[k] for f in found) / len(found) if found else 0.0
    return {k: x / len(asked) for k, x in total.items()}


def test_scores_by_brute_force(spark, documents):
    train_rows = [(r["lang"], r["text"]) for r in documents.filter("doc_id % 9 = 0").collect()]
    m = fit((k, Counter(re.findall(r"[^\W\d_]+", t.lower()))) for k, t in train_rows)
    for r in documents.filter("doc_id % 9 = 1").limit(6).collect():
        want, got = plain_score(train_rows, r["text"] + " unknownword qxz 語"), m.scores(r["text"] + " unknownword qxz 語")
        assert all(math.isclose(got[i], want[k], rel_tol=1e-9) for i, k in enumerate(sorted(want)))
        assert m.detect(r["text"] + " unknownword qxz 語")[0] == max(want, key=want.get)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = train(spark, docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").collect()
    assert sum(m.detect(r["text"])[0] == r["lang"] for r in held) >= 0.97 * len(held)


def test_edges(spark, edge_docs, no_docs):
    got = identify(spark, edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r["detected"] in ("en", "fr", UNDECIDED) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["detected"], r["confidence"]))
    assert by[1] == by[2] == by[3] == by[9] == [(UNDECIDED, 0.0)] and len(set(by[8])) == 1 and len(by[8]) == 2 and by[6][0][0] == "en"
    assert identify(spark, no_docs).collect() == []
    unlabelled = edge_docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r["detected"] for r in identify(spark, unlabelled).collect()} == {UNDECIDED}
    assert Model([], {}, []).detect("abc") == (UNDECIDED, 0.0)


def test_query_agrees_with_the_model(spark, sf, documents):
    m = train(spark, documents)
    got = {r["doc_id"]: r["detected"] for r in op4_language(spark, sf).collect()}
    assert got == {r["doc_id"]: m.detect(r["text"])[0] for r in documents.collect()}


def test_too_many_languages_and_ids_of_another_kind(spark):
    df = spark.createDataFrame([(f"d{i}", f"word{i}", f"l{i}") for i in range(5)], "doc_id string, text string, lang string")
    with pytest.raises(ValueError):
        identify(spark, df, most_langs=4)
    assert {r["doc_id"] for r in identify(spark, df).collect()} == {f"d{i}" for i in range(5)}
