import random

import numpy as np

from sparlode.llm.quality import D, FLOOR, estimate, quality_filter, rejected, statistics
from sparlode.llm.queries import op10_quality

from .conftest import prose


def corpus(n: int, seed: int = 0):
    rng = random.Random(seed)
    good = [(i, prose(seed * 10_000 + i, rng.randint(60, 300)).capitalize() + ".", "en", "a") for i in range(n)]
    bad = [(n + i, ("%$# " * 3 + "@@!! ") * 60, "en", "a") for i in range(n // 20)] + [(2 * n + i, "SHOUT NOW " * 120, "en", "a") for i in range(n // 20)]
    return good, bad


def by_hand(x: np.ndarray, h: float = 0.75, starts: int = 60):
    """(mean, covariance) of the nearest share with the least determinant: random starts and exact concentration steps."""
    rng, n, best = np.random.default_rng(1), int(np.ceil(h * len(x))), None
    floor = np.diag(np.square(FLOOR))
    for _ in range(starts):
        near = x[rng.choice(len(x), 12, replace=False)]
        old = np.inf
        while True:
            m, c = near.mean(0), np.cov(near.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d, kind="stable")[:n]]
            det = np.linalg.slogdet(np.cov(near.T, bias=True) + floor)[1]
            if det >= old - 1e-9:
                break
            old = det
        if best is None or old < best[0]:
            best = (old, near)
    return best[0], best[1].mean(0), np.cov(best[1].T, bias=True)


def plain_statistics(text: str):
    """The statistics once more, character by character."""
    import math
    import unicodedata

    words = text.split()
    letters = upper = other = solid = 0
    for c in text:
        solid += not c.isspace()
        letters += c.isalpha()
        upper += c.isalpha() and c.isupper()
        other += not (c.isspace() or c.isalpha() or c.isnumeric() or unicodedata.combining(c))
    logit = lambda a, b: math.log(a / b / (1 - a / b))
    return [math.log((letters + 50) / (len(words) + 10)), logit(other + 9, solid + 300), logit(upper + 9, letters + 300), math.log(len(set(words)) + 20) / math.log(len(words) + 20), logit(sum(len(w) < 4 for w in words) + 12, len(words) + 30)]


def test_statistics():
    assert statistics(None) is None and statistics("") is None and statistics(" \n") is None
    assert len(statistics("x")) == D
    a, b = np.array(statistics(prose(1, 300))), np.array(statistics(prose(1, 300) + " " + prose(2, 300)))
    assert np.abs(a - b).max() < 0.6
    assert np.isfinite(statistics("x" * 200_000)).all() and np.isfinite(statistics("\ud800 a")).all()


def test_statistics_by_characters(documents):
    texts = [r["text"] for r in documents.collect() if r["text"].split()] + ["\U00020000\U0001d400 \U0001f600 e\u0301 Ⅷ"]
    for t in texts:
        assert np.allclose(statistics(t), plain_statistics(t), atol=1e-12)


def test_the_determinant_is_the_least(spark):
    good, bad = corpus(400)
    # A cluster of outliers that is dense and lies at one side, a quarter of all but a few.
    bad += [(9000 + i, " ".join(prose(i, 30).split() * 6), "en", "a") for i in range(70)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    p = np.array(estimate(spark, df).first()["params"])
    x = np.array([plain_statistics(t) for _, t, _, _ in good + bad])
    det, centre, _ = by_hand(x)
    spread = np.array([plain_statistics(t) for _, t, _, _ in good]).std(0) + np.array(FLOOR)
    assert (np.abs(p[:D] - centre) < 0.5 * spread).all()
    # Not the mean, which the outliers move.
    assert np.abs(x.mean(0) - centre).max() > 3 * np.abs(p[:D] - centre).max()
    # The nearest share h by this estimate is about as tight as the best of many random starts.
    d = np.einsum("ij,jk,ik->i", x - p[:D], p[D : D + D * D].reshape(D, D), x - p[:D])
    near = x[np.argsort(d)[: int(np.ceil(0.75 * len(x)))]]
    assert np.linalg.slogdet(np.cov(near.T, bias=True) + np.diag(np.square(FLOOR)))[1] < det + 0.1
    gone = {i for (i, *_), far in zip(good + bad, d > p[-1], strict=True) if far}
    kept = {r["doc_id"] for r in quality_filter(spark, df).collect()}
    assert kept == {i for i, *_ in good + bad} - gone and len(gone) >= 40


def test_planted_outliers_go_and_clean_ones_stay(spark):
    good, bad = corpus(400, 1)
    kept = {r["doc_id"] for r in quality_filter(spark, spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert len(kept & {g[0] for g in good}) >= 0.99 * len(good)
    assert len(kept & {b[0] for b in bad}) <= 0.05 * len(bad)


def test_decisions_are_those_of_the_estimate(spark, sf, documents):
    params = {(r["lang"], r["source"]): r["params"] for r in estimate(spark, documents).collect()}
    want = sorted(r["doc_id"] for r in documents.collect() if not rejected(r["text"], params[r["lang"], r["source"]]))
    assert sorted(r["doc_id"] for r in op10_quality(spark, sf).collect()) == want


def test_small_groups_are_pooled(spark):
    rows = [(i, prose(i, 80), "en", f"s{i}") for i in range(80)] + [(100 + i, prose(i, 80), "fr", "t") for i in range(3)]
    params = {(r["lang"], r["source"]): r["params"] for r in estimate(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len({tuple(params["en", f"s{i}"]) for i in range(80)}) == 1 and params["fr", "t"] is None
    assert not rejected("!!!", None)


def test_edges(spark, edge_docs, no_docs):
    kept = quality_filter(spark, edge_docs)
    assert kept.schema == edge_docs.schema and kept.count() == edge_docs.count()
    assert quality_filter(spark, no_docs).collect() == []
    same = spark.createDataFrame([(i, "the very same text again", None, None) for i in range(120)], "doc_id long, text string, lang string, source string")
    assert quality_filter(spark, same).count() == 120
