import numpy as np

from sparlode.llm.queries import op2_toxicity
from sparlode.llm.toxicity import NAMES, VOTERS, LabelModel, fit_linear, learn_lexicons, toxic_documents, votes

from .conftest import prose


def drawn(n, accuracies, balance, linked=None, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < balance
    m = len(accuracies[0])
    on = np.where(y[:, None], rng.random((n, m)) < accuracies[1], rng.random((n, m)) < accuracies[0])
    if linked:
        a, b = linked
        on[:, b] = np.where(rng.random(n) < 0.9, on[:, a], on[:, b])
    masks = on @ (1 << np.arange(m))
    seen, counts = np.unique(masks, return_counts=True)
    return y, masks, seen, counts.astype(float)


def test_label_model_finds_accuracies_and_classes():
    accuracies = (np.array([0.002, 0.001, 0.004, 0.002, 0.003]), np.array([0.7, 0.5, 0.6, 0.4, 0.8]))
    y, masks, seen, counts = drawn(40_000, accuracies, 0.08)
    m = LabelModel(5).fit(seen, counts)
    assert abs(m.class_balance - 0.08) < 0.015
    assert np.abs(m.accuracies[1] - accuracies[1]).max() < 0.1
    assert ((m.posteriors[masks] > 0.5) == y).mean() > 0.985


def test_label_model_finds_the_correlated_pair():
    accuracies = (np.array([0.01, 0.01, 0.01, 0.01, 0.01, 0.01]), np.array([0.6, 0.6, 0.5, 0.7, 0.5, 0.6]))
    y, masks, seen, counts = drawn(60_000, accuracies, 0.1, linked=(1, 4))
    m = LabelModel(6).fit(seen, counts)
    assert (1, 4) in m.edges
    assert ((m.posteriors[masks] > 0.5) == y).mean() > 0.97
    # Two voters that copy each other count for less than two that don't.
    assert m.posteriors[0b010010] < m.posteriors[0b001010] or m.posteriors[0b010010] < 0.5


def test_nothing_voted_and_no_documents():
    assert LabelModel().fit(np.array([0]), np.array([100.0])).posteriors[0] <= 0.5
    assert LabelModel().fit(np.array([], dtype=int), np.array([])).posteriors[0] <= 0.5


def test_linear_model_separates():
    rows, y = [[0, 2], [0, 3], [1, 2], [1, 3]] * 20, np.array([1.0, 1, 0, 0] * 20)
    w, b = fit_linear(rows, y, np.ones(80), 4, 1e-3)
    assert w[0] + b > 0 > w[1] + b and abs(w[2]) < abs(w[0]) and abs(w[3]) < abs(w[0])


def test_votes():
    bit = lambda *n: sum(1 << NAMES.index(x) for x in n)
    assert votes(None) == votes("") == votes("a fine day") == 0
    assert votes("a long text about one moron " + prose(1, 400)) == bit("wit")
    assert votes("you are an idiot and a loser") & bit("wit", "worth", "addressed", "several", "dense") == bit("wit", "worth", "addressed", "several", "dense")
    assert votes("You absolute st*pid") & bit("masked") and votes("I will kill you") & bit("threat") and votes("IDIOT! " + prose(2, 300)) & bit("shouted")
    assert VOTERS <= 16
    for masked in ("sh!t", "stup!d", "b!tch", "1diot", "m0ron", "tr@sh", "a$$h0le"):
        assert votes("so " + masked + " " + prose(1, 30)) == bit("masked")


def test_planted_documents(spark):
    bad = ["idiot", "moron", "worthless", "pathetic", "scum", "clown", "loser", "stupid"]
    rows = []
    for i in range(600):
        words = prose(i, 80 + i % 50).split()
        if i % 12 == 0:
            for k in range(5):
                words.insert(7 * k + i % 5, bad[(i // 12 + k) % 8])
        rows.append((i, " ".join(words), i % 12 == 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    got = {r["doc_id"] for r in toxic_documents(spark, df).collect()}
    assert got == {i for i, _, y in rows if y}


def test_edges(spark, edge_docs, no_docs):
    assert toxic_documents(spark, edge_docs).collect() == []
    assert toxic_documents(spark, no_docs).collect() == []
    one = spark.createDataFrame([(None, "idiot moron scum you idiot"), (1, "idiot moron scum you idiot"), (1, "idiot moron scum you idiot"), (2, "fine")], "doc_id long, text string")
    assert toxic_documents(spark, one).count() in (0, 3)  # too few to train on, or all three


def test_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"] for r in op2_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    clean = [r["doc_id"] for r in labels if not r["toxic"]]
    voted = [r["doc_id"] for r in labels if r["toxic"] and votes(texts[r["doc_id"]])]
    assert len(got & set(clean)) <= 0.01 * len(clean)
    assert len(got & set(voted)) >= 0.9 * len(voted)


def test_learnt_lexicons(spark):
    rows = [(i, prose(i, 60) + (f" zork{'abcd'[i % 4]}mi" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    words, begins = learn_lexicons(spark, docs, labels)
    assert {b for b in begins} >= {"^zork"} and all(w.startswith("zork") for w in words)
    assert votes("some zorkqmi", words, begins) == 1 << NAMES.index("learnt beginnings")
    got = {r["doc_id"] for r in toxic_documents(spark, docs, labels).collect()}
    assert got == {i for i, _, y in rows if y}
    assert learn_lexicons(spark, docs, labels.limit(0)) == (frozenset(), frozenset())
    assert len(learn_lexicons(spark, docs, labels, most=1)[0]) + len(learn_lexicons(spark, docs, labels, most=1)[1]) == 1


def test_labelled_toxic_documents_are_found_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    got = {r["doc_id"] for r in op2_toxicity(spark, sf).collect()}
    toxic = {r["doc_id"] for r in labels if r["toxic"]}
    assert len(got & toxic) >= 0.8 * len(toxic) and len(got & ({r["doc_id"] for r in labels} - toxic)) <= 0.001 * len(labels)


def test_held_out_documents(spark):
    """Lexicons from the labels of even ids; the toxic ones among the odd ids are no part of what was learnt."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"] for r in toxic_documents(spark, docs, labels.filter("doc_id % 2 = 0")).collect()}
    odd = labels.filter("doc_id % 2 = 1").collect()
    toxic, clean = ({r["doc_id"] for r in odd if r["toxic"] == y} for y in (1, 0))
    print("held out:", len(got & toxic), "of", len(toxic), "and", len(got & clean), "of", len(clean))
    assert len(got & toxic) >= 0.75 * len(toxic) and len(got & clean) <= 0.001 * len(clean)


def test_label_model_by_enumeration():
    """The joint model's posteriors are those of its parameters, and it explains the masks better than independent voters do."""
    accuracies = (np.array([0.01, 0.01, 0.01, 0.01]), np.array([0.6, 0.6, 0.5, 0.7]))
    y, masks, seen, counts = drawn(50_000, accuracies, 0.1, linked=(0, 2), seed=3)
    m = LabelModel(4).fit(seen, counts)
    truth = np.array([y[masks == k].mean() if (masks == k).any() else np.nan for k in range(16)])
    often = np.bincount(masks, minlength=16) > 200
    assert np.nanmax(np.abs(m.posteriors - truth)[often]) < 0.2
