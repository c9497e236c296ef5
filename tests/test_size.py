"""What a task holds doesn't follow its batches, its groups or its cells."""

import json
import math
import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparlode.functions import metrics, text
from sparlode.functions.json import derive
from sparlode.functions.pieces import PIECE, PIECE_ROWS, pieces
from sparlode.operators import ivf


def test_pieces():
    texts = pa.array(["x" * 700_000, "y" * 700_000, None, "z" * 3_000_000, *["w"] * 3000])
    cut = [c for (c,) in pieces(texts)]
    assert pa.chunked_array(cut).to_pylist() == texts.to_pylist()
    assert all(len(c) <= PIECE_ROWS and (len(c) == 1 or sum(len(t or "") for t in c.to_pylist()) <= PIECE) for c in cut)
    assert [len(c) for (c,) in pieces(pa.array([], type=pa.string()))] == [0]
    sliced = pa.array(["a", None, "bc"]).slice(1)
    assert [x.to_pylist() for x in next(pieces(sliced, pa.array([1, 2])))] == [[None, "bc"], [1, 2]]


def test_texts_leave_in_small_batches():
    docs = [json.dumps({"text": "word. " * 5000, "title": str(i)}) for i in range(200)]
    out = list(derive.func(iter([pa.array(docs)])))
    assert sum(map(len, out)) == 200 and max(map(len, out)) < 60
    assert pa.chunked_array(out).to_pylist()[7]["title"] == "7"


def test_split_over_pieces(spark):
    texts = [None, "", "a. " * 400_000, *(f"{i}. " * 300 for i in range(2500))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = dict(df.select("id", text.split(F.col("t"), 512, 64, "stop")).collect())
    assert got == {i: text.split_text(t, 512, 64, "stop") if t else [] for i, t in enumerate(texts)}


def test_nearest_cells_in_tiles():
    rng = np.random.default_rng(0)
    v, c = rng.normal(size=(4096, 4)), rng.normal(size=(2000, 4))
    tracemalloc.start()
    near = ivf.nearest_cells(v, c, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = ((v[:50, None] - c[None]) ** 2).sum(2)
    assert (near[:50] == d.argsort(axis=1, kind="stable")[:, :3]).all() and len(near) == 4096 and peak < 60e6


@pytest.mark.parametrize("keys", [(), ("a",), ("a", "b")])
def test_nearest_ranks(spark, keys):
    rng = random.Random(3)
    rows = [(rng.choice([None, "x", "y"]), rng.choice([1, 2, None]), rng.choice([None, -0.0, 0.0, *map(float, range(9))]) if i else float("nan")) for i in range(700)]
    rows += [("only nulls", 1, None)] * 3
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(5)
    percents = (0, 12.5, 30, 50, 95, 99.9, 100)
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r["ab".index(k)] for k in keys), []).append(r[2])
    want = {}
    for k, values in groups.items():
        s = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
        want[k] = tuple(s[max(1, math.ceil(len(s) * Fraction(str(p)) / 100)) - 1] if s else 0.0 for p in percents)
    got = {tuple(r)[: len(keys)]: tuple(r)[len(keys) :] for r in metrics.nearest_ranks(df, "v", percents, *keys).collect()}
    assert repr(sorted(got.items(), key=repr)).replace("-0.0", "0.0") == repr(sorted(want.items(), key=repr)).replace("-0.0", "0.0")
    stats = metrics.latency_stats(df, "v", *keys)
    assert stats.count() == len(groups) and "percentile" not in stats._jdf.queryExecution().toString()
