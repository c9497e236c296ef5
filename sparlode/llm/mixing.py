"""Operator 5, mixing sources to target weights by balanced sampling with the cube method (Deville and Tille 2004).

Target weights and the tokens of each source give every document of a source one inclusion probability. The flight phase
moves the vector of fractional inclusion indicators through the null space of the balancing constraints (documents and
tokens of the source), so that both totals stay at their targets while one indicator after another becomes 0 or 1
(fast flight: Chauvet and Tille 2006). It runs over narrow rows (hash of the document, source, tokens), in buckets by the hash
and in its order, so the sample is a function of the documents and the seed alone, however they lie in files. A task holds one
bucket of about 100,000 rows and never more than three undecided documents of a source; the few that are left go through a second
flight for each source, and the one or two that are then left are the landing problem: the token constraint is dropped there.

Equal rows are one unit with so many copies: all of them but a fraction are decided at once. Texts are read twice and written
once; they aren't shuffled as long as the documents that go, or those that stay, are few enough for a
broadcast of their hashes.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_path, fresh, need, save

#: Of the tokens, at least this share stays in production, however unequal the sources are.
LEAST_KEPT = 0.8


_SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_IDEOGRAPHS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_token = re.compile(f"[{_IDEOGRAPHS}]|[^{_SPACE}{_IDEOGRAPHS}]+")
_ideograph = re.compile(f"[{_IDEOGRAPHS}]")


def tokens_of(text: str | None) -> int:
    """Tokens: what is between white space, but each ideograph or kana for itself."""
    if text is None:
        return 0
    return len(text.split()) if text.isascii() or not _ideograph.search(text) else len(_token.findall(text))


def token_count(text: Column) -> Column:
    """The same as a column. Arrow batches: a regular expression in the JVM takes 2.5 times the CPU."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([tokens_of(t) for t in texts.to_pylist()], type=pa.int64())

    return count(text)


def _random(seed: int, *parts) -> float:
    return xxhash.xxh3_64_intdigest(repr(parts).encode("utf-8", "surrogatepass"), seed=seed) / 2.0**64


def step(units: list[list], u: float, rows: int) -> None:
    """Move the indicators of ``units`` ([indicator, tokens, ...]; one more than ``rows``) through the null space of the first ``rows`` constraints, until one is 0 or 1.

    ``u`` in [0, 1) chooses between the two ends of the segment so that the expected indicators stay as they are.
    """
    if rows == 2:
        (a, b, c) = (x[1] for x in units)
        v = [c - b, a - c, b - a]
        if not any(v):
            v = [1.0, -1.0, 0.0]
    elif rows == 1:
        v = [1.0, -1.0]
    else:
        v = [1.0]
    up = min(((1 - x[0]) / d if d > 0 else x[0] / -d) for x, d in zip(units, v, strict=True) if d)
    down = min((x[0] / d if d > 0 else (1 - x[0]) / -d) for x, d in zip(units, v, strict=True) if d)
    move = up if u * (up + down) < down else -down
    best, at = 2.0, 0
    for k, (x, d) in enumerate(zip(units, v, strict=True)):
        if d:
            x[0] = min(1.0, max(0.0, x[0] + move * d))
            if min(x[0], 1 - x[0]) < best:
                best, at = min(x[0], 1 - x[0]), k
    units[at][0] = float(round(units[at][0]))
    for x in units:
        if x[0] < 1e-12 or x[0] > 1 - 1e-12:
            x[0] = float(round(x[0]))


def flight(held: list[list], unit: list, seed: int, decided: list, rows: int = 2) -> None:
    """Take ``unit`` among the undecided ``held``; those that are decided by it go to ``decided``. A unit: [indicator, tokens, key, ...]."""
    if unit[0] in (0.0, 1.0):
        decided.append(unit)
        return
    held.append(unit)
    while len(held) > rows:
        step(held, _random(seed, *(x[2] for x in held)), rows)
        decided += [x for x in held if x[0] in (0.0, 1.0)]
        held[:] = [x for x in held if x[0] not in (0.0, 1.0)]


def land(held: list[list], seed: int) -> list[list]:
    """Decide all: the flight with fewer and fewer constraints."""
    decided: list[list] = []
    for rows in (2, 1, 0):
        while len(held) > rows:
            part = held[: rows + 1]
            step(part, _random(seed, rows, *(x[2] for x in part)), rows)
            decided += [x for x in part if x[0] in (0.0, 1.0)]
            held[:] = [x for x in held if x[0] not in (0.0, 1.0)]
    return decided


def _scale(full: list[tuple], budget: float) -> float:
    """The scale at which the sources (tokens / weight, tokens, weight; ascending) give ``budget`` tokens, each at most those it has."""
    if budget >= sum(t for _, t, _ in full):
        return full[-1][0] if full else 0.0
    done, rest = 0.0, math.fsum(w for _, _, w in full)
    for most, t, w in full:
        if done + most * rest >= budget:
            return (budget - done) / rest
        done, rest = done + t, rest - w
    return full[-1][0] if full else 0.0


def inclusion(
    totals: dict, targets: dict | None = None, temperature: float = 0.7, *,
    tokens: float | None = None, share: float | None = None, least: float = 0.0, short: float = 0.01,
) -> dict:
    """Source to inclusion probability, without repeating a document.

    ``totals``: source to (documents, tokens). ``targets``: source to weight of its tokens; sources that are not named get 0
    and those that have no tokens count for nothing. None: weights are the token totals to the power of ``temperature``. A
    source without tokens has probability 1 if its weight is not 0.

    The size of the sample is ``tokens``, or ``share`` of the tokens of all sources with a weight. A source that has fewer
    than its target is taken whole, and the others share what it lacks by their weights. Without a budget, the size is the
    largest at which some source just reaches its target and all that fall short together lack at most ``short`` of the
    sample, so a tiny source doesn't shrink the others; but not under ``least`` of the tokens.
    """
    weight = {s: (float(t) ** temperature if t else 1.0) if targets is None else float(targets.get(s, 0.0)) for s, (_, t) in totals.items()}
    if any(w < 0 or math.isnan(w) for w in weight.values()):
        raise ValueError("weights must be at least 0")
    if tokens is not None and share is not None or tokens is not None and not tokens >= 0 or not 0 <= (share or 0.0) <= 1 or not 0 <= least <= 1:
        raise ValueError("the budget is either tokens, at least 0, or a share from 0 to 1")
    full = sorted((t / weight[s], t, weight[s]) for s, (_, t) in totals.items() if t and weight[s] > 0)
    there, weights = sum(t for _, t, _ in full), math.fsum(w for _, _, w in full)
    if tokens is not None or share is not None:
        scale = _scale(full, min(tokens if tokens is not None else share * there, there))
    else:
        scale = lack_t = lack_w = 0.0
        for most, t, w in full:
            if scale and lack_w * most - lack_t > short * weights * most:
                break
            scale, lack_t, lack_w = most, lack_t + t, lack_w + w
        scale = max(scale, _scale(full, least * there))
    return {s: (1.0 if scale * weight[s] >= t else weight[s] * scale / t) if t else float(weight[s] > 0) for s, (_, t) in totals.items()}


def source_totals(docs: DataFrame, *, text: str = "text", source: str = "source") -> DataFrame:
    """(source, documents, tokens) over the whole table."""
    narrow = docs.select(col(source).cast("string").alias("source"), token_count(col(text).cast("string")).alias("tokens"))
    return narrow.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def _hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes over all columns; rows that agree in both (128 bits) count as equal."""
    parts = [F.to_json(F.struct(col(f.name))) if "map<" in f.dataType.simpleString() else col(f.name) for f in docs.schema]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def mix(
    spark: SparkSession, docs: DataFrame, *, targets: dict | None = None, temperature: float = 0.7, seed: int = 11,
    text: str = "text", source: str = "source", columns: list[str] | None = None, count: str | None = None,
    most_sources: int = 1_000_000, tokens: float | None = None, share: float | None = None, least: float = 0.0, short: float = 0.01,
    bucket: int = 100_000, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """The sampled documents: all columns, or ``columns``; with ``count``, their tokens in a column of that name.

    ``tokens``, ``share``, ``least`` and ``short`` set the size of the sample, see ``inclusion``.

    In each source the number of documents is within 1 of its target, and the tokens are within about one long document
    of theirs. The sample is a function of the rows and the seed, not of their order or files. The hashes of the documents that go
    (or stay) are broadcast up to ``broadcast_rows`` of them (about 80 MB at the default), beyond that joined by a shuffle.

    Null source: a source of its own, named None in ``targets``. Null or empty text: no tokens, but a document that counts.
    Very long texts count whole. Ties in tokens are moved along documents alone. Repeated rows are documents of their own.
    Empty table: empty result. Extra columns pass through whatever their names; if one has the name ``count``, underscores are
    added to that. Over ``most_sources`` sources are refused: their totals are held by the driver.
    """
    need(docs, text, source)
    names = docs.columns if columns is None else list(columns)
    k1, k2 = fresh(docs, "_mix_1"), fresh(docs, "_mix_2")
    one, two = _hashes(docs)
    narrow = docs.select(one.alias("k1"), two.alias("k2"), col(source).cast("string").alias("source"), token_count(col(text).cast("string")).alias("tokens"))
    units, units_path = save(spark, narrow.groupBy("k1", "k2").agg(F.first("source").alias("source"), F.first("tokens").alias("tokens"), F.count("*").alias("copies")), "mix-units")
    sums = units.groupBy("source").agg(F.sum("copies").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    totals = {r[0]: (r[1], r[2]) for r in sums.take(most_sources + 1)}
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    shares = spark.sparkContext.broadcast(inclusion(totals, targets, temperature, tokens=tokens, share=share, least=least, short=short))
    buckets = max(1, math.ceil(sum(d for d, _ in totals.values()) / bucket))
    fly = units.withColumn("bucket", F.pmod("k1", F.lit(buckets))).groupBy("bucket").applyInPandas(_first(seed, shares), "k1 long, k2 long, source string, tokens long, copies long, taken long, left double")
    flown, flown_path = save(spark, fly, "mix-flown")
    won, won_path = save(spark, flown.filter("left > 0").groupBy("source").applyInPandas(_second(seed), "k1 long, k2 long"), "mix-landed")
    decided = flown.join(won.withColumn("won", F.lit(1)), ["k1", "k2"], "left")
    decided = decided.select("k1", "k2", "copies", (F.col("taken") + F.coalesce("won", F.lit(0))).alias("taken"))
    decided, decided_path = save(spark, decided, "mix-decided")
    for p in (units_path, flown_path, won_path):
        drop_path(spark, p)
    goes, stays, partly = decided.agg(*(F.count_if(F.expr(c)) for c in ("taken < copies", "taken > 0", "taken > 0 AND taken < copies"))).first() if totals else (0, 0, 0)

    def some(which: str, n: int) -> DataFrame:
        rows = decided.filter(which).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
        return F.broadcast(rows) if n <= broadcast_rows else rows

    hashed = docs.withColumns({k1: one, k2: two})
    if stays - partly < goes:
        whole = hashed.join(some("taken > 0 AND taken = copies", stays - partly), [k1, k2], "left_semi")
    else:
        whole = hashed.join(some("taken < copies", goes), [k1, k2], "left_anti")
    out = whole.select(*map(col, docs.columns))
    if partly:  # of equal rows some stay: one of them is written so many times
        row, n, at = fresh(docs, "_mix_row"), fresh(docs, "_mix_n"), fresh(docs, "_mix_at")
        first = hashed.join(some("taken > 0 AND taken < copies", partly), [k1, k2], "left_semi").groupBy(k1, k2).agg(F.first(F.struct(*map(col, docs.columns))).alias(row))
        take = decided.filter("taken > 0 AND taken < copies").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("taken").alias(n))
        first = first.join(take, [k1, k2]).withColumn(at, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / 1000).cast("int")))).repartition(k1, k2, at)
        first = first.withColumn(at, F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col(n) - 1000 * F.col(at)).cast("int"))))
        out = out.unionByName(first.select(F.col(f"{row}.*")))
    chosen = out.select(*map(col, names))
    return chosen if not count else out.select(*map(col, names), token_count(col(text).cast("string")).alias(fresh(chosen, count)))


def _first(seed: int, shares):
    """The flight over one bucket, in the order of the hashes. left: the fraction of one copy that isn't decided."""

    def first(pdf):
        pdf = pdf.sort_values(["k1", "k2"])
        held: dict = {}
        decided: list = []
        taken = np.zeros(len(pdf), dtype=np.int64)
        known = shares.value
        for k, (a, b, s, t, m) in enumerate(zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["source"].tolist(), pdf["tokens"].tolist(), pdf["copies"].tolist(), strict=True)):
            s = s if isinstance(s, str) else None
            exact = known.get(s, 0.0) * m
            taken[k] = int(exact + 1e-9)
            flight(held.setdefault(s, []), [min(max(exact - float(taken[k]), 0.0), 1.0) if exact - taken[k] > 1e-9 else 0.0, t, (a, b), k], seed, decided)
        for x in decided:
            taken[x[3]] += x[0] == 1.0
        left = np.zeros(len(pdf))
        for units in held.values():
            for x in units:
                left[x[3]] = x[0]
        return pdf[["k1", "k2", "source", "tokens", "copies"]].assign(taken=taken, left=left)

    return first


def _second(seed: int):
    def second(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["k1", "k2"])
        held, decided = [], []
        for left, t, a, b in zip(pdf["left"].tolist(), pdf["tokens"].tolist(), pdf["k1"].tolist(), pdf["k2"].tolist(), strict=True):
            flight(held, [left, t, (a, b)], seed, decided)
        decided += land(held, seed)
        return pd.DataFrame([x[2] for x in decided if x[0] == 1.0], columns=["k1", "k2"]).astype("int64")

    return second
