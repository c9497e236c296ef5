"""Operator 4, language identification by word-first backoff.

A known word gives each language its log frequency there; a word that no training text has is scored by its longest known
character n-grams, then by shorter ones. The model is a classifier, fitted on a bounded sample of labelled rows; every
document is scored over all its words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, drop_path, need, save, slices, worker_state

_word = re.compile(r"[^\W\d_]+")
LONGEST = 5
UNDECIDED = "und"


class Model:
    """Log frequencies of words and of character n-grams, by language."""

    def __init__(self, langs: list[str], words: dict[str, tuple[int, ...]], grams: list[dict[str, tuple[int, ...]]], smooth: float = 0.5):
        self.langs = langs
        self.words = self._logs(words, smooth)
        self.grams = [self._logs(g, smooth) for g in grams]  # by length, from 1
        self.kept: dict[str, tuple[float, ...]] = {}

    def _logs(self, counts: dict, smooth: float) -> dict:
        if not counts:
            return {}
        c = np.array(list(counts.values()), dtype=np.float64) + smooth
        logs = np.log(c / c.sum(axis=0))
        return dict(zip(counts, map(tuple, logs.tolist()), strict=True))

    def word(self, w: str) -> tuple[float, ...]:
        """One score for each language: log frequency of the word, or the mean over its n-grams of the greatest length that is known."""
        known = self.words.get(w)
        if known is not None:
            return known
        known = self.kept.get(w)
        if known is None:
            known = self.backoff(w)
            if len(self.kept) >= 300_000:
                self.kept.clear()
            if len(w) <= 64:
                self.kept[w] = known
        return known

    def backoff(self, w: str) -> tuple[float, ...]:
        padded = f"^{w}$"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            table = self.grams[n - 1]
            found = [table[g] for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in table]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return (0.0,) * len(self.langs)

    def scores(self, text: str) -> list[float] | None:
        """Mean score of the text's words for each language; None without a word."""
        words = _word.findall(text.lower())
        if not words or not self.langs:
            return None
        counts = Counter(words)
        table = np.array([self.word(w) for w in counts])
        return (np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) @ table / len(words)).tolist()

    def detect(self, text: str | None) -> tuple[str, float]:
        """(language, its share of the likelihoods, each taken to one over the number of words); of equal scores the first language by name."""
        s = None if text is None else self.scores(text)
        if s is None:
            return UNDECIDED, 0.0
        best = max(range(len(s)), key=lambda k: (s[k], -k))
        return self.langs[best], 1 / sum(math.exp(x - s[best]) for x in s)


def fit(rows, least_words: int = 2, least_grams: int = 3) -> Model:
    """From (language, {word: count}) pairs."""
    by: dict[str, Counter] = {}
    for lang, words in rows:
        by.setdefault(lang, Counter()).update(words)
    langs = sorted(by)
    total: Counter = Counter()
    for c in by.values():
        total.update(c)
    words = {w: tuple(by[x][w] for x in langs) for w, n in total.items() if n >= least_words}
    grams = []
    for n in range(1, LONGEST + 1):
        sums: dict[str, list[int]] = {}
        for k, x in enumerate(langs):
            for w, c in by[x].items():
                p = f"^{w}$"
                for i in range(len(p) - n + 1):
                    sums.setdefault(p[i : i + n], [0] * len(langs))[k] += c
        grams.append({g: tuple(v) for g, v in sums.items() if sum(v) >= least_grams})
    return Model(langs, words, grams)


def _count_batches(batches):
    for b in slices(batches, "text"):
        counts = [Counter(_word.findall(t.lower())) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in counts], type=pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], type=pa.list_(pa.int32()))], names=["lang", "words", "counts"])


def train(spark: SparkSession, docs: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = 400, most_langs: int = 300) -> Model:
    """Fitted on at most ``sample`` distinct texts of each language, those with the least hashes; rows without a language don't train."""
    need(docs, text, lang)
    t = col(text).cast("string")
    keys = docs.select(col(lang).cast("string").alias("lang"), F.xxhash64(t).alias("row_hash")).filter("lang IS NOT NULL").filter(t.isNotNull()).distinct()
    chosen = keys.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("row_hash"))).filter(F.col("n") <= sample).drop("n")
    chosen, chosen_path = save(spark, chosen, "langid-sample")
    if chosen.select("lang").distinct().count() > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    texts = docs.select(col(lang).cast("string").alias("lang"), t.alias("text")).withColumn("row_hash", F.xxhash64("text"))
    texts = texts.join(F.broadcast(chosen), ["lang", "row_hash"], "left_semi").groupBy("lang", "row_hash").agg(F.first("text").alias("text")).select("lang", "text")
    rows, rows_path = save(spark, texts.mapInArrow(_count_batches, "lang string, words array<string>, counts array<int>"), "langid-counts")
    model = fit((r[0], dict(zip(r[1], r[2], strict=True))) for r in rows.toLocalIterator())
    for p in (chosen_path, rows_path):
        drop_path(spark, p)
    return model


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None, *, id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """(doc_id, detected, confidence) for each row; the model is trained on the same rows' labels unless one is given.

    Null or empty text, or one without a letter: "und" with confidence 0. Very long texts count whole. Ties: the first
    language by name. Repeated rows: each is judged, alike; they train once. Null labels don't train; a table without any
    label gives "und" throughout. Over ``most_langs`` (300) different labels are an error, as the driver holds the model. Ids may be of
    any kind. Empty table: no rows. Extra columns don't matter.
    """
    need(docs, id, text)
    model = model or train(spark, docs, text=text, lang=lang, **how)
    shared, key = spark.sparkContext.broadcast((model.langs, model.words, model.grams)), uuid.uuid4().hex

    def run(batches):
        state = worker_state("langid")
        if state.get("langid", (None,))[0] != key:
            m = Model.__new__(Model)
            m.langs, m.words, m.grams = shared.value
            m.kept = {}
            state["langid"] = (key, m)
        m = state["langid"][1]
        for b in slices(batches, "text"):
            found = [m.detect(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())], names=["doc_id", "detected", "confidence"])

    return docs.select(col(id).alias("id"), col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, detected string, confidence double")
