"""Operator 2, toxicity by weak supervision.

Lexicon and pattern voters look at each document; their votes are a bit mask, and the counts of the masks over the whole
table (at most 2**VOTERS of them) are all that the label model needs. It is generative: a latent class, one accuracy term for
each voter and class, and correlation terms for pairs of voters that agree more than their accuracies explain; it is fitted
by likelihood with exact sums over all masks. Its posteriors label a bounded training sample for a linear classifier over words
(logistic regression with an L1 penalty), which then scores every document, whole.

Where a bounded sample of labelled rows is given, two more lexicons are learnt from it, of words and of beginnings of words that
toxic rows have and clean ones hardly ever: insults that no list knows. They vote like the others; the model judges them, not the labels.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_path, need, save, slices, whole_id

_word = re.compile(r"\w+")
#: Forms that are ordinary words in another of the languages are left out.
LEXICONS = {
    "wit": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile dumb dumbass fool fools retard retarded dimwit halfwit nitwit cretin brainless dunce",
    "worth": "worthless loser losers useless pathetic failure nobody waste pitiful hopeless inferior coward cowards",
    "disgust": "disgusting scum trash garbage filth filthy vermin vomit pigs parasite parasites maggot cockroach subhuman revolting repulsive",
    "ridicule": "clown clowns freak freaks creep creeps buffoon laughingstock weirdo joke crybaby lunatic psycho hypocrite liar liars fraud",
    "profanity": "fuck fucking fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes crap dickhead prick slut whore jerk douchebag motherfucker",
    "german": "idioten trottel dummkopf depp deppen vollidiot arschloch scheiße schwachkopf versager abschaum wertlos widerlich ekelhaft drecksack mistkerl hurensohn blödmann",
    "french": "connard connards connasse salaud salope crétin imbécile abruti débile enculé merde ordure minable dégueulasse pourriture raté",
    "spanish": "idiota idiotas imbécil estúpido estúpida cabrón pendejo gilipollas basura escoria inútil asqueroso asquerosa mierda puta tonto payaso fracasado",
}
_HARSH = {w for k in ("wit", "worth", "disgust", "ridicule", "profanity", "german", "french", "spanish") for w in LEXICONS[k].split()}
_OF = {w: i for i, k in enumerate(LEXICONS) for w in LEXICONS[k].split()}
_AMBIGUOUS = {"nobody", "waste", "failure", "pigs", "joke", "fraud", "fool", "fools", "raté", "tonto", "basura", "hopeless", "inferior"}
_threat = re.compile(r"(?i)\b(?:i(?:'ll| will)? (?:kill|hurt|destroy|beat) you|kill yourself|go die|hope you die|you (?:deserve to|should|will|must) die|shut up)\b")
_masked = re.compile(r"(?i)\b(?:[1!]d[i1!]ot|m[0*o]r[0*o]n|st[*u]p[*1!i]d|f[*u][*c]k\w*|sh[*1!]t\w*|b[*1!]tch\w*|a[s$]{2}h[*0]le|l[0*]ser|tr[*@]sh|sc[*]m)\b")
_signs = frozenset("*10@$!")
_you = {"you", "your", "youre", "u", "du", "dich", "ihr", "tu", "vous", "toi", "tú", "usted", "eres"}
NAMES = [*LEXICONS, "addressed", "several", "dense", "shouted", "threat", "masked", "learnt words", "learnt beginnings"]
NOTHING: frozenset = frozenset()
VOTERS = len(NAMES)


def beginnings(words) -> set[str]:
    """The first four and the first five letters of words that are longer, marked."""
    return {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


def votes(text: str | None, learnt: frozenset = NOTHING, begins: frozenset = NOTHING) -> int:
    """The bit mask of the voters that call the text toxic; bits as in NAMES. Null and empty texts get no vote."""
    if not text:
        return 0
    low = text.lower()
    words = _word.findall(low)
    distinct = set(words)
    hits = distinct & _HARSH
    mask = 0
    for w in hits:
        mask |= 1 << _OF[w]
    base = len(LEXICONS)
    known = distinct & learnt
    if known:
        mask |= 1 << (base + 6)
        hits |= known
    if begins and not begins.isdisjoint(beginnings(distinct)):
        mask |= 1 << (base + 7)
    if hits:
        clear = hits - _AMBIGUOUS - known
        at = [k for k, w in enumerate(words) if w in hits]
        if any(not _you.isdisjoint(words[max(0, k - 4) : k + 3]) for k in at):
            mask |= 1 << base
        if len(hits) > 1:
            mask |= 1 << (base + 1)
        if len(at) * 200 >= len(words):
            mask |= 1 << (base + 2)
        if any(re.search(rf"\b{w}\b\s*!|\b{w.upper()}\b", text, 0) or f"{w}!" in low for w in clear):
            mask |= 1 << (base + 3)
    if ("you" in distinct or "yourself" in distinct or "die" in distinct or "shut" in distinct) and _threat.search(low):
        mask |= 1 << (base + 4)
    if not _signs.isdisjoint(text) and any(any(not c.isalpha() for c in m) and any(c.isalpha() for c in m) for m in _masked.findall(low)):
        mask |= 1 << (base + 5)
    return mask


class LabelModel:
    """p(votes, toxic) proportional to exp(class + voters by class + correlated pairs), over masks of ``m`` voters."""

    def __init__(self, m: int = VOTERS, pairs: int = 12, steps: int = 60, prior: float = 0.05, trust: float = 3.0):
        self.m, self.most_pairs, self.steps, self.prior, self.trust = m, pairs, steps, prior, trust
        self.edges: list[tuple[int, int]] = []

    def fit(self, masks: np.ndarray, counts: np.ndarray) -> LabelModel:
        """From the distinct masks and how many documents have each."""
        m = self.m
        everything = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(np.float64)
        p = np.zeros(1 << m)
        np.add.at(p, masks, counts)
        total = p.sum()
        if total == 0:
            total, p[0] = 1.0, 1.0
        seen = np.nonzero(p)[0]
        n = p[seen] / total
        x = everything[seen]
        # Independent voters first, by EM; the pseudo-documents of the prior say that voters are better than chance.
        w = 0.02
        pi, on = self.prior, np.stack([np.full(m, 0.002), np.full(m, 0.25)])
        for _ in range(self.steps):
            like = np.log([1 - pi, pi]) + x @ np.log(on).T + (1 - x) @ np.log(1 - on).T
            r = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
            a, b = n * r, n * (1 - r)
            pi = float(np.clip((a.sum() + w * self.prior) / (1 + w), 1e-6, 0.5))
            on[1] = np.clip((a @ x + 0.25 * w * self.prior) / (a.sum() + w * self.prior), 1e-3, 0.999)
            on[0] = np.clip((b @ x + 0.0005 * self.trust) / (b.sum() + self.trust), 1e-6, 0.2)
        self.class_balance, self.accuracies = pi, on
        # Pairs that agree more (or less) than that explains.
        a, b = n * r, n * (1 - r)
        seen_pairs = x.T @ (n[:, None] * x)
        model = sum(q.sum() * np.outer(q @ x / max(q.sum(), 1e-12), q @ x / max(q.sum(), 1e-12)) for q in (a, b))
        gap = np.abs(seen_pairs - model) / np.sqrt(np.maximum(model, 1e-9))
        i, j = np.triu_indices(m, 1)
        order = np.argsort(-gap[i, j], kind="stable")[: self.most_pairs]
        self.edges = [(int(i[k]), int(j[k])) for k in order if gap[i[k], j[k]] * math.sqrt(total) > 4]
        # The joint model: exact gradients of the expected complete likelihood, a few steps in each round.
        both = [everything[:, i] * everything[:, j] for i, j in self.edges]
        f = np.column_stack([everything, *both])
        theta = np.stack([np.concatenate([np.log(on[c] / (1 - on[c])), np.zeros(len(self.edges))]) for c in (0, 1)])
        e = len(self.edges)
        if e:
            for _ in range(self.steps):
                energy = f[seen] @ theta.T
                logz = _logsum(f @ theta.T)
                post = np.log([1 - pi, pi]) + energy - logz
                r = 1 / (1 + np.exp(np.clip(post[:, 0] - post[:, 1], -500, 500)))
                for c, q in ((1, n * r), (0, n * (1 - r))):
                    mean = (q @ f[seen] + (w * self.prior if c else self.trust * 0.1) * (np.r_[on[c], [on[c][i] * on[c][j] for i, j in self.edges]])) / (q.sum() + (w * self.prior if c else self.trust * 0.1))
                    for _ in range(3):  # scaling towards the moments, damped as features overlap
                        z = f @ theta[c]
                        pr = np.exp(z - z.max())
                        pr /= pr.sum()
                        theta[c] = np.clip(theta[c] + 0.4 * np.log(np.maximum(mean, 1e-9) / np.maximum(pr @ f, 1e-9)), -14, 8)
                pi = float(np.clip((n @ r + w * self.prior) / (1 + w), 1e-6, 0.5))
            self.class_balance = pi
        post = np.log([1 - pi, pi]) + f @ theta.T - _logsum(f @ theta.T)
        self.posteriors = 1 / (1 + np.exp(np.clip(post[:, 0] - post[:, 1], -500, 500)))
        self.posteriors[0] = min(self.posteriors[0], 0.5)  # no vote is no evidence of toxicity
        return self


def _logsum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=0)
    return top + np.log(np.exp(z - top).sum(axis=0))


def fit_linear(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, size: int, penalty: float = 5e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels over sets of words, with an L1 penalty, by accelerated proximal gradient."""
    at = np.fromiter((k for r in rows for k in r), dtype=np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    if not len(at):
        mean = min(max(float(np.average(y, weights=weight)) if len(rows) else 0.0, 1e-9), 1 - 1e-9)
        return np.zeros(size), math.log(mean / (1 - mean))
    # The step: a bound of the largest eigenvalue by power iteration.
    v, top = np.ones(size), 1.0
    weight = weight / max(weight.sum(), 1e-12)
    for _ in range(12):
        u = np.bincount(of, weights=v[at], minlength=len(rows))
        v = np.bincount(at, weights=(u * weight)[of], minlength=size)
        top = np.linalg.norm(v) or 1.0
        v /= top
    rate = 1 / (0.25 * (top + 1) * 1.1)
    w, z, t, bias, zb = np.zeros(size), np.zeros(size), 1.0, 0.0, 0.0
    for _ in range(steps):
        margin = np.bincount(of, weights=z[at], minlength=len(rows)) + zb
        g = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) * weight
        new = z - rate * np.bincount(at, weights=g[of], minlength=size)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = zb - rate * g.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return w, bias


def _mask_batches(learnt, begins):
    def masks(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([votes(t, learnt, begins) for t in b.column(1).to_pylist()], type=pa.int32())], names=["row_hash", "mask"])

    return masks


def features(text: str, begins: frozenset) -> set[str]:
    """The distinct words, and the learnt beginnings among them."""
    words = set(_word.findall(text.lower()))
    return words | (begins & beginnings(words)) if begins else words


def _word_batches(begins):
    def words(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(features(t, begins)) for t in b.column(1).to_pylist()], type=pa.list_(pa.string()))], names=["row_hash", "words"])

    return words


def _learn_batches(batches):
    for b in slices(batches, "text"):
        counts: dict[str, list[int]] = {}
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_word.findall(t.lower()))
            for f in words | beginnings(words):
                counts.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array([c[1] for c in counts.values()], type=pa.int64()), pa.array([c[0] for c in counts.values()], type=pa.int64())], names=["feature", "toxic", "clean"])


def learn_lexicons(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    labelled: int = 20_000, support: int = 8, precision: float = 0.95, most: int = 20_000,
) -> tuple[frozenset, frozenset]:
    """(words, beginnings) that at least ``support`` toxic texts have, and of all labelled texts with them at least the share ``precision``.

    From at most ``labelled`` labelled ids, those with the least hashes; an id with several labels is toxic if one says so. Equal
    texts count once. At most ``most`` entries, those of the most toxic texts.
    """
    y = labels.select(whole_id(labels, id).alias("id"), col(toxic).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    chosen, path = save(spark, y.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(labelled), "toxicity-labelled")
    texts = docs.select(whole_id(docs, id).alias("id"), col(text).cast("string").alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    once = texts.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")
    counts = once.mapInArrow(_learn_batches, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counts.filter((F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    found = [r[0] for r in good.orderBy(F.desc("toxic"), "feature").limit(most).select("feature").collect()]
    drop_path(spark, path)
    return frozenset(f for f in found if f[0] != "^"), frozenset(f for f in found if f[0] == "^")


def train(
    spark: SparkSession, docs: DataFrame, *, text: str = "text", sample: int = 4000, least: int = 5, penalty: float = 5e-4,
    lexicons: tuple[frozenset, frozenset] = (NOTHING, NOTHING),
) -> tuple[dict[str, float], float, LabelModel]:
    """(word weights, bias, label model). The votes of all documents make the label model; the classifier is fitted on at most
    ``sample`` distinct texts with votes and as many without, those with the least hashes, and on words that ``least`` of them have."""
    hashed = docs.select(F.xxhash64(col(text).cast("string")).alias("row_hash"), col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    voted, path = save(spark, hashed.mapInArrow(_mask_batches(*lexicons), "row_hash long, mask int"), "toxicity-votes")
    counts = voted.groupBy("mask").count().collect()  # at most 2**VOTERS rows
    model = LabelModel().fit(np.array([r[0] for r in counts], dtype=np.int64), np.array([r[1] for r in counts], dtype=np.float64))
    parts = [voted.filter(c).select("row_hash", "mask").distinct().orderBy("row_hash").limit(sample) for c in ("mask <> 0", "mask = 0")]
    chosen = {r[0]: r[1] for p in parts for r in p.collect()}  # at most 2 * sample rows
    wanted = spark.createDataFrame([(h,) for h in chosen], "row_hash long")
    texts = hashed.join(F.broadcast(wanted), "row_hash", "left_semi").groupBy("row_hash").agg(F.first("text").alias("text"))
    rows, rows_path = save(spark, texts.mapInArrow(_word_batches(lexicons[1]), "row_hash long, words array<string>"), "toxicity-sample")
    vocabulary = [r[0] for r in rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("word").orderBy("word").collect()]
    number = {w: k for k, w in enumerate(vocabulary)}
    ids, y, patterns = [], [], []
    for r in rows.orderBy("row_hash").toLocalIterator():
        ids.append([number[w] for w in r[1] if w in number])
        patterns.append(chosen[r[0]])
        y.append(model.posteriors[chosen[r[0]]])
    for p in (path, rows_path):
        drop_path(spark, p)
    if not ids:
        return {}, -10.0, model
    # A pattern of votes weighs as the square root of its documents, so that rare ones are learnt too.
    _, which, times = np.unique(patterns, return_inverse=True, return_counts=True)
    w, bias = fit_linear(ids, np.array(y), times[which] ** -0.5, len(vocabulary), penalty)
    weights = {v: float(x) for v, x in zip(vocabulary, w, strict=True) if x}
    if not weights:  # no word tells texts apart: each is as likely toxic as any, which the share of the sample doesn't say
        bias = math.log(model.class_balance / (1 - model.class_balance))
    return weights, float(bias), model


def toxic_documents(
    spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, *, id: str = "doc_id", text: str = "text", threshold: float = 0.5, learning: dict | None = None, **how
) -> DataFrame:
    """(doc_id, probability) of the documents whose probability of being toxic is over the threshold.

    With ``labels`` (doc_id, toxic), which may be empty, lexicons are learnt from a bounded sample of them (see learn_lexicons; ``learning``
    has its parameters).

    Null or empty text: never toxic. A table of too few texts to tell any words apart: none is found toxic. Very long texts are read whole; how often a word occurs doesn't matter. Ties at the
    threshold are not toxic. Repeated rows: each is judged, alike; a null id is reported as null, and one of any kind as it is (labels
    need whole numbers). Empty table: no rows. Extra columns don't matter.
    """
    need(docs, id, text)
    lexicons = (NOTHING, NOTHING) if labels is None else learn_lexicons(spark, docs, labels, id=id, text=text, **(learning or {}))
    weights, bias, _ = train(spark, docs, text=text, lexicons=lexicons, **how)
    begins = lexicons[1]
    shared = spark.sparkContext.broadcast((weights, bias))

    def run(batches):
        weights, bias = shared.value
        known = set(weights)
        for b in slices(batches, "text"):
            out = []
            for i, t in enumerate(b.column(1).to_pylist()):
                margin = bias + sum(sorted(weights[w] for w in known.intersection(features(t, begins))))
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))
                if p > threshold:
                    out.append((i, p))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in out], type=pa.int64())), pa.array([x[1] for x in out], type=pa.float64())], names=["doc_id", "probability"])

    narrow = docs.select(col(id).alias("id"), col(text).cast("string").alias("text")).filter("text IS NOT NULL AND text <> ''")
    return narrow.mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, probability double")
