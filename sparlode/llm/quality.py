"""Operator 10, quality rules: robust multivariate outliers by the minimum covariance determinant (MCD), per language and source.

Each document becomes a vector of transformed statistics. For each (language, source) several deterministic starts (correlations of
robustly scaled, bounded transforms, in the manner of Hubert, Rousseeuw and Verdonck 2012) are improved by concentration steps over all
its documents (Rousseeuw and Van Driessen 1999) until the determinant of the covariance of the nearest share ``h`` falls no more. After
two steps the two starts with the least determinants go on; the one with the least at the end is the estimate, which is then
reweighted. A document whose Mahalanobis distance is beyond the cutoff goes.

Every step is one aggregation over a narrow table of statistics: counts, sums and products by distance bin. The bins give the radius
that holds the share ``h`` of a group, and the sums inside it the next centre and covariance. No group is ever gathered in one place, so a
hot source costs no more than its share. Texts are never shuffled: they are read once for the statistics and once more when the
rule is applied.
"""

from __future__ import annotations

import math
import unicodedata
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, drop_path, fresh, need, save, slices, worker_state

D = 5
#: Standard deviations that an estimate is never below, so that groups of equal documents don't reject what differs little.
FLOOR = (0.02, 0.08, 0.08, 0.01, 0.08)
#: Distances are put into bins of this many to a doubling.
BINS = 32


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _class(c: str) -> int:
    if c.isspace():
        return 0
    if c.isalpha():
        return 2 if c.isupper() else 1
    return 3 if c.isnumeric() or unicodedata.combining(c) else 4


def _classes() -> np.ndarray:
    """For each code point of the basic plane: 0 space, 1 lower or caseless letter, 2 upper-case letter, 3 digit or mark, 4 other."""
    state = worker_state("quality")
    if "classes" not in state:
        state["classes"] = np.array([_class(chr(i)) for i in range(65536)], dtype=np.uint8)
    return state["classes"]


def statistics(text: str | None) -> list[float] | None:
    """The transformed statistics of a text, shrunk for short ones towards usual prose; None for a null text or one without words.

    Log letters per word; logit of symbols among characters; logit of capitals among letters; log distinct words over log
    words; logit of words of at most three characters among words.
    """
    if text is None:
        return None
    words = text.split()
    if not words:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(_classes()[points[points < 65536]], minlength=5)
    for c, n in zip(*np.unique(points[points >= 65536], return_counts=True), strict=True):
        counts[_class(chr(c))] += n
    space, lower, upper, digit, other = counts.tolist()
    n, letters, solid = len(words), lower + upper, len(points) - space
    short = sum(map((4).__gt__, map(len, words)))
    logit = lambda a, b: math.log(a / (b - a))
    return [
        math.log((letters + 50) / (n + 10)),
        logit(other + 9, solid + 300),
        logit(upper + 9, letters + 300),
        math.log(len(set(words)) + 20) / math.log(n + 20),
        logit(short + 12, n + 30),
    ]


def _stats_batches(batches):
    for b in slices(batches, "text"):
        rows = [statistics(t) for t in b.column(2).to_pylist()]
        keep = pa.array([r is not None for r in rows])
        some = [r for r in rows if r is not None]
        x = np.array(some, dtype=np.float64).reshape(len(some), D)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).filter(keep), b.column(1).filter(keep), *(pa.array(x[:, i]) for i in range(D))],
            names=["lang", "source", *(f"x{i}" for i in range(D))],
        )


def _matrix(n: float, sums) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from n, the sums and the sums of products."""
    m = np.array(sums[:D]) / n
    c = np.zeros((D, D))
    c[np.triu_indices(D)] = np.array(sums[D:]) / n
    return m, np.triu(c) + np.triu(c, 1).T - np.outer(m, m)


def _floored(c: np.ndarray) -> np.ndarray:
    return c + np.diag(np.square(FLOOR))


#: The starts: transforms of robustly scaled statistics, whose correlations are taken. The first has none.
STARTS = ("diagonal", "tanh", "clipped", "sign", "spatial sign", "half")


def _transforms(z: list[Column]) -> list[list[Column]]:
    square = sum((a * a for a in z[1:]), z[0] * z[0])
    norm = F.greatest(F.sqrt(square), F.lit(1e-9))
    inner = F.when(square <= chi2_quantile(0.5, D), 1.0).otherwise(0.0)
    return [[F.tanh(a) for a in z], [F.greatest(F.lit(-1.5), F.least(F.lit(1.5), a)) for a in z], [F.signum(a) for a in z], [a / norm for a in z], [a * inner for a in z]]


def _first_params():
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def first(n: pd.Series, sums: pd.Series, median: pd.Series, scale: pd.Series) -> pd.Series:
        out = []
        for a, s, m, k in zip(n, sums, median, scale, strict=True):
            r = np.eye(D)
            if s is not None:
                c = _matrix(a, list(s))[1]
                d = np.sqrt(np.maximum(np.diag(c), 1e-9))
                r = c / np.outer(d, d)
                np.fill_diagonal(r, 1.0)
            k = np.array(k, dtype=float)
            out.append([*m, *np.linalg.inv(_floored(0.99 * r * np.outer(k, k) + 0.01 * np.diag(k * k))).ravel().tolist()])
        return pd.Series(out)

    return first


def _step(share: float, radius_of=None):
    """From the bins of one (cell, start): the next centre and precision, if the determinant of the covariance falls by more than a
    thousandth; else what was before, which is then ``done``. ``radius_of``: the last bin that counts, from the bins and their counts up to each."""

    def step(pdf):
        pdf = pdf.sort_values("bin")
        n, upto = pdf["n"].to_numpy(), pdf["n"].to_numpy().cumsum()
        old, bins = list(pdf["p"].iloc[0]), pdf["bin"].to_numpy()
        last = bins[np.searchsorted(upto, math.ceil(upto[-1] * share))] if radius_of is None else radius_of(bins, upto)
        inside = bins <= last
        sums = np.array(pdf["sums"].tolist())[inside].sum(axis=0)
        m, c = _matrix(n[inside].sum(), sums.tolist())
        det = float(np.linalg.slogdet(_floored(c))[1])
        better = radius_of is not None or det < pdf["det"].iloc[0] - 1e-3
        new = [*(m + np.array(list(pdf["origin"].iloc[0]))).tolist(), *np.linalg.inv(_floored(c)).ravel().tolist()]
        row = (pdf["cell"].iloc[0], int(pdf["start"].iloc[0]), new if better else old, det if better else float(pdf["det"].iloc[0]), not better)
        return pd.DataFrame([row], columns=["cell", "start", "p", "det", "done"])

    return step


PARAMS = "cell string, start int, p array<double>, det double, done boolean"


def _distance(p: Column) -> Column:
    z = [F.col(f"x{i}") - p[i] for i in range(D)]
    terms = [(1 if i == j else 2) * p[D + i * D + j] * z[i] * z[j] for i in range(D) for j in range(i, D)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


def _moments(z: list[Column]) -> list[Column]:
    return [F.sum(a) for a in z] + [F.sum(z[i] * z[j]) for i in range(D) for j in range(i, D)]


def estimate(
    spark: SparkSession, docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    h: float = 0.75, steps: int = 30, least: int = 50, tail: float = 1e-9,
) -> DataFrame:
    """One row (lang, source, params) for each group: centre, precision and the cutoff of the squared distance.

    A group of fewer than ``least`` documents with words is pooled with the other small groups of its language, those with
    the small groups of all languages; if even these are fewer, params is null and nothing of them is rejected. Starts that
    haven't settled after ``steps`` steps stay as they are then. Nulls, long texts, repeated rows, ties, empty tables and extra
    columns: as in ``quality_filter``.
    """
    need(docs, text, lang, source)
    narrow = docs.select(col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"), col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(D))])
    stats, stats_path = save(spark, narrow.mapInArrow(_stats_batches, schema), "quality-stats")

    def key(level, *parts):
        return F.concat_ws("\u0001", F.lit(level), *(F.coalesce(p, F.lit("\u0000")) for p in parts))

    sizes = stats.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < least)
    sizes = sizes.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang", "small")))
    sizes = sizes.withColumn("tiny", F.col("small") & (F.col("of_lang") < least))
    tiny_n = sizes.filter("tiny").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tiny_n"))  # one row
    cell = F.when(~F.col("small"), key("1", F.col("lang"), F.col("source"))).when(~F.col("tiny"), key("2", F.col("lang"))).when(F.col("tiny_n") >= least, F.lit("3"))
    groups, groups_path = save(spark, sizes.crossJoin(tiny_n).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), cell.alias("cell")), "quality-groups")
    rows = stats.join(groups.filter("cell IS NOT NULL"), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    rows, rows_path = save(spark, rows.select("cell", *(f"x{i}" for i in range(D))), "quality-rows")
    paths = [stats_path, groups_path, rows_path]

    # Medians and quartile ranges, then the correlations of all starts at once.
    quart = rows.groupBy("cell").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(D)))
    spread = [F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0)) + FLOOR[i] ** 2) for i in range(D)]
    robust, path = save(spark, quart.select("cell", F.array(*(F.col(f"q{i}")[1] for i in range(D))).alias("median"), F.array(*spread).alias("scale")), "quality-scale")
    paths.append(path)
    z = [(F.col(f"x{i}") - F.col("median")[i]) / F.col("scale")[i] for i in range(D)]
    tried = F.array(*(F.struct(F.lit(k + 1).alias("start"), *(a.alias(f"t{i}") for i, a in enumerate(t))) for k, t in enumerate(_transforms(z))))
    tried = rows.join(robust, "cell").select("cell", F.explode(tried).alias("t")).select("cell", "t.*")
    moments = tried.groupBy("cell", "start").agg(F.count("*").cast("double").alias("n"), F.array(*_moments([F.col(f"t{i}") for i in range(D)])).alias("sums"))
    none = robust.select("cell", F.lit(0).alias("start"), F.lit(1.0).alias("n"), F.lit(None).cast("array<double>").alias("sums"))
    begin = moments.unionByName(none).join(robust, "cell")
    begin = begin.select("cell", "start", _first_params()("n", "sums", "median", "scale").alias("p"), F.lit(float("inf")).alias("det"), F.lit(False).alias("done"))
    params, path = save(spark, begin, "quality-starts")
    origin = robust.select("cell", F.col("median").alias("origin"))

    def bins(params: DataFrame) -> DataFrame:
        """(cell, start, bin, n, sums about the cell's median, and the parameters) of all rows."""
        x = rows.join(params.select("cell", "start", "p").join(origin, "cell"), "cell").withColumn("bin", F.floor(F.log2(_distance(F.col("p")) + 1e-9) * BINS))
        about = [F.col(f"x{i}") - F.col("origin")[i] for i in range(D)]
        x = x.groupBy("cell", "start", "bin").agg(F.count("*").alias("n"), F.array(*_moments(about)).alias("sums"))
        return x.join(params.join(origin, "cell"), ["cell", "start"])

    def best(params: DataFrame, most: int) -> DataFrame:
        return params.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("det", "start"))).filter(F.col("_n") <= most).drop("_n")

    for step in range(steps):
        going = params.filter("NOT done")
        new = bins(going).groupBy("cell", "start").applyInPandas(_step(h), PARAMS).unionByName(params.filter("done"))
        new, new_path = save(spark, best(new, 2) if step == 1 else new, "quality-step")
        drop_path(spark, path)
        params, path = new, new_path
        if step and not params.filter("NOT done").limit(1).count():
            break
    # Reweighting: the median sets the scale, then all that is usual counts.
    usual = chi2_quantile(0.5, D)
    wider = math.ceil(BINS * math.log2(chi2_quantile(0.975, D) / usual))
    weighed = bins(best(params, 1)).groupBy("cell", "start").applyInPandas(_step(h, lambda bins, upto: bins[np.searchsorted(upto, math.ceil(upto[-1] * 0.5))] + wider), PARAMS)
    params, new_path = save(spark, weighed, "quality-weighed")
    # The scale that puts the median squared distance where it belongs; the cutoff is in those units.
    x = rows.join(params.select("cell", "p"), "cell").withColumn("bin", F.floor(F.log2(_distance(F.col("p")) + 1e-9) * BINS))
    counts = x.groupBy("cell", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cell")
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    mid = counts.filter(F.col("upto") >= F.ceil(F.col("all") * 0.5)).groupBy("cell").agg(F.min("bin").alias("mid"))
    factor = F.greatest(F.pow(F.lit(2.0), (F.col("mid") + 1) / BINS) / usual, F.lit(1.0))
    cut = mid.select("cell", (factor * chi2_quantile(1 - tail, D)).alias("cut"))
    final = groups.join(params.join(cut, "cell"), "cell", "left")
    out, _ = save(spark, final.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.when(F.col("p").isNotNull(), F.concat("p", F.array("cut"))).alias("params")), "quality-params")
    for p in (*paths, path, new_path):
        drop_path(spark, p)
    return out


def rejected(text: str | None, params) -> bool:
    """Whether the squared distance of the text's statistics is beyond the cutoff."""
    if params is None:
        return False
    x = statistics(text)
    if x is None:
        return False
    p = np.asarray(params, dtype=np.float64)
    z = np.array(x) - p[:D]
    return bool(z @ p[D : D + D * D].reshape(D, D) @ z > p[-1])


def quality_filter(
    spark: SparkSession, docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    broadcast_groups: int = 50_000, **how,
) -> DataFrame:
    """The documents that are no outliers of their language and source, with all their columns as they were.

    Null language or source: a group of its own. Null text, empty text, text without words: no statistics, so kept. Very
    long texts count whole. Repeated rows: each counts and each is judged, alike. Ties at the cutoff are kept. Empty table:
    empty result. Extra columns pass through whatever their names. The groups' parameters are broadcast up to
    ``broadcast_groups`` groups (about 300 bytes each), beyond that joined by a shuffle.
    """
    params = estimate(spark, docs, text=text, lang=lang, source=source, **how)
    gl, gs, gp = fresh(docs, "_group_lang"), fresh(docs, "_group_source"), fresh(docs, "_group_params")
    params = params.select(F.col("lang").alias(gl), F.col("source").alias(gs), F.col("params").alias(gp))
    if params.count() <= broadcast_groups:
        params = F.broadcast(params)
    on = col(lang).cast("string").eqNullSafe(col(gl)) & col(source).cast("string").eqNullSafe(col(gs))
    joined = docs.join(params, on, "left").drop(gl, gs)
    names = docs.columns

    def keep(batches):
        for b in slices(batches, text):
            at = {n: b.schema.get_field_index(n) for n in (text, gp)}
            bad = [rejected(None if t is None else str(t), p) for t, p in zip(b.column(at[text]).to_pylist(), b.column(at[gp]).to_pylist(), strict=True)]
            yield b.filter(pa.array([not x for x in bad])).select(names)

    return joined.mapInArrow(keep, docs.schema)
