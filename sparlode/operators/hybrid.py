"""Normalisation and fusion of two candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALPHA = 0.65


def _scaled(score: str, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))


def minmax(rows: DataFrame, score: str = "score", name: str = "norm", by: str = "qid") -> DataFrame:
    """Scores of each ``by`` to 0..1; 1 for all where they hardly differ. One aggregation with partial results and a join, so a
    group of any size is never held together."""
    ends = rows.groupBy(F.col(by).alias("_by")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    return rows.join(ends, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, _scaled(score, F.col("_low"), F.col("_high"))).drop("_by", "_low", "_high")


def minmax_pool(pool: DataFrame, score: str = "score", name: str = "norm", by: str = "qid") -> DataFrame:
    """The same for pools of candidates, which are cut to their size before and computed once."""
    w = Window.partitionBy(by)
    return pool.withColumn(name, _scaled(score, F.min(score).over(w), F.max(score).over(w)))


def clamp_alpha(alpha: float | None) -> float:
    return min(1.0, max(0.0, ALPHA if alpha is None else alpha))


def union_pools(vec: DataFrame, lex: DataFrame) -> DataFrame:
    """(qid, id, dist, v, l) of candidates (qid, id, dist, score) and (qid, id, score), normalised each in its own pool."""
    v = minmax_pool(vec, name="v").select("qid", "id", "dist", "v")
    x = minmax_pool(lex, name="l").select("qid", "id", "l")
    return v.join(x, ["qid", "id"], "full_outer")


def fused(alpha: float) -> Column:
    return F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1.0 - alpha) * F.coalesce("l", F.lit(0.0))
