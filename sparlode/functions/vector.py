"""Distances of vectors as columns. Sums run over the dimensions in their order, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig


def as_vector(v: Column | Sequence[float]) -> Column:
    """A column, or the literal of a sequence, as an array of doubles; single-precision numbers keep their value."""
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.lit(np.asarray(v, dtype=np.float64).tolist()).cast("array<double>") if len(v) else F.array().cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_vector(a), as_vector(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(as_vector(a), lambda x: x * x)))


def l2_distance(a, b) -> Column:
    """The square of the Euclidean distance."""
    return _sum(F.zip_with(as_vector(a), as_vector(b), lambda x, y: (x - y) * (x - y)))


def ip_distance(a, b) -> Column:
    return -dot(a, b)


def cosine_distance(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; 1 if either vector is zero. Norms that are known save the sums."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - dot(a, b) / (na * nb))


_DISTANCES: dict[str, Callable] = {"cosine": cosine_distance, "l2": l2_distance, "ip": ip_distance}


def distance(metric: str, a, b, **norms) -> Column:
    if metric not in _DISTANCES:
        raise InvalidConfig(f"metric must be one of {tuple(_DISTANCES)}")
    return _DISTANCES[metric](a, b, **(norms if metric == "cosine" else {}))


def score(metric: str, dist: Column) -> Column:
    """Higher is better: the cosine, the inner product, or the negative square."""
    return 1 - dist if metric == "cosine" else -dist


#: Of fewer pairs, running sums over the dimensions are quicker than a pass for each dimension.
_FEW = 48


def _distance_few(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = lambda x: np.cumsum(x, axis=1)[:, -1] + 0.0  # noqa: E731  one after the other, from the first
    if metric == "l2":
        return total((a - b) * (a - b))
    dot = total(a * b)
    if metric == "ip":
        return -dot
    na, nb = total(a * a), total(b * b)
    n = np.sqrt(na) * np.sqrt(nb)
    return np.where((na == 0) | (nb == 0), 1.0, 1 - dot / np.where(n == 0, 1.0, n))


def distance_rows(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, with the same order of sums as the columns."""
    if 0 < len(a) < _FEW and a.shape[1]:
        return _distance_few(metric, a, b)
    total, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        if metric == "l2":
            total += (x - y) * (x - y)
        else:
            total += x * y
        if metric == "cosine":
            na += x * x
            nb += y * y
    if metric == "l2":
        return total
    if metric == "ip":
        return -total
    n = np.sqrt(na) * np.sqrt(nb)
    return np.where((na == 0) | (nb == 0), 1.0, 1 - total / np.where(n == 0, 1.0, n))


def distance_matrix(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs, by matrix multiplication: equal to distance_rows but for the last digits."""
    d = a @ b.T
    if metric == "l2":
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * d, 0)
    if metric == "ip":
        return -d
    n = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return np.where(n == 0, 1.0, 1 - d / np.where(n == 0, 1.0, n))


def profile(v: Column) -> Column:
    """A struct: dimension, l2_norm, mean, mean_abs, min, max, style."""
    x, n = as_vector(v), F.size(v)
    some = n > 0
    length = norm(x)
    style = F.when(n == 0, "empty embedding").when((length >= 0.98) & (length <= 1.02), "likely L2-normalized dense vector").otherwise("dense vector (not unit-normalized)")
    zero = F.lit(0.0)
    return F.struct(
        n.alias("dimension"),
        F.when(some, length).otherwise(zero).alias("l2_norm"),
        F.when(some, _sum(x) / n).otherwise(zero).alias("mean"),
        F.when(some, _sum(F.transform(x, F.abs)) / n).otherwise(zero).alias("mean_abs"),
        F.when(some, F.array_min(x)).otherwise(zero).alias("min"),
        F.when(some, F.array_max(x)).otherwise(zero).alias("max"),
        style.alias("style"),
    )
