"""Operator 8, sharding by a Feistel permutation with cycle walking.

The rows are numbered 0 to n-1 in the order of their id, and a keyed permutation of those numbers is the shuffle: position =
permute(number), shard = position mod shards, slot = position div shards. Any number's place, and the number at any place,
can be computed without a table. The network works on the numbers of two equal halves of bits, the least even number of
bits that holds n; a result of n or more is put through it again, until it falls below n (fewer than four times on average).

Global numbers need no total sort in one place: ids are range partitioned and sorted, the partitions' sizes make the offsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, drop_path, fresh, need, save, whole_id

ROUNDS = 6
_M1, _M2, _M3 = 73_244_475, 19_349_663, 83_492_791


def half_bits(n: int) -> int:
    """Bits of one half: the least that make 2**(2 * bits) at least n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    """Below 2**31, so that SQL's 64-bit integers can do the rounds."""
    return [((seed + 1) * _M1 + (r + 1) * _M2 * (seed % 1000 + 7)) % (1 << 31) for r in range(ROUNDS)]


def _round(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    m = np.int64((1 << 31) - 1)
    y = ((x + np.int64(key)) % m) * np.int64(_M1) % m
    y = ((y ^ (y >> np.int64(13))) % m) * np.int64(_M3) % m
    return (y ^ (y >> np.int64(11))) & np.int64((1 << bits) - 1)


def _pass(x: np.ndarray, keys: list[int], bits: int, back: bool) -> np.ndarray:
    left, right = x >> np.int64(bits), x & np.int64((1 << bits) - 1)
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _round(left, k, bits), left
        else:
            left, right = right, left ^ _round(right, k, bits)
    return (left << np.int64(bits)) | right


def permute(x, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The places of the numbers x (below n), or with ``back`` the numbers at those places."""
    x = np.asarray(x, dtype=np.int64)
    if n > 1 << 60:
        raise ValueError("at most 2**60 rows")
    if len(x) and (x.min() < 0 or x.max() >= n):
        raise ValueError("numbers must be from 0 to n-1")
    keys, bits = round_keys(seed), half_bits(n)
    out = _pass(x, keys, bits, back)
    over = np.nonzero(out >= n)[0]
    while len(over):
        out[over] = _pass(out[over], keys, bits, back)
        over = over[out[over] >= n]
    return out


def number_rows(spark: SparkSession, rows: DataFrame, order: list[str], number: str, partitions: int | None = None) -> tuple[DataFrame, int, str]:
    """The rows with their global number by ``order`` (nulls first), the count, and the written table's path.

    Rows that are equal in all of ``order`` are numbered in an arbitrary but, once written, fixed order.
    """
    part, at = fresh(rows, "_part"), fresh(rows, "_at")
    keys = [col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    written, path = save(spark, ranged, "numbered")
    sizes = dict(written.groupBy(part).count().collect())  # one row for each partition
    base, n = {}, 0
    for p in sorted(sizes):
        base[p] = n
        n += sizes[p]
    offsets = spark.createDataFrame([(p, b) for p, b in base.items()], T.StructType([T.StructField(part, T.IntegerType()), T.StructField(number + "_base", T.LongType())]))
    out = written.join(F.broadcast(offsets), part).withColumn(number, col(number + "_base") + col(at)).drop(part, at, number + "_base")
    return out, n, path


def shard_rows(
    spark: SparkSession, docs: DataFrame, *, id: str = "doc_id", shards: int = 64, seed: int = 0, carry: list[str] | None = None
) -> DataFrame:
    """(doc_id, row_number, position, shard, slot) for each row, and the columns of ``carry``.

    Null ids come first. Repeated ids, also whole repeated rows: a number and place of their own for each. There are no texts
    in it unless carried, whole. Empty table: no rows. Columns of ``carry`` that clash with the result's get underscores at their
    end; other columns don't matter. Ids must be whole numbers. Shards differ in size by at most one row.
    """
    need(docs, id)
    added = ["doc_id", "row_number", "position", "shard", "slot"]
    if shards < 1:
        raise ValueError("shards must be at least 1")
    taken, carried = set(added), []
    for c in carry or []:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        carried.append((c, name))
    rows = docs.select(whole_id(docs, id).alias("doc_id"), *(col(c).alias(name) for c, name in carried))
    carry = [name for _, name in carried]
    numbered, n, _ = number_rows(spark, rows, ["doc_id"], "row_number")

    @F.pandas_udf(T.LongType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    out = numbered.withColumn("position", place("row_number"))
    return out.select("doc_id", "row_number", "position", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"), *map(col, carry))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, *, id: str = "doc_id", shards: int = 64, seed: int = 0) -> None:
    """All columns as Parquet, one directory and file for each shard, rows in order of their slot. The columns shard and slot are added."""
    placed, rows_path = save(spark, shard_rows(spark, docs, id=id, shards=shards, seed=seed, carry=[c for c in docs.columns if c != id]), "sharded")
    placed.drop("row_number", "position").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop_path(spark, rows_path)


def sql(seed: int = 0, shards: int = 64, table: str = "documents", id: str = "doc_id") -> str:
    """The same in SQL, with one recursion for the rounds and the walk."""
    m = (1 << 31) - 1
    x = "r"
    y = f"((({x} + k.key) % {m}) * {_M1} % {m})"
    z = f"((xor({y}, ({y} >> 13)) % {m}) * {_M3} % {m})"
    f = f"(xor({z}, ({z} >> 11)) & s.mask)"
    keys = ", ".join(f"({i}, {k}::BIGINT)" for i, k in enumerate(round_keys(seed)))
    return f"""
WITH RECURSIVE keys(step, key) AS (VALUES {keys}),
num AS (SELECT {id} AS doc_id, row_number() OVER (ORDER BY {id} NULLS FIRST) - 1 AS row_number FROM {table}),
size AS (SELECT n, bits, (1::BIGINT << bits) - 1 AS mask FROM (
  SELECT n, greatest(1, (SELECT min(b) FROM range(1, 32) t(b) WHERE (1::BIGINT << (2 * b)::INTEGER) >= n))::INTEGER AS bits FROM (SELECT count(*) AS n FROM num))),
walk AS (
  SELECT doc_id, row_number, row_number >> bits AS l, row_number & mask AS r, 0 AS step FROM num, size
  UNION ALL
  SELECT w.doc_id, w.row_number, w.r, xor(w.l, {f.replace("(r +", "(w.r +")}), (w.step + 1)
  FROM (SELECT doc_id, row_number, l, r, CASE WHEN step = {ROUNDS} THEN 0 ELSE step END AS step, step AS was FROM walk) w, size s, keys k
  WHERE k.step = w.step AND (w.was < {ROUNDS} OR ((w.l << s.bits) | w.r) >= s.n)),
done AS (SELECT doc_id, row_number, (l << bits) | r AS position FROM walk, size WHERE step = {ROUNDS} AND ((l << bits) | r) < n)
SELECT doc_id, row_number::BIGINT AS row_number, position::BIGINT AS position, (position % {shards})::INTEGER AS shard, (position // {shards})::BIGINT AS slot FROM done"""
