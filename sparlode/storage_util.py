"""Written tables in the shared folder, and global row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="sparlode-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sparlode-{tag}-{uuid.uuid4().hex}"


def save_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and survives lost executors. Also its path."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def save(df: DataFrame, tag: str) -> DataFrame:
    """The same for a table that stays as long as the session's results may need it."""
    return save_at(df, tag)[0]


def drop_path(spark: SparkSession, path: str | None) -> None:
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def number_rows(df: DataFrame, order: list, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """The rows with numbers from ``start`` in the given order, and how many there are; no total sort in one place."""
    part, at = "_part", "_at"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = save(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = dict(ranged.groupBy(part).count().collect())
    base, n = [], start
    for p in sorted(sizes):
        base.append((p, n))
        n += sizes[p]
    offsets = df.sparkSession.createDataFrame(base, f"{part} int, _base long")
    return ranged.join(F.broadcast(offsets), part).withColumn(name, F.col("_base") + F.col(at)).drop(part, at, "_base"), n - start
