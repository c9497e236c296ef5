"""What the operators share: a shared folder for written tables, fresh column names, worker-side state."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

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


def save(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def col(name: str):
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_id(df: DataFrame, name: str):
    """The id as a long; ids of a kind that has no order of whole numbers are refused before anything runs."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"ids in {name} must be whole numbers, not {kind.simpleString()}; number the rows first")
    return col(name).cast("long")


def worker_state(kind: str) -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks, until another kind of operator runs in it."""
    name = "_sparlode_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kind = None
    held = sys.modules[name]
    if held.kind != kind:
        held.kind, held.state = kind, {}
    return held.state


def texts_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of the column, so that very long texts don't pile up."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = max(1, b.column(b.schema.get_field_index(name)).nbytes)
        step = max(1, int(b.num_rows * most / size))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
