"""A database: versioned Parquet files, and a manifest that names those that count.

A mutation writes a log segment (seq, op, id, embedding, document and what is derived from it) and then the manifest of the next
version, under a name that only one writer can make; there is no lock that a crash could leave behind. The live rows are the latest
operation of each id. Compaction writes them as one segment. The segments of the last versions stay, so that a reader who has
pinned one isn't cut off; ``vacuum`` drops them. Ids count up from 1 and are never given twice. Optimizing also keeps indexes of the
version: postings and lengths for text, and cells for the nearest vectors. The folder must be one that the driver and all executors see.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, OptimizeReport, OptimizeRequest
from ..errors import Corruption, DimensionMismatch, Internal, NotFound, SerdeError, StorageIO
from ..functions import vector as V
from ..functions.json import canonical, derive
from ..operators import ivf, lexical
from ..storage_util import number_rows

LOG = (
    "seq long, op string, id long, embedding array<float>, norm double, document string, text string, title string, tags_text string, payload map<string,string>"
)
TEXT_FIELDS = {"text": "text", "title": "title", "tags": "tags_text"}
RECORDS = ("id", "embedding", "norm", "document", "text", "title", "tags_text", "payload")
VERSION = 1
#: Versions whose segments stay.
KEPT_VERSIONS = 10
#: From more live rows than this, optimizing makes cells.
INDEXED_ROWS = 50_000


def fold(log: DataFrame, columns) -> DataFrame:
    """The live rows (id and the columns) of a log (seq, op, id, ...): the latest operation of each id, unless it is a delete."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", *columns), "seq").alias("r"))
    return last.filter(F.col("r.op") != "delete").select("id", *(f"r.{c}" for c in columns))


class Database:
    """Opened with ``Database.create`` or ``Database.open``; each call sees the newest version, ``records()`` pins one."""

    def __init__(self, spark: SparkSession, path: str, ann_only: bool = False):
        self.spark, self.path, self.ann_only = spark, Path(path), ann_only
        self.manifest = self._read()
        self.config = Config.from_dict(self.manifest["config"])

    # Opening

    @staticmethod
    def create(spark: SparkSession, path: str, dim: int, config: Config | None = None) -> Database:
        config = config or Config(dim)
        config.dim = dim
        config.check()
        p = Path(path)
        (p / "segments").mkdir(parents=True, exist_ok=True)
        if Database._versions(p) or not Database._write(p, {"version": VERSION, "commit": 0, "config": config.to_dict(), "next_id": 1, "next_seq": 1, "live": 0, "segments": [], "streams": {}}):
            raise StorageIO(f"there is a database at {path} already")
        return Database(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Database:
        return Database(spark, path)

    @staticmethod
    def open_ann_only(spark: SparkSession, path: str) -> Database:
        """Vector search only: text and filters are refused, and their columns never read."""
        return Database(spark, path, ann_only=True)

    @staticmethod
    def _versions(path: Path) -> list[Path]:
        return sorted(path.glob("manifest-*.json"))

    def _read(self) -> dict:
        found = self._versions(self.path)
        if not found:
            raise StorageIO(f"there is no database at {self.path}")
        try:
            m = json.loads(found[-1].read_text())
        except ValueError as e:
            raise Corruption(f"the manifest {found[-1]} can't be read: {e}") from e
        if m.get("version") != VERSION:
            raise Corruption(f"version {m.get('version')} is unknown")
        return m

    @staticmethod
    def _write(path: Path, manifest: dict) -> bool:
        """Whether this writer was the first to make that version: the name is linked to a file that is whole already."""
        part = path / f".manifest-{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(manifest, f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, path / f"manifest-{manifest['commit']:012d}.json")
        except FileExistsError:
            return False
        finally:
            part.unlink()
        return True

    def _commit(self, change: dict) -> None:
        """Write the version after the one that this object has read."""
        new = {**self.manifest, **change, "commit": self.manifest["commit"] + 1}
        if not self._write(self.path, new):
            raise Internal("another writer has committed; open the database again")
        self.manifest = new
        self.vacuum(KEPT_VERSIONS)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and the segments and indexes that only they have."""
        found = self._versions(self.path)
        if len(found) <= keep:
            return
        stays = [json.loads(p.read_text()) for p in found[-keep:]]
        named = {s["name"] for m in stays for s in m["segments"]}
        for p in found[:-keep]:
            for s in json.loads(p.read_text())["segments"]:
                if s["name"] not in named:
                    shutil.rmtree(self.path / "segments" / s["name"], ignore_errors=True)
            for d in (self.path / "derived").glob(f"*-{int(p.stem.split('-')[1])}"):
                shutil.rmtree(d, ignore_errors=True)
            p.unlink(missing_ok=True)

    # Reading

    @property
    def dim(self) -> int:
        return self.config.dim

    @property
    def metric(self) -> str:
        return self.config.index.metric

    def log(self) -> DataFrame:
        """All operations of the segments that count."""
        names = [str(self.path / "segments" / s["name"]) for s in self.manifest["segments"]]
        return self.spark.read.schema(LOG).parquet(*names) if names else self.spark.createDataFrame([], LOG)

    def records(self) -> DataFrame:
        """The live rows of this version. Without updates and deletes it is a plain scan, else the latest operation of each id."""
        log = self.log()
        if all(s["inserts_only"] for s in self.manifest["segments"]):
            return log.select(*RECORDS)
        return fold(log, RECORDS[1:])

    def ids(self) -> DataFrame:
        return self.records().select("id")

    def count(self) -> int:
        return self.manifest["live"]

    def _last(self, id: int):
        """The latest operation of one id; the id is pushed to the scans."""
        row = self.log().filter(F.col("id") == id).orderBy(F.desc("seq")).first()
        return None if row is None or row["op"] == "delete" else row

    def get_vector(self, id: int) -> list[float] | None:
        row = self._last(id)
        return None if row is None else list(row["embedding"])

    def get_document(self, id: int):
        row = self._last(id)
        return None if row is None else json.loads(row["document"])

    def get_record(self, id: int) -> tuple[list[float], object] | None:
        row = self._last(id)
        return None if row is None else (list(row["embedding"]), json.loads(row["document"]))

    # Writing

    def _check(self, embedding: Sequence[float]) -> list[float]:
        if len(embedding) != self.dim:
            raise DimensionMismatch(self.dim, len(embedding))
        return [float(x) for x in embedding]

    def _append(self, rows: DataFrame, inserts_only: bool, change: dict) -> None:
        """rows: (seq, op, id, embedding, document)"""
        d = derive(F.col("document"))
        gone = F.col("op") == "delete"
        full = rows.withColumn("d", F.when(~gone, d)).select("seq", "op", "id", "embedding", F.when(~gone, V.norm(F.col("embedding"))).alias("norm"), "d.document", "d.text", "d.title", "d.tags_text", "d.payload")
        name = f"{self.manifest['commit'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        full.write.parquet(str(self.path / "segments" / name))
        try:
            self._commit({**change, "segments": [*self.manifest["segments"], {"name": name, "inserts_only": inserts_only}]})
        except BaseException:
            shutil.rmtree(self.path / "segments" / name, ignore_errors=True)
            raise

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "seq long, op string, id long, embedding array<float>, document string").coalesce(1)

    def insert_json(self, embedding: Sequence[float], document) -> int:
        return self.insert_json_batch([(embedding, document)])[0]

    def insert_json_batch(self, items: Sequence[tuple[Sequence[float], object]]) -> list[int]:
        """All or none."""
        items = [(self._check(e), _text(d)) for e, d in items]
        if not items:
            return []
        first, seq, n = self.manifest["next_id"], self.manifest["next_seq"], len(items)
        self._append(self._rows([(seq + k, "insert", first + k, e, d) for k, (e, d) in enumerate(items)]), True, {"next_id": first + n, "next_seq": seq + n, "live": self.manifest["live"] + n})
        return list(range(first, first + n))

    def insert_table(self, rows: DataFrame, order: list, embedding: str = "embedding", document: str = "document", stream: tuple[str, int] | None = None) -> tuple[int, int]:
        """Insert a DataFrame: ids follow the order given. (first id, rows). A vector of another length fails the whole insert.

        ``stream``: a stream's name and the number of this batch, which are part of the commit; a batch that has been committed is left out.
        """
        if stream and self.manifest.setdefault("streams", {}).get(stream[0], -1) >= stream[1]:
            return self.manifest["next_id"], 0
        e = F.col(embedding).cast("array<float>")
        fine = F.when(F.size(e) == self.dim, e).otherwise(F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {self.dim}, got "), F.size(e).cast("string"))))
        first, seq = self.manifest["next_id"], self.manifest["next_seq"]
        numbered, n = number_rows(rows, order, "_n")
        if n:
            new = numbered.select((F.col("_n") + seq).alias("seq"), F.lit("insert").alias("op"), (F.col("_n") + first).alias("id"), fine.alias("embedding"), F.col(document).alias("document"))
            mark = {"streams": {**self.manifest["streams"], stream[0]: stream[1]}} if stream else {}
            self._append(new, True, {"next_id": first + n, "next_seq": seq + n, "live": self.manifest["live"] + n, **mark})
        return first, n

    def update_json(self, id: int, embedding: Sequence[float], document) -> None:
        if self._last(id) is None:
            raise NotFound(id)
        seq = self.manifest["next_seq"]
        self._append(self._rows([(seq, "update", id, self._check(embedding), _text(document))]), False, {"next_seq": seq + 1})

    def remove(self, id: int) -> None:
        if self._last(id) is None:
            raise NotFound(id)
        seq = self.manifest["next_seq"]
        self._append(self._rows([(seq, "delete", id, None, None)]), False, {"next_seq": seq + 1, "live": self.manifest["live"] - 1})

    def flush(self) -> None:
        """Nothing is pending: a mutation has been committed when its call returns."""

    # Maintenance

    def storage_bytes(self) -> int:
        return sum(f.stat().st_size for s in self.manifest["segments"] for f in (self.path / "segments" / s["name"]).rglob("*") if f.is_file())

    def _replace(self, rows: DataFrame) -> None:
        """All segments by one of these rows."""
        name = f"{self.manifest['commit'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        rows.select(F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("op"), *RECORDS).write.parquet(str(self.path / "segments" / name))
        self._commit({"segments": [{"name": name, "inserts_only": True}]})

    def _fold(self) -> int:
        """Replace all segments by one of the live rows; by how many bytes the version has become smaller."""
        before = self.storage_bytes()
        self._replace(self.records())
        return max(0, before - self.storage_bytes())

    def optimize(self, request: OptimizeRequest | None = None) -> OptimizeReport:
        """Compaction and a checkpoint both fold the log; only compaction reports its rows. Repair derives all columns anew. Any of them
        keeps the indexes of the new version."""
        request = request or OptimizeRequest()
        report = OptimizeReport()
        if request.checkpoint_only or request.force_full_compaction:
            report.space_reclaimed_bytes = self._fold() if len(self.manifest["segments"]) > 1 or not all(s["inserts_only"] for s in self.manifest["segments"]) else 0
            report.records_compacted = 0 if request.checkpoint_only else self.count()
        if request.repair_indexes and self.manifest["segments"]:
            rows = self.records().withColumn("d", derive(F.col("document")))
            self._replace(rows.select("id", "embedding", V.norm(F.col("embedding")).alias("norm"), "d.document", "d.text", "d.title", "d.tags_text", "d.payload"))
            report.graph_edges_repaired = self.count()
        if request.indexes and self.manifest["live"]:
            self.build_indexes()
        return report

    def check_health(self) -> dict:
        """Counts the live rows and looks for vectors of a wrong length and ids out of range."""
        r = self.records().agg(F.count("*").alias("n"), F.coalesce(F.sum((F.size("embedding") != self.dim).cast("int")), F.lit(0)).alias("bad"), F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()
        if r["n"] != self.manifest["live"] or r["bad"] or r["top"] >= self.manifest["next_id"]:
            raise Corruption(f"{r['n']} rows where {self.manifest['live']} are expected, {r['bad']} bad vectors, greatest id {r['top']}")
        return {"records": r["n"], "dim": self.dim, "commit": self.manifest["commit"]}

    # Snapshots of derived tables

    def save_derived(self, name: str, table: DataFrame, by: str | None = None) -> None:
        """Keep a table (a graph, cells) with the version it was made from; ``by`` is a column whose values have a folder each."""
        writer = table.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(str(self.path / "derived" / f"{name}-{self.manifest['commit']}"))

    def load_derived(self, name: str) -> DataFrame | None:
        """The table of exactly this version; None if there is none, as after any mutation."""
        path = self.path / "derived" / f"{name}-{self.manifest['commit']}"
        return self.spark.read.parquet(str(path)) if (path / "_SUCCESS").exists() else None

    def build_indexes(self, cells: int | None = None) -> None:
        """Keep the postings and lengths of this version, and the cells of its vectors: ``cells`` of them, by default the root of the live rows (4096
        at most), and none up to INDEXED_ROWS of those."""
        r = self.records()
        self.save_derived("lengths", lexical.lengths(r, TEXT_FIELDS))
        post = lexical.postings(r, TEXT_FIELDS)
        self.save_derived("postings", post.repartitionByRange("term").sortWithinPartitions("term", "id"))
        if cells or self.count() > INDEXED_ROWS:
            c = ivf.train(r, cells or min(4096, math.isqrt(self.count())))
            self.save_derived("centroids", self.spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cell int, v array<double>").coalesce(1))
            self.save_derived("cells", ivf.assign(r.select("id", "embedding"), c).repartition("cell"), "cell")

    def postings(self) -> tuple[DataFrame, DataFrame] | None:
        """(postings, lengths) of exactly this version, if they are kept."""
        found = self.load_derived("postings"), self.load_derived("lengths")
        return None if None in found else found

    def cells(self) -> tuple[np.ndarray, DataFrame] | None:
        """(centroids, records with their cell) of exactly this version, if they are kept."""
        c, assigned = self.load_derived("centroids"), self.load_derived("cells")
        if c is None or assigned is None:
            return None
        return np.array([r["v"] for r in c.orderBy("cell").collect()], dtype=np.float64), assigned


def _text(document) -> str:
    try:
        return canonical(document)
    except (TypeError, ValueError) as e:
        raise SerdeError(str(e)) from e
