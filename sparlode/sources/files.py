"""Text, JSON lines, raw matrices and JSON arguments; summaries and hits."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corruption, SerdeError


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(text) of the lines {"text": ...}, without blank lines and blank texts; a line that is no JSON is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", "text string", {"mode": "FAILFAST"}).alias("j")).select("j.text")
    texts = parsed.filter(F.trim("text") != "")
    return texts if limit is None else texts.limit(limit)


def read_matrix(spark: SparkSession, path: str, columns: int, kind: str = "f32", limit: int | None = None) -> DataFrame:
    """(row_idx, values) of raw little-endian rows of ``columns`` numbers, f32 or i32. Each task reads its part of the file, by a path or URI that
    executors see."""
    if kind not in ("f32", "i32"):
        raise ValueError("kind must be f32 or i32")
    files, at = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    size = files.get_file_info(at).size
    if size is None:
        raise FileNotFoundError(path)
    if size % (4 * columns):
        raise Corruption(f"{path} has {size} bytes, which are no whole rows of {columns} numbers")
    n = size // (4 * columns) if limit is None else min(limit, size // (4 * columns))
    numbers = spark.range(n).select(F.col("id").alias("row_idx"))
    dtype = np.dtype("<f4" if kind == "f32" else "<i4")

    def rows(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            i = b.column(0).to_numpy()  # a run of numbers
            with files.open_input_file(at) as f:
                flat = np.frombuffer(f.read_at(len(i) * 4 * columns, int(i[0]) * 4 * columns), dtype=dtype)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, columns, dtype=np.int32)), pa.array(flat))], names=["row_idx", "values"])

    return numbers.mapInArrow(rows, f"row_idx long, values array<{'float' if kind == 'f32' else 'int'}>")


def write_matrix(rows: np.ndarray, path: str) -> None:
    np.ascontiguousarray(rows, dtype="<i4" if np.issubdtype(rows.dtype, np.integer) else "<f4").tofile(path)


def json_argument(text: str | None, file: str | None, what: str):
    """Exactly one of an inline text and a file, parsed."""
    if (text is None) == (file is None):
        raise SerdeError(f"give exactly one of --{what}-json and --{what}-file")
    try:
        return json.loads(text if text is not None else Path(file).read_text())
    except ValueError as e:
        raise SerdeError(f"{what} is no JSON: {e}") from e


def embedding_argument(value) -> list[float]:
    if not isinstance(value, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value):
        raise SerdeError("the embedding must be a JSON array of numbers")
    return [float(x) for x in value]


def document_argument(value) -> dict:
    if not isinstance(value, dict):
        raise SerdeError("the document must be a JSON object")
    return value


def write_summary(summary: dict, path: str) -> None:
    Path(path).write_text(json.dumps(summary, indent=2, sort_keys=True))


def format_hits(hits: list[dict], query: str, as_json: bool) -> str:
    """hits: dicts of id, score and the parsed document."""
    if as_json:
        return json.dumps(hits, indent=2, ensure_ascii=False)
    lines = [f"Found {len(hits)} results for '{query}':"]
    for n, h in enumerate(hits, 1):
        text, doc = h["document"].get("text"), h["document"].get("doc_id")
        text = text.replace("\n", " ") if isinstance(text, str) else "No text"
        lines.append(f"{n}. [Score: {h['score']:.4f}] [Doc: {doc if isinstance(doc, str) else 'Unknown'}] {text}")
    return "\n".join(lines)


def fetch_json(url: str, tries: int = 6, wait: float = 1.0, most_wait: float = 60.0, open_url: Callable = urllib.request.urlopen, sleep: Callable = time.sleep):
    """The parsed answer; failures are tried again after waits that double."""
    for n in range(tries):
        try:
            with open_url(url, timeout=60) as r:
                return json.loads(r.read())
        except (OSError, ValueError):
            if n == tries - 1:
                raise
            sleep(min(most_wait, wait * 2**n))
    return None


def download_rows(page_url: Callable[[int, int], str], target: str, limit: int, page: int = 100, min_chars: int = 1, **how) -> int:
    """Rows {"rows": [{"row": {"text"}}]} of a paged HTTP source as JSON lines {"id", "text"}; texts of under ``min_chars`` are skipped."""
    n, offset = 0, 0

    def pages() -> Iterator[list]:
        nonlocal offset
        while rows := fetch_json(page_url(offset, page), **how).get("rows", []):
            offset += len(rows)
            yield rows

    with open(target, "w", encoding="utf-8") as out:
        for rows in pages():
            for r in rows:
                text = str(r.get("row", {}).get("text") or "").strip()
                if len(text) >= min_chars:
                    out.write(json.dumps({"id": n, "text": text}, ensure_ascii=False) + "\n")
                    n += 1
                    if n >= limit:
                        return n
    return n
