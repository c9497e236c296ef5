"""JSON documents: canonical text, dotted paths, and the columns that are derived from a document when it is written."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SerdeError
from .pieces import pieces

#: Paths whose values are kept in the map column ``payload``, so that an equality is a native predicate.
INDEXED_PATHS = tuple(f"{p}{k}" for p in ("", "metadata.") for k in ("doc_id", "source", "type", "created_at", "tags", "session_id"))
MISSING = object()


def _strict(name: str):
    raise SerdeError(f"{name} is no JSON number")


def loads(text: str) -> Any:
    try:
        return json.loads(text, parse_constant=_strict)
    except ValueError as e:
        raise SerdeError(str(e)) from e


def canonical(value: Any) -> str:
    """One text for equal values: sorted keys, no spaces; 1 and 1.0, "1" and 1, null and absence stay apart."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def get_path(document: Any, path: str) -> Any:
    """The value at a dotted path, which goes down objects only; MISSING if there is none."""
    for key in path.split("."):
        if not isinstance(document, dict) or key not in document:
            return MISSING
        document = document[key]
    return document


def extract_text(document: Any) -> str:
    text = get_path(document, "text")
    return text if isinstance(text, str) else ""


def extract_title(document: Any) -> str | None:
    """The title; that of the metadata if the document's own is no string."""
    for path in ("title", "metadata.title"):
        if isinstance(title := get_path(document, path), str):
            return title
    return None


def extract_tags(document: Any) -> list[str]:
    """The tags, of a string or of an array's strings; those of the metadata if the document's own are neither."""
    for path in ("tags", "metadata.tags"):
        tags = get_path(document, path)
        if isinstance(tags, str):
            return [tags]
        if isinstance(tags, list):
            return [t for t in tags if isinstance(t, str)]
    return []


DERIVED = T.StructType([
    T.StructField("document", T.StringType()), T.StructField("text", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("tags_text", T.StringType()), T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])


def derive_one(text: str) -> dict:
    d = loads(text)
    payload = {p: canonical(v) for p in INDEXED_PATHS if (v := get_path(d, p)) is not MISSING}
    return {"document": canonical(d), "text": extract_text(d), "title": extract_title(d) or "", "tags_text": " ".join(extract_tags(d)), "payload": payload}


_ARROW = pa.struct([(n, pa.map_(pa.string(), pa.string()) if n == "payload" else pa.string()) for n in DERIVED.names])


def _row(text: str | None) -> dict:
    if text is None:
        return dict.fromkeys(DERIVED.names)
    d = derive_one(text)
    return d | {"payload": list(d["payload"].items())}


@F.arrow_udf(DERIVED)
def derive(documents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The canonical document, its text, title and tags, and the payload map."""
    for batch in documents:
        for (piece,) in pieces(batch):
            yield pa.array([_row(t) for t in piece.to_pylist()], type=_ARROW)


def json_path(document: Column, path: str) -> Column:
    """The canonical text of the value at the path; null if there is none (a JSON null is the text null)."""

    @F.pandas_udf(T.StringType())
    def get(texts: pd.Series) -> pd.Series:
        values = (get_path(loads(t), path) if t is not None else MISSING for t in texts)
        return pd.Series([None if v is MISSING else canonical(v) for v in values], dtype=object)

    return get(document)
