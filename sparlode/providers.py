"""Embedders and rerankers: the interfaces, deterministic ones, and clients of HTTP endpoints."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import DimensionMismatch, Internal
from .functions.text import embed_text, tokens_of
from .operators.rerank import overlap_score_of


class Embedder(Protocol):
    model_id: str

    def embed_batch(self, chunks: Sequence[str], dim: int) -> list[list[float]]: ...


class Reranker(Protocol):
    model_id: str

    def rerank(self, query: str, documents: Sequence[str], top_k: int) -> list[tuple[int, float]]: ...


@dataclass
class DeterministicEmbedder:
    model_id: str = "deterministic-v1"

    def embed_batch(self, chunks: Sequence[str], dim: int) -> list[list[float]]:
        return [embed_text(c, dim) for c in chunks]


@dataclass
class OverlapReranker:
    model_id: str = "token-overlap-reranker-v1"

    def rerank(self, query: str, documents: Sequence[str], top_k: int) -> list[tuple[int, float]]:
        if top_k == 0 or not documents or not tokens_of(query):
            return []
        scored = [(k, overlap_score_of(query, d)) for k, d in enumerate(documents)]
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:top_k]


def shorten(text: str, most: int = 512) -> str:
    return text if len(text) <= most else text[:most] + "..."


def _post(what: str, endpoint: str, payload: dict, api_key: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(endpoint, json.dumps(payload).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            body = r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise Internal(f"{what} endpoint returned {e.code}: {shorten(e.read().decode('utf-8', 'replace'))}") from e
    except OSError as e:
        raise Internal(f"{what} request failed: {e}") from e
    try:
        answer = json.loads(body)
    except ValueError as e:
        raise Internal(f"the {what} answer is no JSON: {e}") from e
    if not isinstance(answer, dict):
        raise Internal(f"the {what} answer is no JSON object")
    return answer


@dataclass
class HttpEmbedder:
    """POST {"model", "input": text or texts}; {"data": [{"index", "embedding"}]} comes back, in any order."""

    endpoint: str
    model_id: str
    api_key: str | None = None
    timeout: float = 30.0

    def embed_batch(self, chunks: Sequence[str], dim: int) -> list[list[float]]:
        if not chunks:
            return []
        data = _post("embedding", self.endpoint, {"model": self.model_id, "input": chunks[0] if len(chunks) == 1 else list(chunks)}, self.api_key, self.timeout).get("data")
        if not isinstance(data, list) or len(data) != len(chunks):
            raise Internal(f"embedding count mismatch: expected {len(chunks)}, got {len(data) if isinstance(data, list) else 'none'}")
        out: list = [None] * len(chunks)
        for item in data:
            if not 0 <= item["index"] < len(chunks):
                raise Internal(f"embedding index out of range: {item['index']} (batch size {len(chunks)})")
            if len(item["embedding"]) != dim:
                raise DimensionMismatch(dim, len(item["embedding"]))
            out[item["index"]] = [float(x) for x in item["embedding"]]
        if any(v is None for v in out):
            raise Internal("an embedding is missing in the answer")
        return out


@dataclass
class HttpReranker:
    """POST {"model", "query", "documents", "top_n"}; "results" or "data" of {"index", "relevance_score" or "score"} comes back."""

    endpoint: str
    model_id: str
    api_key: str | None = None
    timeout: float = 30.0

    def rerank(self, query: str, documents: Sequence[str], top_k: int) -> list[tuple[int, float]]:
        if top_k == 0 or not documents:
            return []
        answer = _post("rerank", self.endpoint, {"model": self.model_id, "query": query, "documents": list(documents), "top_n": top_k}, self.api_key, self.timeout)
        items = answer.get("results") or answer.get("data") or []
        if not items:
            raise Internal("the rerank answer has no results")
        out = []
        for x in items:
            if not 0 <= x["index"] < len(documents):
                raise Internal(f"rerank index out of range: {x['index']} (candidate count {len(documents)})")
            score = x.get("relevance_score", x.get("score"))
            if score is None:
                raise Internal("a rerank result has neither relevance_score nor score")
            out.append((x["index"], float(score)))
        return sorted(out, key=lambda x: (-x[1], x[0]))[:top_k]


def embedder(endpoint: str | None = None, model: str = "deterministic-v1", api_key: str | None = None) -> Embedder:
    return HttpEmbedder(endpoint, model, api_key) if endpoint else DeterministicEmbedder(model)


def reranker(endpoint: str | None = None, model: str = "bge-reranker-v2-m3", api_key: str | None = None) -> Reranker | None:
    return HttpReranker(endpoint, model, api_key) if endpoint else None


def with_retries(call: Callable[[], list], tries: int = 5, wait: float = 0.5, most_wait: float = 30.0, sleep: Callable = time.sleep) -> list:
    """Failures are tried again after waits that double up to the most; the last one is raised. A wrong dimension isn't tried again."""
    for n in range(tries):
        try:
            return call()
        except DimensionMismatch:
            raise
        except Internal:
            if n == tries - 1:
                raise
            sleep(min(most_wait, wait * 2**n))
    return []


def embed_table(rows: DataFrame, provider: Embedder, dim: int, text: str = "text", name: str = "embedding", batch: int = 64, delay: float = 0.0, tries: int = 5) -> DataFrame:
    """All columns and the texts' embeddings, requested in batches by each task, with retries inside it. Null text counts as empty."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            out: list = []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                got = with_retries(lambda part=part: provider.embed_batch(part, dim), tries)
                if len(got) != len(part):
                    raise Internal("the embedder returned another number of vectors")
                out += got
                if delay:
                    time.sleep(delay)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.list_(pa.float32()))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)
