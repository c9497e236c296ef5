"""Chunk, embed and store documents; search them, with an optional reranker."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Internal, InvalidConfig
from ..functions import text as text_
from ..functions.json import canonical
from ..functions.pieces import pieces
from ..operators.rerank import document_of
from ..providers import DeterministicEmbedder, Embedder, Reranker, embed_table
from ..sources.store import Database
from .search import SearchRequest, search_database

MIRRORED = ("source", "type", "created_at", "tags", "session_id")


@dataclass
class PipelineConfig:
    chunk_size: int = 512
    chunk_overlap: int = 64
    tail: str = "all"
    rerank_candidates: int = 100


def chunk_document(doc_id: str, metadata: dict, index: int, chunk: str, model_id: str) -> dict:
    """The document of one chunk: metadata with defaults, and its known keys once more at the top."""
    meta = {"doc_id": doc_id, "type": "document_chunk", **metadata}
    doc = {"doc_id": doc_id, "metadata": meta, "chunk_idx": index, "text": chunk, "embedding_model_id": model_id}
    return doc | {k: meta[k] for k in MIRRORED if k in meta}


class RagPipeline:
    def __init__(self, db: Database, embedder: Embedder | None = None, reranker: Reranker | None = None, config: PipelineConfig | None = None):
        self.db, self.embedder, self.reranker = db, embedder or DeterministicEmbedder(), reranker
        self.config = config or PipelineConfig()
        self.config.rerank_candidates = max(1, self.config.rerank_candidates)

    def ingest_document(self, doc_id: str, source: str, content: str) -> list[int]:
        return self.ingest_document_with_metadata(doc_id, {"doc_id": doc_id, "source": source, "type": "document_chunk"}, content)

    def ingest_document_with_metadata(self, doc_id: str, metadata: Any, content: str) -> list[int]:
        """The ids of the chunks, all of which are inserted in one commit."""
        if not isinstance(metadata, dict):
            raise InvalidConfig("metadata must be a JSON object")
        chunks = text_.split_text(content, self.config.chunk_size, self.config.chunk_overlap, self.config.tail)
        if not chunks:
            return []
        vectors = self.embedder.embed_batch(chunks, self.db.dim)
        if len(vectors) != len(chunks):
            raise Internal("the embedder returned another number of vectors")
        return self.db.insert_json_batch([(v, chunk_document(doc_id, metadata, k, c, self.embedder.model_id)) for k, (c, v) in enumerate(zip(chunks, vectors, strict=True))])

    def chunk_table(self, documents: DataFrame) -> DataFrame:
        """(doc_id, chunk_idx, text, document) of a table (doc_id, metadata as a JSON object's text, text)."""
        model = self.embedder.model_id
        chunks = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "metadata", F.posexplode(text_.split(F.col("text"), self.config.chunk_size, self.config.chunk_overlap, self.config.tail)).alias("chunk_idx", "text"))

        @F.arrow_udf(T.StringType())
        def build(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for batch in batches:
                for piece in pieces(*batch):
                    out = []
                    for i, m, k, c in zip(*(x.to_pylist() for x in piece), strict=True):
                        meta = {} if m is None else json.loads(m)
                        if not isinstance(meta, dict):
                            raise InvalidConfig("metadata must be a JSON object")
                        out.append(canonical(chunk_document(i, meta, k, c, model)))
                    yield pa.array(out, type=pa.string())

        return chunks.withColumn("document", build("doc_id", "metadata", "chunk_idx", "text"))

    def ingest_table(self, documents: DataFrame, stream: tuple[str, int] | None = None) -> tuple[int, int]:
        """(first id, chunks): a whole table of documents in one commit, chunks in order of (doc_id, chunk_idx). ``stream``: as in insert_table."""
        rows = embed_table(self.chunk_table(documents), self.embedder, self.db.dim)
        return self.db.insert_table(rows, [F.col("doc_id"), F.col("chunk_idx")], stream=stream)

    def search(self, query: str, top_k: int) -> list[dict]:
        """Hits (id, score, document), of a hybrid search and the reranker if there is one."""
        if top_k == 0:
            return []
        vectors = self.embedder.embed_batch([query], self.db.dim)
        if not vectors:
            raise Internal("the embedder returned no vector for the query")
        want = max(top_k, self.config.rerank_candidates) if self.reranker else top_k
        found = search_database(self.db, SearchRequest(vectors[0], want, text_query=query)).collect()
        hits = [{"id": r["id"], "score": r["score"], "document": json.loads(r["document"])} for r in found]
        return self.rerank(query, hits, top_k)

    def rerank(self, query: str, hits: list[dict], top_k: int) -> list[dict]:
        """Reranked hits with their new scores, then the others in their order with their old ones."""
        if self.reranker is None or not hits or top_k == 0:
            return hits[:top_k]
        ranked = self.reranker.rerank(query, [document_of(h["document"]) for h in hits], min(top_k, len(hits)))
        if not ranked:
            return hits[:top_k]
        out, seen = [], set()
        for k, score in sorted(ranked, key=lambda x: (-x[1], x[0])):
            if not 0 <= k < len(hits):
                raise Internal(f"reranker '{self.reranker.model_id}' returned index {k} for {len(hits)} candidates")
            if k not in seen:
                seen.add(k)
                out.append({**hits[k], "score": score})
        return [*out, *(h for k, h in enumerate(hits) if k not in seen)][:top_k]
