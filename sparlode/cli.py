"""The command line: python -m sparlode.cli --db PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import OptimizeRequest
from .errors import EngineError, NotFound
from .operators.filters import And, Eq
from .plans.ingest import PipelineConfig, RagPipeline
from .plans.search import SearchRequest, search_database
from .providers import embedder, reranker
from .sources.files import document_argument, embedding_argument, format_hits, json_argument
from .sources.store import Database


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparlode", description=__doc__)
    p.add_argument("-d", "--db", default="./sparlode_data", help="directory of the database")
    p.add_argument("--embedding-endpoint")
    p.add_argument("--embedding-model", default="deterministic-v1")
    p.add_argument("--embedding-api-key")
    p.add_argument("--reranker-endpoint")
    p.add_argument("--reranker-model", default="bge-reranker-v2-m3")
    p.add_argument("--reranker-api-key")
    p.add_argument("--rerank-candidates", type=int, default=100)
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("create", help="a new database")
    x.add_argument("--embedding-dim", type=int, default=512)
    x = c.add_parser("ingest", help="a text file, in chunks")
    x.add_argument("-f", "--file", required=True)
    x.add_argument("--doc-id", default="doc")
    x = c.add_parser("search", help="a hybrid search")
    x.add_argument("query")
    x.add_argument("-k", "--top-k", type=int, default=5)
    x.add_argument("--json", action="store_true")
    x.add_argument("--where", action="append", default=[], metavar="PATH=JSON", help="equality that hits must have; may be repeated")
    x.add_argument("--radius", type=float)
    x.add_argument("--alpha", type=float)
    x.add_argument("--ef", type=int)
    for name in ("insert", "update"):
        x = c.add_parser(name)
        if name == "update":
            x.add_argument("--id", type=int, required=True)
        for what in ("embedding", "document"):
            x.add_argument(f"--{what}-json")
            x.add_argument(f"--{what}-file")
    x = c.add_parser("get")
    x.add_argument("--id", type=int, required=True)
    x.add_argument("--include-embedding", action="store_true")
    x.add_argument("--json", action="store_true")
    x = c.add_parser("delete")
    x.add_argument("--id", type=int, required=True)
    c.add_parser("check-health")
    x = c.add_parser("optimize")
    x.add_argument("--no-compact", dest="compact", action="store_false")
    x.add_argument("--checkpoint-wal-only", dest="checkpoint_only", action="store_true")
    x.add_argument("--repair-graph", dest="repair", action="store_true")
    return p


def _where(text: str) -> Eq:
    path, _, value = text.partition("=")
    try:
        return Eq(path, json.loads(value))
    except ValueError:
        return Eq(path, value)


def _record(a) -> tuple[list[float], dict]:
    return embedding_argument(json_argument(a.embedding_json, a.embedding_file, "embedding")), document_argument(json_argument(a.document_json, a.document_file, "document"))


def run(a: argparse.Namespace, spark: SparkSession) -> str:
    if a.command == "create":
        Database.create(spark, a.db, a.embedding_dim)
        return f"Created a database of dimension {a.embedding_dim} at {a.db}"
    db = Database.open(spark, a.db)
    if a.command in ("ingest", "search"):
        pipeline = RagPipeline(db, embedder(a.embedding_endpoint, a.embedding_model, a.embedding_api_key), reranker(a.reranker_endpoint, a.reranker_model, a.reranker_api_key), PipelineConfig(rerank_candidates=a.rerank_candidates))
    if a.command == "ingest":
        ids = pipeline.ingest_document(a.doc_id, "cli-ingest", Path(a.file).read_text())
        return f"Ingested {len(ids)} chunks of {a.file}"
    if a.command == "search":
        if a.where or a.radius is not None or a.alpha is not None or a.ef is not None:
            vector = pipeline.embedder.embed_batch([a.query], db.dim)[0]
            request = SearchRequest(vector, a.top_k, a.query, a.alpha, None, And(*map(_where, a.where)) if a.where else None, a.ef, a.radius)
            hits = [{"id": r["id"], "score": r["score"], "document": json.loads(r["document"])} for r in search_database(db, request).collect()]
        else:
            hits = pipeline.search(a.query, a.top_k)
        return format_hits(hits, a.query, a.json)
    if a.command == "insert":
        return json.dumps({"status": "ok", "id": db.insert_json(*_record(a))}, indent=2)
    if a.command == "update":
        db.update_json(a.id, *_record(a))
        return json.dumps({"status": "ok", "id": a.id}, indent=2)
    if a.command == "delete":
        db.remove(a.id)
        return json.dumps({"status": "ok", "id": a.id}, indent=2)
    if a.command == "get":
        record = db.get_record(a.id)
        if record is None:
            raise NotFound(a.id)
        out = {"id": a.id} | ({"embedding": record[0]} if a.include_embedding else {}) | {"document": record[1]}
        return json.dumps(out, indent=None if a.json else 2, ensure_ascii=False)
    if a.command == "check-health":
        return f"Database health check: OK ({db.check_health()['records']} records)"
    compact = a.compact and not a.checkpoint_only
    report = db.optimize(OptimizeRequest(compact, a.checkpoint_only, a.repair))
    return "\n".join(["Optimization complete:", *(f"  {k}: {v}" for k, v in vars(report).items())])


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("sparlode").getOrCreate()
    try:
        print(run(a, spark))
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
