import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlode import cli
from sparlode.errors import Corruption, DimensionMismatch, Internal, InvalidConfig, SerdeError
from sparlode.operators import rerank
from sparlode.operators.filters import Eq
from sparlode.plans.ingest import PipelineConfig, RagPipeline
from sparlode.plans.search import SearchRequest, search_database
from sparlode.providers import DeterministicEmbedder, HttpEmbedder, HttpReranker, OverlapReranker, embed_table, embedder, reranker, shorten, with_retries
from sparlode.sources import files
from sparlode.sources.store import Database
from sparlode.streaming.ingest import distinct_within, stream_documents, stream_records


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, str(tmp_path / "db"), 8)


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            srv = self.server
            srv.seen.append((body, self.headers.get("Authorization")))
            status, answer = srv.answer(body) if callable(srv.answer) else srv.answer
            data = answer if isinstance(answer, bytes) else json.dumps(answer).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.seen, s.answer, s.url = [], (200, {}), f"http://127.0.0.1:{s.server_port}/v1"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_http_embedder(server):
    e = HttpEmbedder(server.url, "m", "secret")
    server.answer = lambda b: (200, {"data": [{"index": k, "embedding": [k, 1]} for k in reversed(range(len(b["input"]) if isinstance(b["input"], list) else 1))]})
    assert e.embed_batch(["a", "b"], 2) == [[0, 1], [1, 1]] and e.embed_batch(["a"], 2) == [[0, 1]] and e.embed_batch([], 2) == []
    assert server.seen[0] == ({"model": "m", "input": ["a", "b"]}, "Bearer secret") and server.seen[1][0]["input"] == "a"
    with pytest.raises(DimensionMismatch):
        e.embed_batch(["a"], 3)
    for answer in ((200, {"data": []}), (200, {"data": [{"index": 5, "embedding": [1, 1]}]}), (200, b"no json"), (500, b"x" * 2000), (200, [])):
        server.answer = answer
        with pytest.raises(Internal) as err:
            e.embed_batch(["a"], 2)
    server.answer = (500, b"x" * 2000)
    with pytest.raises(Internal) as err:
        e.embed_batch(["a"], 2)
    assert str(err.value).endswith("x" * 512 + "...") and shorten("y" * 512) == "y" * 512
    server.answer = (200, {"data": [{"index": 0, "embedding": [1, 1]}, {"index": 0, "embedding": [1, 1]}]})
    with pytest.raises(Internal):
        e.embed_batch(["a", "b"], 2)
    with pytest.raises(Internal):
        HttpEmbedder("http://127.0.0.1:9/none", "m", timeout=1).embed_batch(["a"], 2)


def test_http_reranker(server):
    r = HttpReranker(server.url, "m")
    server.answer = (200, {"results": [{"index": 1, "relevance_score": 0.5}, {"index": 0, "score": 0.9}, {"index": 2, "score": 0.1}]})
    assert r.rerank("q", ["a", "b", "c"], 2) == [(0, 0.9), (1, 0.5)] and r.rerank("q", [], 2) == [] == r.rerank("q", ["a"], 0)
    assert server.seen[0][0] == {"model": "m", "query": "q", "documents": ["a", "b", "c"], "top_n": 2}
    server.answer = (200, {"data": [{"index": 0, "score": 1}]})
    assert r.rerank("q", ["a"], 1) == [(0, 1.0)]
    for bad in ({}, {"results": [{"index": 3, "score": 1}]}, {"results": [{"index": 0}]}):
        server.answer = (200, bad)
        with pytest.raises(Internal):
            r.rerank("q", ["a"], 1)


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise Internal("busy")
        return [1]

    assert with_retries(flaky, 5, 1.0, 3.0, waits.append) == [1] and waits == [1, 2, 3]
    with pytest.raises(Internal):
        with_retries(lambda: (_ for _ in ()).throw(Internal("x")), 2, sleep=waits.append)
    assert isinstance(embedder(), DeterministicEmbedder) and isinstance(embedder("http://x"), HttpEmbedder) and reranker() is None and isinstance(reranker("http://x"), HttpReranker)


def test_embed_table(spark, server):
    server.answer = lambda b: (200, {"data": [{"index": k, "embedding": [len(t), 0]} for k, t in enumerate(b["input"] if isinstance(b["input"], list) else [b["input"]])]})
    rows = spark.createDataFrame([(i, "x" * (1 + i % 5)) for i in range(50)] + [(99, None)], "i long, text string")
    got = embed_table(rows, HttpEmbedder(server.url, "m"), 2, batch=8).collect()
    assert len(got) == 51 and all(r["embedding"] == [len(r["text"] or ""), 0] for r in got) and max(len(b["input"]) for b, _ in server.seen if isinstance(b["input"], list)) <= 8


def test_ingest_and_search(spark, db):
    p = RagPipeline(db)
    ids = p.ingest_document("doc-1", "cli-ingest", "hello world. this is a memory.")
    assert len(ids) == 30 and p.ingest_document("e", "s", "") == []
    doc = db.get_document(1)
    assert doc == {"doc_id": "doc-1", "metadata": {"doc_id": "doc-1", "source": "cli-ingest", "type": "document_chunk"}, "chunk_idx": 0, "text": "hello world. this is a memory.", "embedding_model_id": "deterministic-v1", "source": "cli-ingest", "type": "document_chunk"}
    with pytest.raises(InvalidConfig):
        p.ingest_document_with_metadata("d", ["no"], "x")
    p.ingest_document_with_metadata("d2", {"source": "web", "tags": ["a"], "created_at": 5, "other": 1}, "abc")
    doc = db.get_document(31)
    assert doc["tags"] == ["a"] and doc["created_at"] == 5 and "other" not in doc and doc["metadata"]["other"] == 1 and doc["metadata"]["doc_id"] == "d2"
    q = p.embedder.embed_batch(["hello"], 8)[0]
    found = search_database(db, SearchRequest(q, 50, "hello", filter=Eq("metadata.source", "cli-ingest"))).collect()
    assert found and all(json.loads(r["document"])["source"] == "cli-ingest" for r in found)
    assert p.search("hello world", 3)[0]["document"]["text"].startswith("hello") and p.search("hello", 0) == []


def test_rerank_reorders(spark, db):
    e = DeterministicEmbedder()
    q = e.embed_batch(["desktop local memory"], 8)[0]
    db.insert_json_batch([(q, {"doc_id": "vector-best", "text": "something else"}), ([-x for x in q], {"doc_id": "lexical-best", "text": "desktop local memory"})])
    assert RagPipeline(db).search("desktop local memory", 1)[0]["document"]["doc_id"] == "vector-best"
    hits = RagPipeline(db, reranker=OverlapReranker(), config=PipelineConfig(rerank_candidates=50)).search("desktop local memory", 2)
    assert hits[0]["document"]["doc_id"] == "lexical-best" and hits[0]["score"] == pytest.approx(0.75 + 0.25 * 3 / 4 + 0.2) or hits[0]["score"] == pytest.approx(1.1375, abs=0.1)
    assert hits[1]["document"]["doc_id"] == "vector-best"


def test_rerank_merging(spark, db):
    class Fixed:
        model_id = "fixed"

        def __init__(self, out):
            self.out = out

        def rerank(self, *a):
            return self.out

    hits = [{"id": i, "score": 1 - i / 10, "document": {"text": str(i)}} for i in range(4)]
    run = lambda out, k: [(h["id"], h["score"]) for h in RagPipeline(db, reranker=Fixed(out)).rerank("q", hits, k)]
    assert run([(2, 5.0), (2, 4.0), (1, 6.0)], 4) == [(1, 6.0), (2, 5.0), (0, 1.0), (3, 0.7)]
    assert run([], 2) == [(0, 1.0), (1, 0.9)] and run([(3, 0.0)], 1) == [(3, 0.0)]
    with pytest.raises(Internal):
        run([(9, 1.0)], 2)
    c = spark.createDataFrame([(0, i + 1, i, 1 - i / 10) for i in range(4)], "qid int, rank int, id int, score double")
    r = spark.createDataFrame([(0, 2, 5.0), (0, 2, 4.0), (0, 1, 6.0)], "qid int, id int, score double")
    assert [(x["id"], x["score"]) for x in rerank.merge(c, r, 4).orderBy("rank").collect()] == run([(2, 5.0), (2, 4.0), (1, 6.0)], 4)
    assert OverlapReranker().rerank("?", ["a"], 1) == [] and OverlapReranker().rerank("a b", ["x", "a b", "a"], 2) == [(1, pytest.approx(1.2)), (2, pytest.approx(0.625))]


def test_rerank_documents(spark):
    docs = [{"title": " T ", "text": "x\n", "tags": ["a", "b"]}, {"metadata": {"title": "m", "tags": "t"}}, {"n": 1}, {"text": " "}]
    assert [rerank.document_of(d) for d in docs] == ["title: T\ntext: x\ntags: a, b", "title: m\ntags: t", '{"n":1}', '{"text":" "}']


def test_table_ingest_equals_single(spark, tmp_path):
    docs = [("a", '{"source":"s","tags":["t"]}', "one. two three four five six seven"), ("b", None, ""), ("c", "{}", "eight nine")]
    one, many = (Database.create(spark, str(tmp_path / x), 8) for x in ("one", "many"))
    p, q = (RagPipeline(d, config=PipelineConfig(12, 3)) for d in (one, many))
    for i, m, t in docs:
        p.ingest_document_with_metadata(i, json.loads(m or "{}"), t)
    q.ingest_table(spark.createDataFrame(docs, "doc_id string, metadata string, text string"))
    rows = lambda d: [(r["id"], r["embedding"], r["document"]) for r in d.records().orderBy("id").collect()]
    assert rows(one) == rows(many) and len(rows(one)) > 5


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb")
    assert files.read_text(spark, str(tmp_path / "t.txt")).first()["text"] == "a\nb"
    (tmp_path / "j").write_text('{"id":1,"text":"x"}\n\n{"text":"  "}\n{"text":"y"}\n{"other":1}\n')
    assert [r["text"] for r in files.read_jsonl(spark, str(tmp_path / "j")).collect()] == ["x", "y"] and files.read_jsonl(spark, str(tmp_path / "j"), 1).count() == 1
    (tmp_path / "bad").write_text("{no\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad")).collect()
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    files.write_matrix(x, str(tmp_path / "m"))
    assert [r["values"] for r in files.read_matrix(spark, str(tmp_path / "m"), 3).orderBy("row_idx").collect()] == x.tolist()
    files.write_matrix(x.astype(int), str(tmp_path / "i"))
    assert files.read_matrix(spark, str(tmp_path / "i"), 3, "i32", limit=2).count() == 2
    with pytest.raises(Corruption):
        files.read_matrix(spark, str(tmp_path / "m"), 5)
    for args in ((None, None, "x"), ("1", "f", "x"), ("{", None, "x")):
        with pytest.raises(SerdeError):
            files.json_argument(*args)
    for f, v in ((files.embedding_argument, [1, True]), (files.embedding_argument, {}), (files.document_argument, [])):
        with pytest.raises(SerdeError):
            f(v)
    files.write_summary({"a": 1}, str(tmp_path / "s"))
    assert json.loads((tmp_path / "s").read_text()) == {"a": 1}


def test_downloads(tmp_path):
    pages = {0: [{"row": {"text": " long enough "}}, {"row": {"text": "no"}}], 2: [{"row": {"text": "also long"}}], 3: []}
    fails, waits = [OSError(), OSError()], []

    class Answer:
        def __init__(self, url):
            self.body = json.dumps({"rows": pages[int(url.split("=")[1])]}).encode()

        def __enter__(self):
            if fails:
                raise fails.pop()
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return self.body

    n = files.download_rows(lambda at, size: f"http://x?at={at}", str(tmp_path / "o"), 10, min_chars=5, open_url=lambda u, timeout: Answer(u), sleep=waits.append)
    assert n == 2 and waits == [1, 2] and [json.loads(x) for x in (tmp_path / "o").read_text().splitlines()] == [{"id": 0, "text": "long enough"}, {"id": 1, "text": "also long"}]
    with pytest.raises(OSError):
        files.fetch_json("u", tries=2, open_url=lambda u, timeout: (_ for _ in ()).throw(OSError()), sleep=waits.append)


def test_command_line(spark, tmp_path, capsys):
    d = ["--db", str(tmp_path / "db")]
    run = lambda *a: (cli.main([*d, *a]), capsys.readouterr())
    assert run("check-health")[0] == 1
    assert run("create", "--embedding-dim", "3")[0] == 0 and run("create")[0] == 1
    code, out = run("insert", "--embedding-json", "[1,0,0]", "--document-json", '{"text":"apple","doc_id":"d"}')
    assert code == 0 and json.loads(out.out) == {"status": "ok", "id": 1}
    (tmp_path / "e").write_text("[0,1,0]")
    (tmp_path / "doc").write_text('{"text":"pear","source":"s"}')
    assert run("insert", "--embedding-file", str(tmp_path / "e"), "--document-file", str(tmp_path / "doc"))[0] == 0
    assert run("insert", "--embedding-json", "[1]", "--document-json", "{}")[0] == 1 and run("insert", "--embedding-json", "[1,0,0]", "--document-json", "[]")[0] == 1
    assert json.loads(run("get", "--id", "1", "--include-embedding", "--json")[1].out)["embedding"] == [1, 0, 0] and run("get", "--id", "9")[0] == 1
    assert run("update", "--id", "1", "--embedding-json", "[0,0,1]", "--document-json", '{"text":"plum"}')[0] == 0 and run("update", "--id", "9", "--embedding-json", "[0,0,1]", "--document-json", "{}")[0] == 1
    (tmp_path / "f.txt").write_text("apples and pears")
    assert "chunks" in run("ingest", "--file", str(tmp_path / "f.txt"), "--doc-id", "file")[1].out
    hits = json.loads(run("search", "pear", "-k", "2", "--json")[1].out)
    assert len(hits) == 2 and "[Score: " in run("search", "pear")[1].out
    assert [h["id"] for h in json.loads(run("search", "pear", "--json", "--where", "source=s", "--alpha", "0.5")[1].out)] == [2]
    assert run("delete", "--id", "2")[0] == 0 and run("delete", "--id", "2")[0] == 1
    assert "OK" in run("check-health")[1].out and "records_compacted" in run("optimize", "--repair-graph")[1].out
    assert "records_compacted: 0" in run("optimize", "--checkpoint-wal-only")[1].out


def test_streams(spark, tmp_path, db):
    source = spark.createDataFrame([(i, [float(i)] * 8, json.dumps({"i": i})) for i in range(20)], "k int, embedding array<float>, document string")
    source.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    stream_records(rows, db, str(tmp_path / "c"), ["k"]).awaitTermination()
    assert db.count() == 20 and db.get_document(3) == {"i": 2}
    stream_records(rows, db, str(tmp_path / "c"), ["k"]).awaitTermination()
    assert db.count() == 20
    docs = spark.createDataFrame([("a", "{}", "some text")], "doc_id string, metadata string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    stream_documents(stream, RagPipeline(db), str(tmp_path / "c2")).awaitTermination()
    assert db.count() == 29
    times = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "id int, t int").select("id", F.timestamp_seconds("t").alias("ts"))
    times.write.parquet(str(tmp_path / "ts"))
    s = distinct_within(spark.readStream.schema(times.schema).parquet(str(tmp_path / "ts")), "id", "ts", "1 hour")
    s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select id from once").count() == 2
