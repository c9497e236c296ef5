"""The queries of the retrieval engine over the test tables, and the SQL that each must agree with."""

from __future__ import annotations

import math
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, text
from .functions import vector as V
from .functions.json import derive, json_path
from .operators import exact, filters, graph, hybrid, ivf, lexical, rerank, vptree
from .errors import EngineError
from .operators.filters import And, Eq
from .plans.search import SearchRequest, nearest_in_cells, search, search_batch, search_database
from .sources.store import Database, fold
from .storage_util import save, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
QUERY_TEXT = "the of pathetic que und src3"
OTHER_TEXT = "the ation und"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. One of fewer files than there are cores is spread over them, as a file of one row group is read by one task."""
    t, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return t.repartition(cores) if name == "documents" and len(t.inputFiles()) < cores else t


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def first_vector(spark, sf) -> list[float]:
    """The vector that searches with one query look for."""
    return list(embeddings(spark, sf).orderBy("id").first()["embedding"])


def _quoted(c) -> Column:
    """The JSON text of a column's value, by built-in functions."""
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def documents(spark, sf) -> DataFrame:
    """All documents as records without a vector, with what the store derives from the JSON when it is written."""
    return table(spark, sf, "documents").select(
        (F.col("doc_id") + 1).alias("id"), F.to_json(F.struct("doc_id", F.col("lang").alias("language"), "source", "text", F.col("lang").alias("type"))).alias("document"),
        "text", F.col("source").alias("title"), F.col("lang").alias("tags_text"), "source", "lang",
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("source"), _quoted("source"), F.lit("type"), _quoted("lang")).alias("payload"),
    )


def records(spark, sf) -> DataFrame:
    """Those of the documents that have an embedding, with it."""
    e = embeddings(spark, sf).select((F.col("id") + 1).alias("id"), "embedding")
    return documents(spark, sf).join(e, "id")


# SQL: vectors as lists of doubles, summed in order; float sums over rows in a fixed order too.

VEC = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT v AS qv FROM e ORDER BY id LIMIT 1)"
COS = "1 - list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)))"
SUM = "list_reduce(list_prepend(0.0::DOUBLE, {}), lambda a, x: a + x)"
L2 = SUM.format("list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))")
IP = "-list_dot_product(v, qv)"
REC = "rec AS (SELECT d.doc_id + 1 AS id, e.embedding::DOUBLE[] AS v, d.text, d.source, d.lang FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), qq AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _topk_sql(dist: str, k: int = 10) -> str:
    return f"WITH {VEC}, d AS (SELECT id, {dist} AS dist FROM e, q) SELECT id, dist, row_number() OVER (ORDER BY dist, id)::INTEGER AS rank FROM d QUALIFY rank <= {k}"


def _topk(metric: str):
    def run(spark, sf):
        best = exact.topk(embeddings(spark, sf), first_vector(spark, sf), 10, metric)
        return exact.rank_within(best, None, "dist", "id", by=None)

    return run


for _metric, _dist in (("cosine", COS), ("l2", L2), ("ip", IP)):
    QUERIES[f"exact_topk_{_metric}"], ORACLE_SQL[f"exact_topk_{_metric}"] = _topk(_metric), _topk_sql(_dist)

PAIRS = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT a.id AS qid, b.id, {} AS dist FROM e b, (SELECT id, v AS qv FROM e) a{})"
BATCH = f"WITH {PAIRS.format(COS, '')} SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank FROM p QUALIFY rank <= 10"


@query(BATCH)
def batch_topk_cosine(spark, sf):
    e = embeddings(spark, sf)
    return exact.batch_topk(e, e, 10, qid="id", query_vector="embedding")


@query(BATCH)
def batch_topk_pairwise(spark, sf):
    """The way that query tables go that are too large to broadcast."""
    e = embeddings(spark, sf)
    return exact.batch_topk(e, e, 10, qid="id", query_vector="embedding", broadcast_bytes=0)


@query(f"WITH {VEC}, d AS (SELECT id, {L2} AS dist FROM e, q) SELECT id, dist FROM d WHERE dist <= 1.8")
def radius_search(spark, sf):
    return exact.within_radius(embeddings(spark, sf), first_vector(spark, sf), 1.8, "l2")


@query(f"WITH {VEC}, d AS (SELECT id, {L2} AS dist FROM e, q), r AS (SELECT dist AS radius FROM d ORDER BY id DESC LIMIT 1) SELECT id, dist FROM d, r WHERE dist <= radius")
def radius_boundary(spark, sf):
    """The radius is the very distance of the last vector, which is kept."""
    e, v = embeddings(spark, sf), first_vector(spark, sf)
    radius = exact.with_distance(e, v, "l2").orderBy(F.desc("id")).first()["dist"]
    return exact.within_radius(e, v, radius, "l2")


def _hits(spark, sf, request: SearchRequest, rows: DataFrame | None = None, **how) -> DataFrame:
    """(rank, id, score, source, digest of the document's text)"""
    r = records(spark, sf) if rows is None else rows
    hits = search(r, request, dim=64, **how)
    return hits.select("rank", "id", "score", *(F.get_json_object("document", f"$.{k}").alias(k) for k in ("source", "text"))).withColumn("digest", F.md5("text")).drop("text")


def _vector_hits_sql(where: str, k: int = 10, dist: str = COS, score: str = "1 - ({})", pool: str = "") -> str:
    """pool: what restricts the rows before the others of ``where`` do."""
    return f"WITH {REC}, d AS (SELECT * EXCLUDE (v, qv), v, {score.format(dist)} AS score FROM rec, qq), p AS (SELECT * FROM d {pool}) SELECT id, source, md5(text) AS digest, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM p WHERE {where} QUALIFY rank <= {k}"


@query(_vector_hits_sql("source = 'src3'"))
def filtered_topk_eq(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=Eq("source", "src3")))


@query(_vector_hits_sql("source = 'src3' AND lang = 'en'"))
def filtered_topk_and(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=And(Eq("source", "src3"), And(Eq("type", "en")))))


@query(_vector_hits_sql("FALSE"))
def filter_unseen_value(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=Eq("source", "no such source")))


@query(_vector_hits_sql("TRUE"))
def filter_empty_and(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=And()))


@query(_vector_hits_sql("lang = 'fr'", pool="ORDER BY score DESC, id LIMIT 50"))
def residual_filter_reference_pool(spark, sf):
    """A path that isn't indexed is looked at after the pool has been cut to ef."""
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=Eq("language", "fr")), pool="reference")


@query(_vector_hits_sql("lang = 'fr' AND source = 'src3'", pool="WHERE source = 'src3' ORDER BY score DESC, id LIMIT 200"))
def residual_filter_behind_an_indexed_one(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=And(Eq("source", "src3"), Eq("language", "fr"))), pool="reference")


@query(_vector_hits_sql("TRUE", dist=L2, score="-({})"))
def search_l2(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10), metric="l2")


@query(_vector_hits_sql("TRUE", dist=IP, score="-({})"))
def search_ip(spark, sf):
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10), metric="ip")


@query("SELECT event_id, user_id FROM events WHERE json_extract(props, '$.k')::VARCHAR = '69'")
def filter_json_path(spark, sf):
    """A path that isn't indexed."""
    e = table(spark, sf, "events").withColumn("payload", F.create_map().cast("map<string,string>"))
    return e.filter(filters.plan(Eq("k", 69), document="props").condition).select("event_id", "user_id")


@query("SELECT json_extract(props, '$.k')::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1")
def json_path_values(spark, sf):
    return table(spark, sf, "events").groupBy(json_path(F.col("props"), "k").alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t")
def tokenize_documents(spark, sf):
    t = table(spark, sf, "documents").withColumn("t", text.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH t AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, id, least(count(*), 65535) AS tf FROM t GROUP BY ALL")
def term_frequencies(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), {"text": "text"}, id="doc_id").select("term", "id", F.col("tf_text").alias("tf"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def document_frequencies(spark, sf):
    return lexical.document_frequencies(lexical.postings(table(spark, sf, "documents"), {"text": "text"}, id="doc_id"))


def _bm25_sql(source: str, fields: dict[str, str], query_text: str = QUERY_TEXT, allowed: str = "TRUE") -> str:
    """CTEs up to ``lex`` (id, score) from ``source`` (id and the columns of fields)."""
    weights = lexical.FIELDS
    parts = " UNION ALL ".join(f"SELECT id, '{f}' AS field, unnest({TOKENS.format(c)}) AS term FROM {source}" for f, c in fields.items())
    tfs = ", ".join(f"least(count(*) FILTER (field = '{f}'), 65535)::DOUBLE AS tf_{f}" for f in fields)
    lens = ", ".join(f"len({TOKENS.format(c)})::DOUBLE AS len_{f}" for f, c in fields.items())
    tots = ", ".join(f"sum(len_{f}) AS total_{f}" for f in fields)
    tf = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN tf_{f} > 0 THEN {weights[f]}::DOUBLE * (tf_{f} / greatest(0.25::DOUBLE + 0.75::DOUBLE * (len_{f} / greatest(total_{f} / n, 1e-6::DOUBLE)), 1e-6::DOUBLE)) ELSE 0 END" for f in fields)])
    return f"""words AS ({parts}), post AS (SELECT term, id, {tfs} FROM words GROUP BY term, id),
lens AS (SELECT id, {lens} FROM {source}), st AS (SELECT count(*)::DOUBLE AS n, {tots} FROM lens),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
qt AS (SELECT term, count(*)::DOUBLE AS qtf FROM (SELECT unnest({TOKENS.format("'" + query_text + "'")}) AS term) GROUP BY term),
ok AS (SELECT id FROM {source} WHERE {allowed}),
parts AS (SELECT id, term, n, df, qtf, ({tf}) AS tf FROM post JOIN lens USING (id) JOIN dfs USING (term) JOIN qt USING (term), st WHERE id IN (SELECT id FROM ok)),
lex AS (SELECT id, {SUM.format("list(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * ((tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE)) * qtf ORDER BY term)")} AS score FROM parts GROUP BY id)"""


DOCS = "docs AS (SELECT doc_id AS id, text, source AS title, lang AS tags FROM documents)"
LEX_TOP = "SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM lex QUALIFY rank <= 50"


def _bm25(spark, sf, fields: dict[str, str], allowed=None) -> DataFrame:
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    scored = lexical.search_scores(d, fields, QUERY_TEXT, allowed=allowed)
    return lexical.topk(scored, 50).select("id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {DOCS}, {_bm25_sql('docs', {'text': 'text'})} {LEX_TOP}")
def bm25f_text(spark, sf):
    return _bm25(spark, sf, {"text": "text"})


@query(f"WITH {DOCS}, {_bm25_sql('docs', {'text': 'text', 'title': 'title', 'tags': 'tags'})} {LEX_TOP}")
def bm25f_multifield(spark, sf):
    return _bm25(spark, sf, {"text": "text", "title": "source", "tags": "lang"})


@query(f"WITH {DOCS}, {_bm25_sql('docs', {'text': 'text', 'title': 'title', 'tags': 'tags'})} {LEX_TOP}")
def bm25f_kept_postings(spark, sf):
    """The same from postings and lengths that are written once."""
    d, fields = table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), {"text": "text", "title": "source", "tags": "lang"}
    post, lens = save(lexical.postings(d, fields), "postings"), save(lexical.lengths(d, fields), "lengths")
    scored = lexical.scores(post, lens, lexical.literal_terms(spark, QUERY_TEXT))
    return lexical.topk(scored, 50).select("id", F.round("score", 9).alias("score"), "rank")


FILTERED = _bm25_sql("docs", {"text": "text", "title": "title", "tags": "tags"}, allowed="tags = 'fr'")


@query(f"WITH {DOCS}, {FILTERED} {LEX_TOP}")
def bm25f_filtered(spark, sf):
    return _bm25(spark, sf, {"text": "text", "title": "source", "tags": "lang"}, F.col("lang") == "fr")


@query(
    "SELECT event_id, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (value - lo) / (hi - lo) END AS norm FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)"
)
def minmax_normalize(spark, sf):
    return hybrid.minmax(table(spark, sf, "events"), "value", by="event_type").select("event_id", "norm")


RFIELDS = {"text": "text", "title": "source", "tags": "lang"}


def _hybrid_sql(alpha: float, radius: float | None = None, k: int = 10, pool: int = 200) -> str:
    norm = "CASE WHEN max(score) OVER () - min(score) OVER () < 1e-12 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"
    near = "" if radius is None else f"WHERE v.dist <= {radius}"
    return f"""WITH {REC}, {_bm25_sql("rec", RFIELDS)},
near AS (SELECT id, {COS} AS dist FROM rec, qq ORDER BY dist, id LIMIT {pool}),
vp AS (SELECT id, dist, {norm.replace("score", "(1 - dist)")} AS s FROM near),
lp AS (SELECT id, {norm} AS s FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT {pool})),
f AS (SELECT coalesce(v.id, l.id) AS id, {alpha}::DOUBLE * coalesce(v.s, 0) + {1.0 - alpha!r}::DOUBLE * coalesce(l.s, 0) AS score FROM vp v FULL JOIN lp l ON v.id = l.id {near})
SELECT f.id, source, md5(text) AS digest, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, f.id)::INTEGER AS rank FROM f JOIN rec USING (id) QUALIFY rank <= {k}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 9))


@query(_hybrid_sql(0.65))
def hybrid_fusion(spark, sf):
    """Vector and text together over all records, with the default weights."""
    return _rounded(_hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, QUERY_TEXT)))


@query(_hybrid_sql(0.0))
def hybrid_alpha_zero(spark, sf):
    return _rounded(_hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, QUERY_TEXT, hybrid_alpha=-3.0)))


@query(_hybrid_sql(1.0))
def hybrid_alpha_one(spark, sf):
    return _rounded(_hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, QUERY_TEXT, hybrid_alpha=7.0)))


@query(_hybrid_sql(0.65, radius=0.8))
def hybrid_radius(spark, sf):
    return _rounded(_hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, QUERY_TEXT, radius=0.8)))


@query(_hybrid_sql(0.65, pool=50).replace("LIMIT 50)),", "LIMIT 200)),", 1))
def hybrid_reference_pool(spark, sf):
    """The vector pool is cut to ef = 50, as an approximate index would."""
    return _rounded(_hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, QUERY_TEXT), pool="reference"))


ALL = "rec AS (SELECT doc_id + 1 AS id, text, source, lang FROM documents)"


def _lex_only_sql(fields: dict[str, str]) -> str:
    return f"{_bm25_sql('rec', fields)}, lp AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-12 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 10)) SELECT lp.id, source, md5(text) AS digest, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, lp.id)::INTEGER AS rank FROM lp JOIN rec USING (id)"


@query(f"WITH {ALL}, {_lex_only_sql(RFIELDS)}")
def lexical_only(spark, sf):
    return _rounded(_hits(spark, sf, SearchRequest([], 10, f"  {QUERY_TEXT} "), documents(spark, sf)))


@query(f"""WITH rec AS (SELECT d.doc_id + 1 AS id, e.embedding::DOUBLE[] AS v, d.text, d.source, d.lang FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
words AS (SELECT id, unnest({TOKENS.format("text")}) AS term, 'text' AS field FROM rec UNION ALL SELECT id, unnest({TOKENS.format("source")}), 'title' FROM rec UNION ALL SELECT id, unnest({TOKENS.format("lang")}), 'tags' FROM rec),
post AS (SELECT term, id, {", ".join(f"least(count(*) FILTER (field = '{f}'), 65535)::DOUBLE AS tf_{f}" for f in RFIELDS)} FROM words GROUP BY term, id),
lens AS (SELECT id, {", ".join(f"len({TOKENS.format(c)})::DOUBLE AS len_{f}" for f, c in RFIELDS.items())} FROM rec),
st AS (SELECT count(*)::DOUBLE AS n, {", ".join(f"sum(len_{f}) AS total_{f}" for f in RFIELDS)} FROM lens),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
qt AS (SELECT qid, term, count(*)::DOUBLE AS qtf FROM (SELECT id AS qid, unnest({TOKENS.format("source")}) AS term FROM rec) GROUP BY ALL),
parts AS (SELECT qid, id, term, n, df, qtf, ({" + ".join(["0.0::DOUBLE", *(f"CASE WHEN tf_{f} > 0 THEN {lexical.FIELDS[f]}::DOUBLE * (tf_{f} / greatest(0.25::DOUBLE + 0.75::DOUBLE * (len_{f} / greatest(total_{f} / n, 1e-6::DOUBLE)), 1e-6::DOUBLE)) ELSE 0 END" for f in RFIELDS)])}) AS tf FROM post JOIN qt USING (term) JOIN dfs USING (term) JOIN lens USING (id), st),
lex AS (SELECT qid, id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * ((tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE)) * qtf) AS score FROM parts GROUP BY qid, id),
near AS (SELECT qid, id, 1 - dist AS score FROM (SELECT a.id AS qid, b.id, {COS} AS dist FROM rec b, (SELECT id, v AS qv FROM rec) a) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= 100),
vp AS (SELECT qid, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM near WINDOW w AS (PARTITION BY qid)),
lt AS (SELECT qid, id, score FROM lex QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 100),
lp AS (SELECT qid, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lt WINDOW w AS (PARTITION BY qid)),
f AS (SELECT coalesce(v.qid, l.qid) AS qid, coalesce(v.id, l.id) AS id, 0.65::DOUBLE * coalesce(v.s, 0) + 0.35::DOUBLE * coalesce(l.s, 0) AS score FROM vp v FULL JOIN lp l ON v.qid = l.qid AND v.id = l.id)
SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 5""")
def hybrid_batch(spark, sf):
    """Every record's vector and title as a query."""
    r = records(spark, sf)
    return _rounded(search_batch(r, r.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"), F.col("title").alias("text")), 5))


# Mutations

LOG_SQL = """log AS (
  SELECT o_orderkey AS seq, 'insert' AS op, o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders
  UNION ALL SELECT 1000000000 + o_orderkey, 'update', o_orderkey, o_totalprice * 2, 'U' FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 2000000000 + o_orderkey, 'delete', o_orderkey, NULL, NULL FROM orders WHERE o_orderpriority = '1-URGENT'),
live AS (SELECT id, price, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND op <> 'delete')"""


def _log(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    row = lambda d, base, op, p, s: d.select((key + base).alias("seq"), F.lit(op).alias("op"), key.alias("id"), p.cast("double").alias("price"), s.cast("string").alias("status"))
    none = F.lit(None)
    return (
        row(o, 0, "insert", price, F.col("o_orderstatus"))
        .union(row(o.filter("o_orderstatus = 'O'"), 1_000_000_000, "update", price * 2, F.lit("U")))
        .union(row(o.filter("o_orderpriority = '1-URGENT'"), 2_000_000_000, "delete", none, none))
    )


@query(f"WITH {LOG_SQL} SELECT id, price, status FROM live")
def current_state_after_mutations(spark, sf):
    return fold(_log(spark, sf), ["price", "status"])


@query(f"WITH {LOG_SQL} SELECT status, count(*) AS n, min(id) AS least, max(id) AS greatest FROM live GROUP BY status")
def compaction_live_rows(spark, sf):
    return save(fold(_log(spark, sf), ["price", "status"]), "live").groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))


def _store(spark, dim: int = 64) -> Database:
    """A new database in the shared folder."""
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("a database needs a file system that is mounted")
    return Database.create(spark, f"{root.removeprefix('file://')}/store-{uuid4().hex}", dim)


@query("SELECT count(*) + 1 AS next_id, count(*) + 3 AS after_batch FROM region")
def next_id(spark, sf):
    """Ids are given once: deleted ones don't come back, and a batch gets those after the last."""
    db = _store(spark, 2)
    rows = table(spark, sf, "region").select("r_regionkey", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.to_json(F.struct("r_name")).alias("document"))
    _, n = db.insert_table(rows, [F.col("r_regionkey")])
    db.remove(n)
    first = db.insert_json([0.0, 1.0], {})
    batch = Database.open(spark, str(db.path)).insert_json_batch([([0.0, 0.0], {}), ([1.0, 1.0], {"a": None})])
    return spark.createDataFrame([(first, batch[1])], "next_id long, after_batch long")


@query(
    "WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS id, source, lang FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) SELECT id, CASE WHEN id = 2 THEN 'changed' ELSE source END AS source FROM r WHERE id <> 3"
)
def store_lifecycle(spark, sf):
    """Create, insert a table, update, delete, compact, open again, read."""
    db = _store(spark)
    db.insert_table(records(spark, sf), [F.col("id")])
    db.update_json(2, [0.0] * 64, {"source": "changed"})
    db.remove(3)
    db.optimize()
    return Database.open(spark, str(db.path)).records().select("id", F.get_json_object("document", "$.source").alias("source"))


@query("SELECT n AS what, CASE n WHEN 'count' THEN (SELECT count(*) FROM embeddings JOIN documents ON vec_id = doc_id) - 1 WHEN 'first' THEN (SELECT min(doc_id) + 1 FROM documents JOIN embeddings ON vec_id = doc_id) - (SELECT min(doc_id) FROM documents JOIN embeddings ON vec_id = doc_id) ELSE -1 END AS value FROM (VALUES ('count'), ('first'), ('deleted'), ('missing')) t(n)")
def store_ids(spark, sf):
    """Live ids: how many, the least, and those of a deleted and of an unknown id."""
    db = _store(spark)
    db.insert_table(records(spark, sf), [F.col("id")])
    db.remove(2)
    db.flush()
    ids = db.ids().agg(F.count("*").alias("n"), F.min("id").alias("least"), F.coalesce(F.max(F.when(F.col("id") == 2, 2)), F.lit(-1)).alias("gone")).first()
    unknown = -1 if db.get_record(10**9) is None and db.get_vector(2) is None and db.get_document(2) is None else 1
    return spark.createDataFrame([("count", ids["n"]), ("first", ids["least"]), ("deleted", ids["gone"]), ("missing", unknown)], "what string, value long")


@query(f"WITH {REC}, r AS (SELECT row_number() OVER (ORDER BY id) AS id, source, lang, v, text FROM rec) SELECT id, md5(text) AS digest, source, lang, v[1] AS first, v[64] AS last FROM r WHERE id IN (1, 5, 42)")
def get_record(spark, sf):
    """Point reads of vectors and documents by id."""
    db = _store(spark)
    db.insert_table(records(spark, sf), [F.col("id")])
    rows = [(i, *db.get_record(i)) for i in (1, 5, 42)]
    assert all(db.get_vector(i) == v and db.get_document(i) == d for i, v, d in rows)
    found = spark.createDataFrame([(i, d["text"], d["source"], d["type"], v[0], v[63]) for i, v, d in rows], "id long, text string, source string, lang string, first double, last double")
    return found.withColumn("digest", F.md5("text")).drop("text")


ROWED = REC.replace("rec AS (", "rec0 AS (").replace(", qq AS", ", rec AS (SELECT row_number() OVER (ORDER BY id) AS id, v, text, source, lang FROM rec0), qq AS")


@query(f"WITH {ROWED}, {_lex_only_sql({'text': 'text'})}")
def store_lexical_index(spark, sf):
    """A text search by the postings that optimizing has kept."""
    db = _store(spark)
    db.insert_table(records(spark, sf), [F.col("id")])
    db.optimize()
    hits = search_database(Database.open(spark, str(db.path)), SearchRequest([], 10, QUERY_TEXT))
    return _rounded(hits.select("rank", "id", "score", *(F.get_json_object("document", f"$.{k}").alias(k) for k in ("source", "text"))).withColumn("digest", F.md5("text")).drop("text"))


@query(f"WITH {ROWED}, d AS (SELECT id, source, text, 1 - ({COS}) AS score FROM rec, qq) SELECT id, source, md5(text) AS digest, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM d QUALIFY rank <= 10")
def store_vector_index(spark, sf):
    """A search for vectors only, by the cells that are kept with the version; with all of sixteen cells the result is exact."""
    db = _store(spark)
    db.insert_table(records(spark, sf), [F.col("id")])
    db.build_indexes(cells=16)
    db = Database.open_ann_only(spark, str(db.path))
    hits = search_database(db, SearchRequest(first_vector(spark, sf), 10, ef_search=1000), exact_rows=0)
    return hits.select("rank", "id", "score", *(F.get_json_object("document", f"$.{k}").alias(k) for k in ("source", "text"))).withColumn("digest", F.md5("text")).drop("text")


# Text pipeline

@query("SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE lang END AS tags_text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '\"' || source || '\"' END AS source FROM documents")
def extract_fields(spark, sf):
    """Text, title and tags from JSON documents, with those of the metadata where the document has none."""
    d = table(spark, sf, "documents")
    third, even = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    tags = F.when(even, F.to_json(F.array("lang", "source"))).otherwise(_quoted("lang"))
    meta = F.concat(F.lit('{"title":'), F.when(third, _quoted("lang")).otherwise(F.lit("7")), F.lit(',"tags":'), F.when(third, tags).otherwise(F.lit("[]")), F.lit("}"))
    top = F.when(third, F.lit('"title":null,')).otherwise(F.concat(F.lit('"title":'), _quoted("source"), F.lit(',"source":'), _quoted("source"), F.lit(',"tags":'), tags, F.lit(",")))
    made = F.concat(F.lit("{"), top, F.lit('"text":'), _quoted("text"), F.lit(',"metadata":'), meta, F.lit("}"))
    return d.select("doc_id", derive(made).alias("d")).select("doc_id", F.md5("d.text").alias("digest"), "d.title", "d.tags_text", F.col("d.payload")["source"].alias("source"))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1")
def jsonl_source(spark, sf):
    """Lines of JSON written and read back, without the blank texts."""
    from .sources.files import read_jsonl

    path = f"{shared_dir(spark)}/jsonl-{uuid4().hex}"
    table(spark, sf, "documents").select("text").write.json(path)
    return read_jsonl(spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('short vector', 'DimensionMismatch'), ('no vector', 'DimensionMismatch'), ('radius without vector', 'InvalidConfig'), ('text on vectors only', 'Internal'), ('no hits wanted', 'none')) t(what, error)")
def validation(spark, sf):
    """What a request is refused for, in the order of the checks."""
    r, out = documents(spark, sf).withColumn("embedding", F.array_repeat(F.lit(0.0), 64)), []
    cases = {
        "short vector": (SearchRequest([1.0], 1), {}), "no vector": (SearchRequest([], 1, "  "), {}), "radius without vector": (SearchRequest([], 1, "a", radius=1.0), {}),
        "text on vectors only": (SearchRequest([1.0], 1, "a"), {"ann_only": True}), "no hits wanted": (SearchRequest([1.0], 0), {}),
    }
    for what, (request, how) in cases.items():
        try:
            search(r, request, dim=64, **how)
            out.append((what, "none"))
        except EngineError as e:
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")


SPLIT_SQL = """WITH RECURSIVE s(doc_id, text, pos, idx, chunk) AS (
  SELECT doc_id, text, 0::BIGINT, -1::BIGINT, NULL::VARCHAR FROM documents
  UNION ALL
  SELECT doc_id, text, pos + CASE WHEN idx < 0 THEN 0 ELSE greatest(1, length(chunk) - {overlap}) END, idx + 1, NULL FROM (
    SELECT doc_id, text, pos, idx, {chunk} AS chunk FROM (SELECT *, substr(text, pos + 1, {size}) AS w FROM s)) c
  WHERE pos + CASE WHEN idx < 0 THEN 0 ELSE greatest(1, length(chunk) - {overlap}) END < length(text) {stop})
SELECT doc_id, idx AS chunk_idx, length(chunk) AS n_chars, md5(chunk) AS digest FROM (SELECT doc_id, text, pos, idx, {chunk} AS chunk FROM (SELECT *, substr(text, pos + 1, {size}) AS w FROM s)) WHERE idx >= 0"""
CUT = "CASE WHEN pos + {size} >= length(text) THEN w WHEN contains(w, chr(10) || chr(10)) THEN substr(w, 1, length(w) - instr(reverse(w), chr(10) || chr(10)) - 1) WHEN contains(w, '. ') THEN substr(w, 1, length(w) - instr(reverse(w), ' .')) ELSE w END"


def _chunks(docs: DataFrame, **how) -> DataFrame:
    c = docs.select("doc_id", F.posexplode(text.split(F.col("text"), **how)).alias("chunk_idx", "chunk"))
    return c.select("doc_id", F.col("chunk_idx").cast("long"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(SPLIT_SQL.format(size=512, overlap=64, chunk=CUT.format(size=512), stop=""))
def split_sentences(spark, sf):
    """Chunks at paragraph breaks and full stops, with all tails."""
    return _chunks(table(spark, sf, "documents"))


@query(SPLIT_SQL.format(size=512, overlap=64, chunk=CUT.format(size=512), stop="AND (idx < 0 OR pos + length(chunk) < length(text))"))
def split_stop(spark, sf):
    """The first chunk that reaches the end is the last."""
    return _chunks(table(spark, sf, "documents"), tail="stop")


CHUNKS_SQL = SPLIT_SQL.format(size=512, overlap=64, chunk=CUT.format(size=512), stop="AND (idx < 0 OR pos + length(chunk) < length(text))")
CHUNKS_SQL = CHUNKS_SQL.replace("SELECT doc_id, idx AS chunk_idx, length(chunk) AS n_chars, md5(chunk) AS digest", "SELECT doc_id, idx, chunk")


@query(f"""SELECT doc_id::VARCHAR AS doc_id, idx AS chunk_idx, md5('{{{{"chunk_idx":' || idx || ',"doc_id":"' || doc_id || '","embedding_model_id":"deterministic-v1","metadata":{{{{"doc_id":"' || doc_id || '","source":"' || source || '","tags":["' || lang || '"],"type":"document_chunk"}}}},"source":"' || source || '","tags":["' || lang || '"],"text":' || to_json(chunk)::VARCHAR || ',"type":"document_chunk"}}}}') AS digest
FROM ({CHUNKS_SQL}) JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)""".replace("{{", "{").replace("}}", "}"))
def chunk_metadata(spark, sf):
    """The JSON documents of all chunks."""
    from .plans.ingest import PipelineConfig, RagPipeline

    pipe = RagPipeline.__new__(RagPipeline)
    from .providers import DeterministicEmbedder

    pipe.embedder, pipe.config = DeterministicEmbedder(), PipelineConfig(tail="stop")
    docs = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("source", F.array("lang").alias("tags"))).alias("metadata"), "text")
    return pipe.chunk_table(docs).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("document").alias("digest"))


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, k, (('0x' || substr(h, 2 * k + 1, 2))::INTEGER - 127.5) / 127.5 AS x FROM h, LATERAL (SELECT unnest(range(length(h) // 2)) AS k)),
v AS (SELECT doc_id, k % 64 AS d, sum(x) AS x FROM b GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id)
SELECT d.doc_id, j.d::INTEGER AS d, round(coalesce(v.x / nullif(n.n, 0), 0)::FLOAT::DOUBLE, 5) + 0.0 AS x FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS d) j LEFT JOIN v ON v.doc_id = d.doc_id AND v.d = j.d LEFT JOIN n ON n.doc_id = d.doc_id""")
def deterministic_embed(spark, sf):
    """The numbers of all embeddings, to five digits."""
    e = table(spark, sf, "documents").select("doc_id", text.deterministic_embed(F.col("text"), 64).alias("e"))
    return e.select("doc_id", F.posexplode("e").alias("d", "x")).select("doc_id", "d", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


OVERLAP = f"""o AS (SELECT doc_id AS id, text, list_distinct({TOKENS.format("text")}) AS d, list_distinct({TOKENS.format("'" + OTHER_TEXT + "'")}) AS q FROM documents),
ov AS (SELECT id, CASE WHEN len(d) = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE * (len(list_intersect(q, d))::DOUBLE / len(q)) + 0.25::DOUBLE * (len(list_intersect(q, d))::DOUBLE / len(d)) + CASE WHEN contains(lower(text), lower('{OTHER_TEXT}')) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM o)"""


def _overlap(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), rerank.overlap_score(F.lit(OTHER_TEXT), F.col("text")).alias("score"))


@query(f"WITH {OVERLAP} SELECT id, round(score, 9) AS score FROM ov")
def overlap_rerank(spark, sf):
    return _overlap(spark, sf).select("id", F.round("score", 9).alias("score"))


@query(
    f"WITH {OVERLAP}, {VEC}, c AS (SELECT id, 1 - dist AS score, row_number() OVER (ORDER BY dist, id) AS old FROM (SELECT id, {COS} AS dist FROM e, q) QUALIFY old <= 100), m AS (SELECT c.id, old, c.score, ov.score AS new FROM c LEFT JOIN ov ON ov.id = c.id AND ov.score > 0.3) SELECT id, round(coalesce(new, score), 9) AS score, row_number() OVER (ORDER BY round(new, 9) DESC NULLS LAST, old)::INTEGER AS rank FROM m QUALIFY rank <= 20"
)
def rerank_merge(spark, sf):
    best = exact.topk(embeddings(spark, sf), first_vector(spark, sf), 100)
    c = exact.rank_within(best, None, "dist", "id", by=None).select(F.lit(0).alias("qid"), "rank", "id", (1 - F.col("dist")).alias("score"))
    new = _overlap(spark, sf).filter("score > 0.3").select(F.lit(0).alias("qid"), "id", F.round("score", 9).alias("score"))
    return rerank.merge(c, new, 20).select("id", F.round("score", 9).alias("score"), "rank")


@query("SELECT doc_id AS id, md5('title: ' || source || chr(10) || CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN 'text: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) ELSE '' END || 'tags: ' || lang || ', x') AS digest FROM documents")
def rerank_document(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5(rerank.rerank_document(F.col("source"), F.col("text"), F.array("lang", F.lit("x")), F.lit("{}"))).alias("digest"))


# Evaluation

HALF = "e2 AS (SELECT vec_id AS id, embedding[1:32]::DOUBLE[] AS v FROM embeddings), p2 AS (SELECT a.id AS qid, b.id, {} AS dist FROM e2 b, (SELECT id, v AS qv FROM e2) a), predicted AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM p2 QUALIFY rank <= 10)".format(COS)
QUALITY = f"""WITH {PAIRS.format(COS, "")}, exact AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM p QUALIFY rank <= 10), {HALF},
j AS (SELECT x.qid, x.rank AS er, y.rank AS pr FROM exact x LEFT JOIN predicted y ON y.qid = x.qid AND y.id = x.id)
SELECT qid, count(pr)::DOUBLE / count(*) AS recall, coalesce(1.0 / min(pr), 0.0)::DOUBLE AS mrr,
  round(coalesce(sum(1.0 / er / log2(pr + 1)), 0) / sum(1.0 / er / log2(er + 1)), 9) AS ndcg FROM j GROUP BY qid"""


def _predicted(spark, sf):
    e = embeddings(spark, sf)
    half = e.select("id", F.slice("embedding", 1, 32).alias("embedding"))
    return exact.batch_topk(half, half, 10, qid="id", query_vector="embedding"), exact.batch_topk(e, e, 10, qid="id", query_vector="embedding")


@query(QUALITY)
def recall_mrr_ndcg(spark, sf):
    """How well half of the dimensions find the neighbours."""
    predicted, truth = _predicted(spark, sf)
    return metrics.quality(predicted, truth).withColumn("ndcg", F.round("ndcg", 9))


@query(f"SELECT count(*) AS queries, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM ({QUALITY})")
def quality_summary(spark, sf):
    predicted, truth = _predicted(spark, sf)
    s = metrics.summary(metrics.quality(predicted, truth).withColumn("ndcg", F.round("ndcg", 9)))
    return s.select("queries", *(F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")))


@query(f"SELECT qid, id, dist, rank FROM ({BATCH}) WHERE id >= 0 AND id < 400")
def ground_truth_restricted(spark, sf):
    return metrics.ground_truth(batch_topk_cosine(spark, sf), 400)


@query("SELECT event_type, count(*) AS ops, round(sum(value), 6) AS sum_ms, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 9) AS mean_ms, round(count(*) * 1000.0 / sum(value), 6) AS ops_per_sec FROM events GROUP BY event_type")
def latency_stats(spark, sf):
    s = metrics.latency_stats(table(spark, sf, "events"), "value", "event_type")
    return s.select("event_type", "ops", F.round("sum_ms", 6).alias("sum_ms"), "p50", "p95", "p99", "min_ms", "max_ms", F.round("mean_ms", 9).alias("mean_ms"), F.round("ops_per_sec", 6).alias("ops_per_sec"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.3) AS p30, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def nearest_rank(spark, sf):
    return metrics.nearest_ranks(table(spark, sf, "lineitem"), "l_extendedprice", (30, 50, 95), "l_returnflag")


@query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_occurrence(spark, sf):
    return metrics.first_rows(table(spark, sf, "events"), F.col("user_id"), id="event_id").select("event_id", "user_id", "value")


@query(
    f"SELECT vec_id AS id, len(v)::INTEGER AS dimension, round(sqrt(list_dot_product(v, v)), 9) AS l2_norm, round({SUM.format('v')} / len(v), 9) AS mean, round({SUM.format('list_transform(v, lambda x: abs(x))')} / len(v), 9) AS mean_abs, list_min(v) AS min, list_max(v) AS max, 'likely L2-normalized dense vector' AS style FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
)
def embedding_profile(spark, sf):
    p = embeddings(spark, sf).select("id", V.profile(F.col("embedding")).alias("p")).select("id", "p.*")
    return p.withColumns({c: F.round(c, 9) for c in ("l2_norm", "mean", "mean_abs")})


# Approximate search and graphs

CENT = (
    "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, v AS qv FROM (SELECT label, arg_min(v, id) AS v FROM e GROUP BY label)), "
    f"a AS (SELECT id, v, cell FROM (SELECT id, v, cell, row_number() OVER (PARTITION BY id ORDER BY {L2}, cell) AS n FROM e, c) WHERE n = 1)"
)


def _centroids(spark, sf):
    """The first vector of each label."""
    import numpy as np

    rows = embeddings(spark, sf).groupBy("label").agg(F.min_by("embedding", "id").alias("v")).orderBy("label").collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


@query(f"WITH {CENT} SELECT id, cell::INTEGER AS cell FROM a")
def ivf_assign(spark, sf):
    return ivf.assign(embeddings(spark, sf), _centroids(spark, sf)).select("id", "cell")


@query(
    f"WITH {CENT}, pr AS (SELECT qid, cell FROM (SELECT x.id AS qid, c.cell, row_number() OVER (PARTITION BY x.id ORDER BY {L2.replace('qv', 'c.qv').replace('list_zip(v', 'list_zip(x.v')}, c.cell) AS n FROM e x, c) WHERE n <= 4), "
    f"s AS (SELECT qid, b.id, {COS.replace('qv', 'b.qv')} AS dist FROM (SELECT a.id, a.v, pr.qid, y.v AS qv FROM a JOIN pr USING (cell) JOIN e y ON y.id = pr.qid) b) SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rank FROM s QUALIFY rank <= 10"
)
def ivf_search(spark, sf):
    """Four cells of ten for each of all vectors."""
    c, e = _centroids(spark, sf), embeddings(spark, sf)
    return ivf.batch_search(ivf.assign(e, c), e.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), 10, c, 4)


@query(
    f"WITH {CENT}, near AS (SELECT c.cell FROM c, q2 ORDER BY {L2.replace('list_zip(v, qv)', 'list_zip(q2.qv, c.qv)')}, c.cell LIMIT 4), s AS (SELECT a.id + 1 AS id, d.source, d.text, 1 - ({COS.replace('qv', 'q2.qv').replace('(v', '(a.v')}) AS score FROM a JOIN near USING (cell) JOIN documents d ON d.doc_id = a.id, q2 WHERE d.source = 'src3') SELECT id, source, md5(text) AS digest, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10".replace("WITH ", "WITH q2 AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1), ", 1)
)
def search_ann_filtered(spark, sf):
    """A filtered search in the four nearest of ten cells."""
    c = _centroids(spark, sf)
    r = records(spark, sf)
    near = nearest_in_cells(ivf.assign(r, c), c, 4, filtered=True)
    return _hits(spark, sf, SearchRequest(first_vector(spark, sf), 10, filter=Eq("source", "src3")), r, nearest=near)


@query()
def ivf_trained_recall(spark, sf):
    """Recall of trained cells, eight of sixteen probed."""
    e = embeddings(spark, sf)
    c = ivf.train(e, 16)
    q = e.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    found = ivf.batch_search(e.join(ivf.assign_fast(e, c), "id"), q, 10, c, 8)
    return metrics.summary(metrics.quality(found, exact.batch_topk(e, q, 10)))


KNN = f"WITH {PAIRS.format(COS, ' WHERE a.id <> b.id')}, knn AS (SELECT qid AS src, id AS dst, dist FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= {{}})"


@query(KNN.format(10) + " SELECT src, dst, dist FROM knn")
def knn_graph(spark, sf):
    return graph.knn_edges(embeddings(spark, sf), 10).drop("layer")


def _knn(spark, sf, k: int = 10) -> DataFrame:
    return save(graph.knn_edges(embeddings(spark, sf), k), "knn")


def _diverse_sql(edges: str, most: int) -> str:
    """CTEs up to ``kept`` (src, dst, dist): of the edges of each source, nearest first, those that are nearer to no chosen one than to the source."""
    apart = "1 - list_dot_product(x[1].v, y.v) / (sqrt(list_dot_product(x[1].v, x[1].v)) * sqrt(list_dot_product(y.v, y.v)))"
    return (
        f"lists AS (SELECT src, list([{{'dst': dst, 'dist': dist, 'v': e.v}}] ORDER BY dist, dst) AS c FROM {edges} JOIN e ON e.id = dst GROUP BY src), "
        f"chosen AS (SELECT src, list_reduce(c, lambda acc, x: CASE WHEN len(acc) < {most} AND len(list_filter(acc, lambda y: {apart} < x[1].dist)) = 0 THEN list_concat(acc, x) ELSE acc END) AS c FROM lists), "
        "kept AS (SELECT src, k.dst AS dst, k.dist AS dist FROM (SELECT src, unnest(c) AS k FROM chosen))"
    )


@query(KNN.format(10) + ", " + _diverse_sql("knn", 4) + " SELECT 0 AS layer, src, dst, dist FROM kept")
def select_edges(spark, sf):
    """The diverse ones of ten neighbours, four at most."""
    return graph.select_edges(_knn(spark, sf), embeddings(spark, sf), 4)


BOTH = ", both_ways AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM knn UNION ALL SELECT dst, src, dist FROM knn) GROUP BY src, dst)"


@query(
    KNN.format(10) + BOTH + ", many AS (SELECT src, dst, dist FROM both_ways WHERE src IN (SELECT src FROM both_ways GROUP BY src HAVING count(*) > 12)), "
    + _diverse_sql("many", 12) + " SELECT 0 AS layer, src, dst, dist FROM kept UNION ALL SELECT 0, src, dst, dist FROM both_ways WHERE src NOT IN (SELECT src FROM many)"
)
def prune_degree(spark, sf):
    return graph.prune(graph.bidirectional(_knn(spark, sf)), embeddings(spark, sf), 12)


@query(KNN.format(10) + " SELECT dst, dist FROM knn WHERE src = (SELECT min(id) + 5 FROM e)")
def graph_neighbors(spark, sf):
    edges = _knn(spark, sf)
    return graph.neighbors(edges, embeddings(spark, sf).agg(F.min("id")).first()[0] + 5)


COMPONENTS = ", g AS (SELECT src AS a, dst AS b FROM knn UNION SELECT dst, src FROM knn), reach(id, node) AS (SELECT id, id FROM e UNION SELECT r.id, g.b FROM reach r JOIN g ON g.a = r.node) SELECT id, min(node) AS component FROM reach GROUP BY id"


@query(KNN.format(1).replace("WITH ", "WITH RECURSIVE ", 1) + COMPONENTS)
def graph_components(spark, sf):
    return graph.components(_knn(spark, sf, 1), embeddings(spark, sf))


@query(KNN.format(10) + " SELECT src, dst, dist FROM knn WHERE src NOT IN (SELECT id FROM e WHERE label = 3) AND dst NOT IN (SELECT id FROM e WHERE label = 3)")
def graph_remove(spark, sf):
    return graph.remove(_knn(spark, sf), embeddings(spark, sf).filter("label = 3")).drop("layer")


@query(f"WITH h AS (SELECT vec_id AS id, {graph.hash_sql('vec_id')} AS h FROM embeddings) SELECT id, least(floor(-ln((h + 1) / {graph.HASH_SIZE}.0::DOUBLE) * {1 / math.log(16)!r}::DOUBLE), 255)::INTEGER AS level FROM h")
def graph_levels(spark, sf):
    return graph.levels(embeddings(spark, sf))


@query()
def beam_search(spark, sf):
    """Recall of a graph search for every vector, with a beam of 200."""
    e = embeddings(spark, sf)
    edges = save(graph.bidirectional(_knn(spark, sf, 16)), "graph")
    q = e.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    found = graph.beam_search(edges, e, q, e.agg(F.min("id")).first()[0], 10, 200, expand=32)
    return metrics.summary(metrics.quality(found, exact.batch_topk(e, q, 10)))


@query()
def vp_seeds(spark, sf):
    e = embeddings(spark, sf)
    return vptree.search_seeds(vptree.build(e), e.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), 5)
