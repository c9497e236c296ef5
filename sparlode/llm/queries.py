"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .knn import knn_join
from .langid import identify
from .mixing import LEAST_KEPT, mix
from .quality import quality_filter
from .secret_scan import secret_scan
from .sharding import shard_rows
from .sharding import sql as shard_sql
from .simhash import near_duplicates
from .toxicity import toxic_documents
from .warc import deduplicate_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest others, among all embeddings, of those whose id is divisible by 100; distances to six digits."""
    data = table(spark, sf_dir, "embeddings")
    found = knn_join(spark, data.filter("vec_id % 100 = 0"), data, k=10, exclude_self=True)
    return found.withColumn("distance", F.round("distance", 6))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are found toxic, with their probability."""
    return toxic_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives the text back."""
    return bpe_encode(spark, table(spark, sf_dir, "documents"), keep=["doc_id"], check="round_trip")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark, table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced sample of documents: (doc_id, source, n_tokens)."""
    return mix(spark, table(spark, sf_dir, "documents"), columns=["doc_id", "source"], count="n_tokens", least=LEAST_KEPT)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id) for each document that near-dedup removes."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of the deduplicated archives of all pages."""
    return deduplicate_pages(spark, table(spark, sf_dir, "pages")).select("uri", "date", "kind", "payload_digest", "payload_length", "refers_to_uri", "refers_to_date")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return shard_rows(spark, table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in all documents."""
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, whole."""
    return quality_filter(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_knn, op2_toxicity, op3_bpe, op4_language, op5_mixing, op6_simhash, op7_warc, op8_sharding, op9_secrets, op10_quality)
}
KNN_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(d, 6) AS distance FROM ranked WHERE rank <= 10"""
WARC_SQL = """
WITH p AS (
  SELECT page_id, url, html, strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS date,
    min(page_id) OVER (PARTITION BY html) AS first_id FROM pages)
SELECT p.url AS uri, p.date, CASE WHEN p.page_id = p.first_id THEN 'response' ELSE 'revisit' END AS kind,
  'sha256:' || sha256(p.html) AS payload_digest, CASE WHEN p.page_id = p.first_id THEN octet_length(encode(p.html)) END::BIGINT AS payload_length,
  CASE WHEN p.page_id <> p.first_id THEN o.url END AS refers_to_uri, CASE WHEN p.page_id <> p.first_id THEN o.date END AS refers_to_date
FROM p JOIN p o ON o.page_id = p.first_id"""
ORACLE_SQL = {"op1_knn": KNN_SQL, "op7_warc": WARC_SQL, "op8_sharding": shard_sql()}
