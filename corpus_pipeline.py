"""From raw documents to a tokenized training mix: quality rules, near-dedup, secret scans, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparlode.llm.bpe import bpe_encode
from sparlode.llm.common import drop_path, save
from sparlode.llm.mixing import LEAST_KEPT, mix
from sparlode.llm.quality import quality_filter
from sparlode.llm.secret_scan import redact_secrets
from sparlode.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Outliers of their language and source go.

    Null language or source: a group of its own. Null or empty texts, and groups of under 50 documents in all: kept. Ties at the cutoff
    are kept, repeated rows are judged alike, long texts count whole, an empty table stays empty, extra columns pass through.
    """
    return quality_filter(spark, docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays.

    Rows without id or text stay. Of rows equal in id and text one stays. Long texts count whole, an empty table stays empty, extra
    columns pass through.
    """
    return drop_near_duplicates(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the identifiers linked to them are put out of the texts; every document stays.

    Null and empty texts stay as they are; ``n_chars``, if there, is counted anew. Of two identifiers at one distance the left one is
    linked. Repeated rows are treated alike, texts of any length are scanned whole, extra columns pass through.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample whose tokens follow the sources' target weights.

    Null source: a source of its own. Null or empty text: a document without tokens. Repeated rows are documents of their own. The sample
    depends on the rows alone. An empty table stays empty, extra columns pass through.
    """
    return mix(spark, docs, least=LEAST_KEPT)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The exact BPE ids of each text, and whether they decode to it; the text itself is dropped.

    Null text: null ids. Empty text: no ids. Texts of any length are encoded whole, repeated rows each. If there are columns ``ids`` or
    ``round_trip`` already, the new ones have underscores at their end.
    """
    keep = [c for c in docs.columns if c != "text"]
    return bpe_encode(spark, docs, keep=keep, check="round_trip")


STAGES = [("quality rules", quality), ("near-dedup", dedup), ("secret scans", secrets), ("mixing", mixing), ("bpe", tokenize)]

#: Outlier estimates, fingerprints, sampling and BPE are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and reread.

    Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns: as each stage says.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = save(spark, stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before:
            drop_path(spark, before)
        before = path
    return docs
