"""The second stage: documents for a reranker, the token-overlap reranker, and merging its results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import canonical, extract_tags, extract_text, extract_title
from ..functions.text import tokens_of, unique_terms


def overlap_score(query: Column, document: Column) -> Column:
    """0.75 x share of the query's terms that the document has + 0.25 x share of the document's terms + 0.2 if the document contains the query; 0 without terms in the document."""
    q, d = unique_terms(query), unique_terms(document)
    both = F.size(F.array_intersect(q, d)).cast("double")
    phrase = F.when(F.contains(F.lower(document), F.lower(query)), F.lit(0.2)).otherwise(0.0)
    return F.when((F.size(d) == 0) | (F.size(q) == 0), F.lit(0.0)).otherwise(F.lit(0.75) * (both / F.size(q)) + F.lit(0.25) * (both / F.size(d)) + phrase)


def overlap_score_of(query: str, document: str) -> float:
    q, d = set(tokens_of(query)), set(tokens_of(document))
    if not q or not d:
        return 0.0
    both = len(q & d)
    return 0.75 * (both / len(q)) + 0.25 * (both / len(d)) + (0.2 if query.lower() in document.lower() else 0.0)


def document_of(document: Any) -> str:
    """Lines of title, text and tags, or the whole JSON if there are none."""
    title, text, tags = (extract_title(document) or "").strip(), extract_text(document).strip(), extract_tags(document)
    parts = [f"title: {title}"] * bool(title) + [f"text: {text}"] * bool(text) + [f"tags: {', '.join(tags)}"] * bool(tags)
    return "\n".join(parts) if parts else json.dumps(json.loads(canonical(document)), ensure_ascii=False, separators=(",", ":"))


def rerank_document(title: Column, text: Column, tags: Column, document: Column) -> Column:
    """The same from columns (tags: an array). Only white space at the ends is trimmed."""
    t, x = F.regexp_replace(title, r"^\s+|\s+$", ""), F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.concat_ws("\n", F.when(t != "", F.concat(F.lit("title: "), t)), F.when(x != "", F.concat(F.lit("text: "), x)), F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", "))))
    return F.when(parts != "", parts).otherwise(document)


def merge(candidates: DataFrame, reranked: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score): reranked ids first with the reranker's score, by that score and their old rank; then the others as they were.

    candidates: (qid, rank, id, score); reranked: (qid, id, score), of which the best row of an id counts.
    """
    from .exact import rank_within

    best = reranked.groupBy("qid", "id").agg(F.max("score").alias("new"))
    x = candidates.join(best, ["qid", "id"], "left").withColumnRenamed("rank", "old")
    out = rank_within(x, k, F.col("new").desc_nulls_last(), F.col("old"))
    return out.select("qid", "rank", "id", F.coalesce("new", "score").alias("score"))
