"""Vector, filtered, hybrid and lexical search as one lazy plan.

filter -> distances -> pool of the nearest -+
                                            +-> min-max of each pool -> full outer join -> radius -> fused score -> top k -> documents
filter -> BM25F (all documents' statistics) -+
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, Internal, InvalidConfig
from ..functions import vector as V
from ..operators import exact, hybrid, ivf, lexical
from ..operators import filters as filters_
from ..operators.filters import And, Eq

#: Candidates for each wanted hit, where a later step drops or reorders some.
OVERFETCH = 20
#: Up to so many hits are broadcast to fetch their documents.
BROADCAST_HITS = 1_000_000
#: Up to so many candidates are scanned exactly, even where there is an index.
EXACT_ROWS = 50_000
FIELDS = {"text": "text", "title": "title", "tags": "tags_text"}
HITS = "rank int, id long, score double, document string"


@dataclass
class SearchRequest:
    vector: Sequence[float] = field(default_factory=list)
    top_k: int = 10
    text_query: str | None = None
    hybrid_alpha: float | None = None
    lexical_top_k: int | None = None
    filter: Eq | And | None = None
    ef_search: int | None = None
    radius: float | None = None

    @property
    def text(self) -> str | None:
        """The query's text; blank is none."""
        t = (self.text_query or "").strip()
        return t or None

    @property
    def lexical_only(self) -> bool:
        return len(self.vector) == 0 and self.text is not None

    def check(self, dim: int, ann_only: bool = False) -> None:
        if ann_only and (self.text is not None or self.filter is not None):
            raise Internal("a database that is open for vector search only has no text or filter queries")
        if not self.lexical_only and len(self.vector) != dim:
            raise DimensionMismatch(dim, len(self.vector))
        if self.lexical_only and self.radius is not None:
            raise InvalidConfig("a radius needs a vector")

    def pools(self, pool: str = "exact", ef: int = 50, indexed_filter: bool = False) -> tuple[int, int]:
        """(nearest, lexical) sizes of the candidate pools. Sizes of the table or of the filtered rows bound them by themselves."""
        if self.lexical_only:
            k = max(self.top_k if self.lexical_top_k is None else self.lexical_top_k, self.top_k)
            return 0, k
        broad = self.text is not None or self.filter is not None or self.radius is not None
        k = OVERFETCH * self.top_k if broad else self.top_k
        near = min(k, ef if self.ef_search is None else self.ef_search) if pool == "reference" and not indexed_filter else k
        return near, max(k if self.lexical_top_k is None else self.lexical_top_k, self.top_k)


def _empty(records: DataFrame) -> DataFrame:
    return records.sparkSession.createDataFrame([], HITS)


def search(
    records: DataFrame, request: SearchRequest, *, dim: int, metric: str = "cosine", ann_only: bool = False, pool: str = "exact",
    default_ef: int = 50, fields: dict[str, str] = FIELDS, lexical_tables: tuple[DataFrame, DataFrame] | None = None,
    nearest: Callable[[DataFrame, Sequence[float], int], DataFrame] | None = None,
) -> DataFrame:
    """(rank, id, score, document), best first. records: (id, embedding, document, payload, and the columns of ``fields``).

    pool="exact" filters before it scores; pool="reference" cuts the pool to ef without an indexed filter and applies the parts of
    a filter that aren't indexed after the cut, so it may find fewer. ``lexical_tables``: (postings, lengths) that are kept.
    ``nearest`` (records, vector, k) -> (id, dist) takes the place of the exact scan, as an approximate one.
    """
    if request.top_k == 0:
        return _empty(records)
    request.check(dim, ann_only)
    plan = filters_.plan(request.filter)
    early = plan.condition if pool == "exact" else (plan.native if plan.native is not None else F.lit(True))
    live = records if request.filter is None else records.filter(early)
    n_near, n_lex = request.pools(pool, default_ef, plan.native is not None)
    near = lex = None
    if not request.lexical_only:
        find = nearest or (lambda r, v, k: exact.topk(r, v, k, metric))
        near = find(live, request.vector, n_near).select(F.lit(0).cast("long").alias("qid"), "id", "dist")
        near = near.withColumn("score", V.score(metric, F.col("dist")))
    if request.text is not None:
        if lexical_tables is None:
            scored = lexical.search_scores(records, fields, request.text, allowed=early if request.filter is not None else None)
        else:
            post, doc_len = lexical_tables
            terms = lexical.literal_terms(records.sparkSession, request.text)
            post = post.filter(F.col("term").isin(sorted(set(lexical.tokens_of(request.text)))))  # reaches the scan
            scored = lexical.scores(post, doc_len, terms, allowed=live if request.filter is not None else None)
        lex = lexical.topk(scored, n_lex)
    if lex is None:
        hits = near
    elif near is None:
        hits = hybrid.minmax_pool(lex).select("qid", "id", F.lit(None).cast("double").alias("dist"), F.col("norm").alias("score"))
    else:
        both = hybrid.union_pools(near, lex)
        hits = both.select("qid", "id", "dist", hybrid.fused(hybrid.clamp_alpha(request.hybrid_alpha)).alias("score"))
    if request.radius is not None:
        hits = hits.filter(F.col("dist") <= request.radius)
    if pool != "exact" and plan.residual is not None:
        hits = hits.join(records.filter(plan.residual).select("id"), "id", "left_semi")
    best = hits.select("id", "score").orderBy(F.desc("score"), "id").limit(request.top_k)
    ranked = exact.rank_within(best, None, F.desc("score"), "id", by=None)  # at most top_k rows
    ranked = F.broadcast(ranked) if request.top_k <= BROADCAST_HITS else ranked
    return records.select("id", "document").join(ranked, "id").select("rank", "id", "score", "document").orderBy("rank")


def search_batch(
    records: DataFrame, queries: DataFrame, top_k: int, *, metric: str = "cosine", alpha: float | None = None, lexical_top_k: int | None = None,
    filter: Eq | And | None = None, radius: float | None = None, fields: dict[str, str] = FIELDS, lexical_tables: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(qid, rank, id, score) for a table of queries (qid, and vector, text or both): the plan of ``search`` for all at once."""
    has_vector, has_text = "vector" in queries.columns, "text" in queries.columns
    if not has_vector and not has_text:
        raise InvalidConfig("queries need a column vector or text")
    if radius is not None and not has_vector:
        raise InvalidConfig("a radius needs a vector")
    live = records if filter is None else records.filter(filters_.plan(filter).condition)
    broad = has_text or filter is not None or radius is not None
    k = OVERFETCH * top_k if broad and has_vector else top_k
    near = lex = None
    if has_vector:
        near = exact.batch_topk(live, queries, k, metric).withColumn("score", V.score(metric, F.col("dist")))
    if has_text:
        post, doc_len = lexical_tables or (lexical.postings(records, fields), lexical.lengths(records, fields))
        lex = lexical.search_table(post, doc_len, queries, max(k if lexical_top_k is None else lexical_top_k, top_k), allowed=live if filter is not None else None)
    if lex is None:
        hits = near
    elif near is None:
        hits = hybrid.minmax_pool(lex).select("qid", "id", F.lit(None).cast("double").alias("dist"), F.col("norm").alias("score"))
    else:
        hits = hybrid.union_pools(near, lex).select("qid", "id", "dist", hybrid.fused(hybrid.clamp_alpha(alpha)).alias("score"))
    if radius is not None:
        hits = hits.filter(F.col("dist") <= radius)
    return exact.rank_within(hits, top_k, F.desc("score"), "id").select("qid", "rank", "id", "score")


def with_documents(hits: DataFrame, records: DataFrame) -> DataFrame:
    """The hits' documents, fetched last: only the rows that are left are joined."""
    return hits.join(records.select("id", "document"), "id")


def search_database(db, request: SearchRequest, *, exact_rows: int = EXACT_ROWS, **how) -> DataFrame:
    """The same over the newest version of a database, with the indexes that its last ``optimize`` has kept, if they are of this version.

    Of more than ``exact_rows`` candidates (live rows, or those that pass the filter) the cells that are nearest to the query are
    searched, as many as hold ``ef_search`` times a tenth of a percent of all; of fewer, all are. A radius is always exact.
    """
    records = db.records()
    if "lexical_tables" not in how and request.text is not None:
        how["lexical_tables"] = db.postings()
    if "nearest" not in how and not request.lexical_only and request.radius is None and db.count() > exact_rows:
        cells = db.cells()
        if cells is not None and (request.filter is None or _more(records, request, exact_rows)):
            centroids, assigned = cells
            ef = request.ef_search or db.config.index.ef_search
            how["nearest"] = nearest_in_cells(assigned, centroids, max(1, math.ceil(len(centroids) * min(1.0, ef / 1000))), db.metric, request.filter is not None)
    return search(records, request, dim=db.dim, metric=db.metric, ann_only=db.ann_only, default_ef=db.config.index.ef_search, **how)


def _more(records: DataFrame, request: SearchRequest, n: int) -> bool:
    return records.filter(filters_.plan(request.filter).condition).select("id").limit(n + 1).count() > n


def nearest_in_cells(assigned: DataFrame, centroids, nprobe: int, metric: str = "cosine", filtered: bool = False) -> Callable:
    """For ``nearest`` of ``search``: the k nearest of the records in the ``nprobe`` cells that are nearest to the query."""

    def find(live: DataFrame, vector: Sequence[float], k: int) -> DataFrame:
        near = assigned.filter(F.col("cell").isin(ivf.probes(vector, centroids, nprobe)))
        near = near.join(live.select("id"), "id", "left_semi") if filtered else near
        return exact.topk(near, vector, k, metric)

    return find
