"""Fielded BM25 (BM25F) over text, title and tags."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MOST_TF, tokens, tokens_of
from ..storage_util import save
from .exact import rank_within

FIELDS = {"text": 1.0, "title": 1.6, "tags": 1.3}
B, K1 = 0.75, 1.2
#: Hits of a table of queries are broadcast up to this number.
_BEST = 200_000


def postings(records: DataFrame, fields: dict[str, str], id: str = "id") -> DataFrame:
    """(term, id, tf_text, tf_title, tf_tags). fields: of FIELDS to columns. Frequencies stop at 65,535."""
    cut = records.select(F.col(id).alias("id"), *(tokens(F.col(c)).alias(f"t_{f}") for f, c in fields.items()))
    tf = dict.fromkeys(FIELDS, F.lit(0).cast("long"))
    if len(fields) == 1:
        (f,) = fields
        long, tf[f] = cut.select("id", F.explode(f"t_{f}").alias("term")), F.count("*")
    else:
        # A token's place in the row of all tells its field: no function is called for each token.
        ends = [reduce(lambda a, b: a + b, (F.size(f"t_{g}") for g in list(fields)[: n + 1])) for n in range(len(fields))]
        long = cut.select("id", *(e.alias(f"end_{f}") for f, e in zip(fields, ends, strict=True)), F.posexplode(F.concat(*(f"t_{f}" for f in fields))).alias("at", "term"))
        for before, f in zip([None, *fields], fields, strict=False):
            here = F.col("at") < F.col(f"end_{f}")
            tf[f] = F.sum((here if before is None else here & (F.col("at") >= F.col(f"end_{before}"))).cast("long"))
    return long.groupBy("term", "id").agg(*(F.least(n, F.lit(MOST_TF)).alias(f"tf_{f}") for f, n in tf.items()))


def _tagged(field: str):
    return lambda t: F.struct(t.alias("term"), F.lit(field).alias("field"))


def lengths(records: DataFrame, fields: dict[str, str], id: str = "id") -> DataFrame:
    """(id, len_text, len_title, len_tags)"""
    return records.select(F.col(id).alias("id"), *((F.size(tokens(F.col(fields[f]))).cast("long") if f in fields else F.lit(0).cast("long")).alias(f"len_{f}") for f in FIELDS))


def statistics(doc_len: DataFrame) -> DataFrame:
    """One row: n and the total lengths, over all documents, empty ones included."""
    return doc_len.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"len_{f}"), F.lit(0)).alias(f"total_{f}") for f in FIELDS))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def field_tf(weights: dict[str, float] = FIELDS, b: float = B) -> Column:
    """The weighted frequencies of a term, each normalised by its field's length."""
    total = F.lit(0.0)
    for f, w in weights.items():
        average = F.greatest(F.col(f"total_{f}") / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-6))
        scale = F.greatest((1.0 - b) + b * (F.col(f"len_{f}") / average), F.lit(1e-6))
        total = total + F.when(F.col(f"tf_{f}") > 0, w * (F.col(f"tf_{f}") / scale)).otherwise(0.0)
    return total


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, term, qtf)"""
    return queries.select(F.col(qid).alias("qid"), F.explode(tokens(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _folded(x: DataFrame, tf: Column, k1: float) -> DataFrame:
    """(qid, id, score) of rows (qid, id, term, df, n, qtf and what field_tf needs); a document's terms are added in their order."""
    part = idf(F.col("n"), F.col("df")) * ((tf * (k1 + 1.0)) / (tf + k1)) * F.col("qtf")
    x = x.select("qid", "id", "term", part.alias("s"))
    folded = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("term", "s"))), lambda t: t["s"]), F.lit(0.0), lambda a, s: a + s)
    return x.groupBy("qid", "id").agg(folded.alias("score"))


def scores(post: DataFrame, doc_len: DataFrame, terms: DataFrame, *, stats: DataFrame | None = None, allowed: DataFrame | None = None, k1: float = K1) -> DataFrame:
    """(qid, id, score) of every document that has a term of the query, from kept postings and lengths.

    df, n and the average lengths are those of all documents; ``allowed`` (id) only restricts the scored ones. Postings of
    other terms are dropped before the shuffle; a document's terms are added in their order, so sums are reproducible. Up to
    100,000 terms of the queries, and their frequencies, are broadcast.
    """
    stats = statistics(doc_len) if stats is None else stats
    few = F.broadcast if _few(terms) else lambda x: x
    mine = post.join(few(terms.select("term").distinct()), "term", "left_semi")
    df = document_frequencies(mine)
    x = mine if allowed is None else mine.join(allowed.select("id"), "id", "left_semi")
    x = x.join(few(df), "term").join(few(terms), "term").join(doc_len, "id").crossJoin(F.broadcast(stats))  # one row
    return _folded(x, field_tf(), k1)


def search_table(post: DataFrame, doc_len: DataFrame, queries: DataFrame, k: int, *, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, score): the k best for each query (qid, text). Queries of the same terms are scored once, however many they are, and each
    gets their k rows."""
    words = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term"))  # a token has no space
    bag = words.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("bag"))
    bag = save(bag.withColumn("bag_id", F.xxhash64("bag")), "query-bags")
    bags = bag.select("bag_id", "bag").distinct()
    if bags.groupBy("bag_id").count().filter("count > 1").limit(1).count():  # two of one hash: each query for itself
        bag = bag.withColumn("bag_id", F.col("qid"))
        bags = bag.select("bag_id", "bag")
    terms = bags.select(F.col("bag_id").alias("qid"), F.explode(F.split("bag", " ")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    best = save(topk(scores(post, doc_len, terms, allowed=allowed), k).withColumnRenamed("qid", "bag_id"), "bag-hits")
    best = F.broadcast(best) if best.limit(_BEST + 1).count() <= _BEST else best
    return bag.select("qid", "bag_id").join(best, "bag_id").select("qid", "rank", "id", "score")


def search_scores(records: DataFrame, fields: dict[str, str], query: str, *, allowed: Column | None = None, id: str = "id", k1: float = K1) -> DataFrame:
    """(qid, id, score) for the text of one query, without postings: 0 is its qid.

    Texts are read and cut into tokens once, when this is called: of each document its id, its lengths and those of its tokens that the
    query has are written to the shared folder. Statistics, document frequencies and scores are then taken from that narrow table.
    """
    wanted = dict(Counter(tokens_of(query)))
    spark = records.sparkSession
    cut = records.select(F.col(id).alias("id"), (F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))).alias("ok"), *(tokens(F.col(c)).alias(f"t_{f}") for f, c in fields.items()))
    known = sorted(wanted)
    hits = F.concat(*(F.transform(F.filter(F.col(f"t_{f}"), lambda t: t.isin(known)), _tagged(f)) for f in fields))
    base = cut.select("id", "ok", *((F.size(f"t_{f}").cast("long") if f in fields else F.lit(0).cast("long")).alias(f"len_{f}") for f in FIELDS), hits.alias("hits"))
    base = save(base, "query-hits")
    stats = statistics(base)
    df = base.select("id", F.explode(F.array_distinct(F.transform("hits", lambda t: t["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = F.broadcast(df.join(literal_terms(spark, query), "term"))  # at most the query's terms
    lens = [f"len_{f}" for f in FIELDS]
    mine = base.filter("ok").select("id", *lens, F.explode("hits").alias("t")).select("id", *lens, "t.term", "t.field")
    tf = [F.least(F.sum((F.col("field") == f).cast("long")), F.lit(MOST_TF)).alias(f"tf_{f}") for f in FIELDS]
    x = mine.groupBy("id", "term").agg(*(F.first(c).alias(c) for c in lens), *tf)
    return _folded(x.join(df, "term").crossJoin(F.broadcast(stats)), field_tf(), k1)


def _few(terms: DataFrame, most: int = 100_000) -> bool:
    return terms.select("term").distinct().limit(most + 1).count() <= most


def literal_terms(spark, text: str, qid: int = 0) -> DataFrame:
    """The terms of one query."""
    return spark.createDataFrame([(qid, t, n) for t, n in sorted(Counter(tokens_of(text)).items())], "qid long, term string, qtf long")


def topk(scored: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score), ties by id."""
    return rank_within(scored, k, F.desc("score"), "id").select("qid", "rank", "id", "score")
