"""Retrieval: BM25, lexical and dense ranks, reciprocal rank fusion, top-k.

Ranks of a short list are taken after a top-k cut (``orderBy().limit(k)``, which keeps k rows per task),
ranks of a whole list within ranges of its order, so no task ever holds a whole table in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text

K1, B = 1.2, 0.75
RRF_K = 60
#: Shares of the blended score.  Fixed values.
LEXICAL_SHARE, COSINE_SHARE = 0.35, 0.65


def bm25(docs: DataFrame, key: str, tokens: Column, query: Sequence[str], checkpoint=None) -> DataFrame:
    """(key, score) of the documents with a score above 0.  Statistics are over the given documents.

    One pass counts the query's terms in each document, so what is shuffled is one row of sums for each
    task: document frequencies come from the same counts, not from an explosion of all tokens.  With
    checkpoint(df) the counts are written once, and statistics and scores don't read the texts again."""
    terms = list(dict.fromkeys(query))
    own = docs.select(key, tokens.alias("tokens"))
    count = lambda term: F.size(F.filter("tokens", lambda t: t == F.lit(term)))
    counts = [count(w).alias(f"tf{i}") for i, w in enumerate(terms)]
    own = own.select(key, F.size("tokens").alias("len"), *counts)
    own = checkpoint(own) if checkpoint else own
    stats = own.agg(
        F.count("*").alias("n"), F.avg("len").alias("avg_len"),
        *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))),
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return own.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).where("score > 0")  # stats is one row


def lexical_score(content: Column, query: Sequence[str]) -> Column:
    """Share of the query's tokens, repeats counted, that the folded text contains."""
    return sum((F.contains(content, F.lit(t)).cast("int") for t in query), F.lit(0)) / float(len(query))


def dense_scores(vectors: DataFrame, key: str, vector: str, query: Sequence[float] | None) -> DataFrame:
    """(key, similarity) of the valid vectors of the query's dimension; none without a query vector."""
    if query is None:
        return vectors.where("false").select(key, F.lit(None).cast("double").alias("similarity"))
    q = F.array(*(F.lit(float(x)) for x in query))
    valid = vectors.where(numeric.valid_vector(F.col(vector), len(query)))
    return valid.select(key, numeric.cosine(F.col(vector), q).alias("similarity"))


def top_k(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows and their rank from 1; order must end in a unique key."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def ranked(df: DataFrame, order: Sequence[Column], parts: int, checkpoint) -> DataFrame:
    """All rows with their rank from 1; order must end in a unique key.

    Rows are dealt to ranges of the order, which checkpoint(df) fixes; a row's rank is its place in its
    range after the sizes of the ranges before, which are one row for each range."""
    dealt = checkpoint(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("rank", place).join(F.broadcast(ahead), "_range").withColumn("rank", F.col("rank") + F.col("_ahead")).drop("_range", "_ahead")


def fuse(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score): sum of 1 / (k + rank) over ranked lists of (key, rank)."""
    parts = [r.select(key, (1.0 / (k + F.col("rank"))).alias("s")) for r in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.sum("s").alias("score"))


def blended(docs: DataFrame, key: str, content: Column, terms: Sequence[str], vectors: DataFrame, vector: str, query: Sequence[float] | None) -> DataFrame:
    """(key, score) of every document: 0.35 of the share of the query's tokens that its folded text contains
    and, where it has a valid vector and the query has one, 0.65 of their cosine.  vectors: (key, vector)."""
    own = docs.select(key, (LEXICAL_SHARE * lexical_score(content, terms)).alias("lexical"))
    if query is None:
        return own.select(key, F.col("lexical").alias("score"))
    near = dense_scores(vectors, key, vector, query)
    return own.join(near, key, "left").select(key, (F.col("lexical") + F.coalesce(COSINE_SHARE * F.col("similarity"), F.lit(0.0))).alias("score"))


def hybrid(docs: DataFrame, key: str, lexical: DataFrame, dense: DataFrame, otherwise: DataFrame) -> DataFrame:
    """(key, score) of every document, by which the whole table is ordered: lexical and dense ranks fused,
    0 for documents that neither list has; where the dense list is empty, the scores of ``otherwise``."""
    if dense.isEmpty():
        return otherwise.select(key, "score")
    return docs.select(key).join(fuse([lexical, dense], key), key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def tokens_of(*columns: str) -> Column:
    return text.search_tokens(F.concat_ws(" ", *columns))
