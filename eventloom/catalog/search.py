"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import search
from ..plans import conditions as plan
from ..scratch import cut
from .base import load, r6, sql_fold, sql_tokens

#: The query text and the document whose vector is the query vector.
QUERY = "the attion hean daha tionre thed the"
TERMS = ["the", "attion", "hean", "tionre", "thed", "the"]
QUERY_VECTOR_ID = 7
TOP = 50


def bm25_search(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = search.bm25(docs, "doc_id", search.tokens_of("text"), TERMS)
    return found.select("doc_id", r6(F.col("score"), "score"))


_BM25 = f"""
WITH tok AS (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM tok),
terms AS (SELECT DISTINCT unnest(['the', 'attion', 'hean', 'tionre', 'thed']) AS term),
tf AS (SELECT doc_id, term, len(tokens) AS dl, len(list_filter(tokens, lambda t: t = term)) AS tf FROM tok CROSS JOIN terms),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
scored AS (
  SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS score
  FROM tf JOIN df USING (term) CROSS JOIN stats GROUP BY doc_id)
"""


def lexical_rank(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    scored = docs.select("doc_id", search.lexical_score(text.fold(F.col("text")), TERMS).alias("score")).where("score > 0")
    top = search.top_k(scored, [F.desc("score"), F.asc("doc_id")], TOP)
    return top.select("doc_id", r6(F.col("score"), "score"), F.col("rank").cast("long").alias("rank"))


_LEXICAL = f"""
WITH f AS (SELECT doc_id, {sql_fold('text')} AS t FROM documents),
s AS (SELECT doc_id, ({' + '.join(f"contains(t, '{w}')::INT" for w in TERMS)}) / {float(len(TERMS))} AS score FROM f)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {TOP}
"""


def _query_vector(spark, sf_dir):
    row = load(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").first()
    return list(row[0]) if row and row[0] else None


def dense_topk(spark, sf_dir):
    scored = search.dense_scores(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir))
    top = search.top_k(scored, [F.desc("similarity"), F.asc("vec_id")], TOP)
    return top.select("vec_id", r6(F.col("similarity"), "similarity"), F.col("rank").cast("long").alias("rank"))


_DENSE = f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
qv AS (SELECT e AS qe FROM v WHERE vec_id = {QUERY_VECTOR_ID}),
sim AS (
  SELECT vec_id, list_sum(list_transform(list_zip(e, qe), lambda p: p[1] * p[2]))
    / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(qe, lambda x: x * x)))) AS similarity
  FROM v CROSS JOIN qv WHERE len(e) = len(qe) AND list_sum(list_transform(e, lambda x: x * x)) > 0)
"""


def rrf_hybrid(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lexical = search.bm25(docs, "doc_id", search.tokens_of("text"), TERMS, cut)
    lexical = search.ranked(lexical, [F.desc(F.round("score", 9)), F.asc("doc_id")], parts, cut)
    dense = cut(search.dense_scores(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir)))
    dense = search.ranked(dense, [F.desc(F.round("similarity", 9)), F.asc("vec_id")], parts, cut).withColumnRenamed("vec_id", "doc_id")
    fused = search.fuse([lexical, dense], "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    best = fused.groupBy("source").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("id"))).alias("b"))
    best = best.select("source", (-F.col("b.id")).alias("doc_id"), r6(F.col("b.score"), "score"))
    return best.orderBy(F.desc("score"), "doc_id").limit(16)


_RRF = f"""{_BM25},
{_DENSE},
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored WHERE score > 0),
den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS r FROM sim),
fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY doc_id),
best AS (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS p FROM fused JOIN documents USING (doc_id))
SELECT source, doc_id, round(score, 6) AS score FROM best WHERE p = 1 ORDER BY round(score, 6) DESC, doc_id LIMIT 16
"""


def blended_rank(spark, sf_dir):
    """Every document with the blend of its term share and its vector's cosine."""
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    out = search.blended(load(spark, sf_dir, "documents"), "doc_id", text.fold(F.col("text")), TERMS, vectors, "embedding", _query_vector(spark, sf_dir))
    return out.select("doc_id", r6(F.col("score"), "score"))


_SHARE = f"""f AS (SELECT doc_id, {sql_fold('text')} AS t FROM documents),
share AS (SELECT doc_id, 0.35::DOUBLE * (coalesce({' + '.join(f"contains(t, '{w}')::INT" for w in TERMS)}, 0)) / {float(len(TERMS))}::DOUBLE AS s FROM f)"""
_BLEND = f"""WITH {_DENSE}, {_SHARE}
SELECT doc_id, round(s + coalesce(0.65::DOUBLE * similarity, 0), 6) AS score FROM share LEFT JOIN sim ON vec_id = doc_id
"""


def hybrid_order(spark, sf_dir):
    """Scores that put the whole table in order: of fused ranks, and without a vector in the catalog."""
    docs, vectors = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lexical = search.bm25(docs, "doc_id", search.tokens_of("text"), TERMS, cut)
    lexical = cut(search.ranked(lexical, [F.desc(F.round("score", 9)), F.asc("doc_id")], parts, cut))
    out = None
    for mode, own in (("dense", vectors), ("none", vectors.where("false"))):
        dense = cut(search.dense_scores(own, "doc_id", "embedding", _query_vector(spark, sf_dir)))
        dense = search.ranked(dense, [F.desc(F.round("similarity", 9)), F.asc("doc_id")], parts, cut)
        plain = search.blended(docs, "doc_id", text.fold(F.col("text")), TERMS, own, "embedding", None)
        scores = search.hybrid(docs, "doc_id", lexical, dense, plain).select(F.lit(mode).alias("mode"), "doc_id", r6(F.col("score"), "score"))
        out = scores if out is None else out.unionByName(scores)
    return out


_HYBRID = f"""{_BM25},
{_DENSE}, {_SHARE},
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored WHERE score > 0),
den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS r FROM sim),
fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY doc_id)
SELECT 'dense' AS mode, doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN fused USING (doc_id)
UNION ALL SELECT 'none', doc_id, round(s, 6) FROM share
"""


def soft_rerank(spark, sf_dir):
    """Parts ranked by price, re-ranked by a budget and a brand preference."""
    parts = load(spark, sf_dir, "part")
    ranked = search.top_k(parts, [F.desc("p_retailprice"), F.asc("p_partkey")], 300)
    side = F.when(F.col("p_size") <= 25, "europe").otherwise("asia")
    signal = plan.soft_signal([
        plan.budget_signal(F.col("p_retailprice"), "approx", 1500.0),
        plan.location_signal(side, F.col("p_brand"), "europe", "Brand#12"),
    ])
    score = plan.soft_score(F.col("rank") - 1, signal)
    top = ranked.select("p_partkey", "rank", signal.alias("signal"), score.alias("score"))
    top = search.top_k(top, [F.desc(F.round("score", 12)), F.asc("rank")], TOP, rank="place")
    return top.select("p_partkey", r6(F.col("signal"), "signal"), r6(F.col("score"), "score"), F.col("place").cast("long").alias("place"))


_SOFT = f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 300),
s AS (
  SELECT p_partkey, rank, greatest(-1, least(1, (
    CASE WHEN abs((p_retailprice - 1500) / 1500) <= 0.2 THEN 1.0 ELSE -least(1.0, abs((p_retailprice - 1500) / 1500)) END +
    CASE WHEN p_size > 25 THEN -0.5 WHEN p_brand = 'Brand#12' THEN 1.0 ELSE 0.25 END)::DOUBLE / 2)) AS signal FROM ranked),
t AS (SELECT *, (1 + 0.25 * signal) / (60 + rank) AS score FROM s)
SELECT p_partkey, round(signal, 6) AS signal, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, rank) AS place
FROM t ORDER BY place LIMIT {TOP}
"""


def search_funnel(spark, sf_dir):
    """How many documents each step of a search leaves, by source."""
    docs = load(spark, sf_dir, "documents")
    words = F.concat(F.lit(" "), text.identity_text(F.col("text")), F.lit(" "))
    found = plan.compile_condition(
        plan.All((plan.Atom("language", ("en",)), plan.Not(plan.Atom("topic", ("idiot", "moron"))))),
        {"language": plan.category_evidence("lang"), "topic": plan.topic_evidence(text.identity_text(F.col("text")))},
    )
    return docs.groupBy("source").agg(
        F.count("*").alias("stored"),
        F.count_if(F.col("n_chars") >= 200).alias("long_enough"),
        F.count_if((F.col("n_chars") >= 200) & found).alias("supported"),
        F.count_if((F.col("n_chars") >= 200) & found & words.contains(" the ")).alias("matched"),
    )


_FUNNEL = f"""
WITH d AS (SELECT *, ' ' || trim(regexp_replace({sql_fold("coalesce(text, '')")}, '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents),
e AS (SELECT *, lang = 'en' AND NOT regexp_matches(w, ' (?:idiot|moron) ') AS ok FROM d)
SELECT source, count(*) AS stored, count(*) FILTER (n_chars >= 200) AS long_enough, count(*) FILTER (n_chars >= 200 AND ok) AS supported,
       count(*) FILTER (n_chars >= 200 AND ok AND contains(w, ' the ')) AS matched
FROM e GROUP BY source
"""


def vector_validity(spark, sf_dir):
    """Valid vectors, and their mean norm, by label."""
    e = load(spark, sf_dir, "embeddings")
    ok = numeric.valid_vector(F.col("embedding"), 64)
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), r6(F.avg(F.when(ok, numeric.norm(F.col("embedding")))), "mean_norm"))


_VALID = """
SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND s > 0) AS valid, round(avg(sqrt(s)) FILTER (len(embedding) = 64 AND s > 0), 6) AS mean_norm
FROM (SELECT label, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings) GROUP BY label
"""

QUERIES = {
    "bm25_search": bm25_search,
    "lexical_rank": lexical_rank,
    "dense_topk": dense_topk,
    "rrf_hybrid": rrf_hybrid,
    "blended_rank": blended_rank,
    "hybrid_order": hybrid_order,
    "soft_rerank": soft_rerank,
    "search_funnel": search_funnel,
    "vector_validity": vector_validity,
}
ORACLE = {
    "bm25_search": _BM25 + "SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0",
    "lexical_rank": _LEXICAL,
    "dense_topk": f"WITH {_DENSE} SELECT vec_id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM sim ORDER BY rank LIMIT {TOP}",
    "rrf_hybrid": _RRF,
    "blended_rank": _BLEND,
    "hybrid_order": _HYBRID,
    "soft_rerank": _SOFT,
    "search_funnel": _FUNNEL,
    "vector_validity": _VALID,
}
