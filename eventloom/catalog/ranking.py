"""Ranking, selection, aggregation, join and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, spelling, text
from ..operators import ranking, resolve, scans
from ..scratch import cut
from .base import load, r6, sql_identity


def first_per_key(spark, sf_dir):
    """Cheapest line of every part; ties by order and line."""
    line = load(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    out = ranking.first_per_key(line, ["l_partkey"], ["l_extendedprice", "l_orderkey", "l_linenumber"])
    return out.select("l_partkey", r6(F.col("l_extendedprice"), "price"), "l_orderkey", "l_linenumber")


_FIRST = """
SELECT l_partkey, round(l_extendedprice, 6) AS price, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1
"""


def category_coverage(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", ranking.price_order("p_retailprice", "p_partkey").alias("rank"))
    chosen = ranking.category_coverage(parts, "p_brand", "p_type", 40).withColumnRenamed("rank", "place")
    return ranking.ranks_of(chosen, parts.withColumnRenamed("rank", "place"), "place").select("p_partkey", "p_brand", "p_type", "rank")


_COVERAGE = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY rank) = 1),
h AS (SELECT *, rank <> min(rank) OVER (PARTITION BY p_brand) AS later FROM o)
SELECT p_partkey, p_brand, p_type, rank FROM h ORDER BY later, rank LIMIT 40
"""


def interleave_orders(spark, sf_dir):
    """Soonest and dearest orders dealt in turn."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = ranking.interleave(o, [F.asc("o_orderdate"), F.asc("o_orderkey")], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderkey", 30)
    return out.select("o_orderkey", F.col("position").cast("long").alias("position"))


_INTERLEAVE = """
WITH a AS (SELECT o_orderkey, 2 * row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders
           UNION ALL SELECT o_orderkey, 2 * row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders)
SELECT o_orderkey, min(p) AS position FROM a GROUP BY 1 ORDER BY 2 LIMIT 30
"""


def cheapest(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("price"), "p_name")
    return p.orderBy(F.asc_nulls_last("price"), "p_partkey").limit(16).select("p_partkey", r6(F.col("price"), "price"))


def soonest(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-06-17 00:00:00'")
    return o.orderBy("o_orderdate", "o_orderkey").limit(16).select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


def fair_round_robin(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    out = ranking.fair_round_robin(d, "source", [F.desc("n_chars"), F.asc("doc_id")], 5)
    return out.select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


_ROBIN = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents QUALIFY turn <= 5"


def offer_summary(spark, sf_dir):
    """Lines of an order as offers: any and all eligible, least price of eligible, its supplier, and all by price."""
    line = load(spark, sf_dir, "lineitem")
    ok = F.col("l_returnflag") != "R"
    # decimals: the half cents of a double product round differently from engine to engine
    price = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)")), 2)
    return line.groupBy("l_orderkey").agg(
        F.bool_or(ok).alias("any_ok"), F.bool_and(ok).alias("all_ok"), F.min(F.when(ok, price)).cast("double").alias("least"),
        # lines of one number and price: the least supplier, whatever the order of the rows
        F.min_by("l_suppkey", F.when(ok, F.struct(price, "l_linenumber", "l_suppkey"))).alias("supplier"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"].cast("string")), ",").alias("suppliers"),
        F.countDistinct("l_suppkey").alias("n_suppliers"),
    )


_OFFERS = """
WITH l AS (SELECT *, l_returnflag <> 'R' AS ok, round(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)), 2) AS price FROM lineitem)
SELECT l_orderkey, bool_or(ok) AS any_ok, bool_and(ok) AS all_ok, min(price) FILTER (ok)::DOUBLE AS least,
  arg_min(l_suppkey, (price, l_linenumber)) FILTER (ok) AS supplier, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey) AS suppliers,
  count(DISTINCT l_suppkey) AS n_suppliers FROM l GROUP BY 1
"""


def merge_sessions(spark, sf_dir):
    """Lines as listings, merged by part and ship month: representative, agreed flag, cheapest, suppliers."""
    line = load(spark, sf_dir, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    return line.groupBy("l_partkey", month.alias("month")).agg(
        F.count("*").alias("listings"), F.countDistinct("l_suppkey").alias("providers"),
        F.min_by("l_orderkey", F.struct("l_suppkey", "l_orderkey", "l_linenumber")).alias("representative"),
        resolve.agreement(F.col("l_returnflag"), F.lit("unknown")).alias("flag"), r6(F.min("l_extendedprice"), "cheapest"),
    )


_SESSIONS = """
SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS listings, count(DISTINCT l_suppkey) AS providers,
  arg_min(l_orderkey, (l_suppkey, l_orderkey, l_linenumber)) AS representative,
  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'unknown' END AS flag, round(min(l_extendedprice), 6) AS cheapest
FROM lineitem GROUP BY 1, 2
"""


def block_pairs(spark, sf_dir):
    """Customers of one nation and segment whose names' keys are near."""
    c = load(spark, sf_dir, "customer").withColumn("k", text.compact_key(F.col("c_name")))
    return spelling.near_pairs(c, ["c_nationkey", "c_mktsegment"], "c_custkey", "k")


_BLOCKS = f"""
WITH c AS (SELECT *, replace({sql_identity('c_name')}, ' ', '') AS k FROM customer)
SELECT a.c_custkey, b.c_custkey AS c_custkey2 FROM c a JOIN c b USING (c_nationkey, c_mktsegment)
WHERE a.c_custkey < b.c_custkey AND levenshtein(a.k, b.k) <= 1
"""
_LAT, _LON = "40.8 + (s_suppkey * 37 % 1000) / 2500.0", "28.5 + (s_suppkey * 91 % 1000) / 1200.0"


def grid_join(spark, sf_dir):
    """Suppliers placed on a map: pairs within 2 500 metres."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", (40.8 + (F.col("s_suppkey") * 37 % 1000) / 2500.0).alias("lat"), (28.5 + (F.col("s_suppkey") * 91 % 1000) / 1200.0).alias("lon"))
    return resolve.grid_pairs(s, "s_suppkey", "lat", "lon", 2500.0).select("s_suppkey", "s_suppkey2", F.round("metres", 3).alias("metres"))


_GRID = f"""
WITH s AS (SELECT s_suppkey AS k, ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon FROM supplier),
d AS (SELECT a.k AS s_suppkey, b.k AS s_suppkey2, sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2)) * 6371000 AS m
      FROM s a JOIN s b ON a.k < b.k)
SELECT s_suppkey, s_suppkey2, round(m, 3) AS metres FROM d WHERE m <= 2500
"""


def subset_extension(spark, sf_dir):
    """Types as token sets: those that one brand-and-type set extends by a single token."""
    p = load(spark, sf_dir, "part")
    sets = p.select("p_partkey", F.array_union(F.split(text.identity_text(F.col("p_type")), " "), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lower("p_brand"), F.col("p_size").cast("string"))).otherwise(F.array(F.col("p_size").cast("string")))).alias("t"))
    return resolve.subset_extensions(sets, "p_partkey", "t")


_SUBSET = f"""
WITH t AS (SELECT p_partkey, list_sort(list_distinct(list_concat(string_split({sql_identity('p_type')}, ' '),
    CASE WHEN p_partkey % 2 = 0 THEN [lower(p_brand), p_size::VARCHAR] ELSE [p_size::VARCHAR] END))) AS t FROM part),
d AS (SELECT p_partkey AS p_partkey2, t, unnest(t) AS x FROM t WHERE len(t) > 1),
j AS (SELECT a.p_partkey, p_partkey2 FROM t a JOIN (SELECT p_partkey2, array_to_string(list_filter(t, lambda y: y <> x), ' ') AS k FROM d) ON k = array_to_string(a.t, ' '))
SELECT p_partkey, min(p_partkey2) AS p_partkey2 FROM j GROUP BY 1 HAVING count(*) = 1
"""


def connected_families(spark, sf_dir):
    """Documents whose first and last line they share with another, as families."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    keys = d.select("doc_id", F.explode(F.array_distinct(F.array(F.trim(F.element_at("l", 1)), F.trim(F.element_at("l", -1))))).alias("k")).where("length(k) > 20")
    return resolve.components(resolve.star_edges(keys, "k", "doc_id"), d, "doc_id", cut)


_FAMILIES = """
WITH RECURSIVE k AS (SELECT doc_id, unnest(list_distinct([trim(string_split(text, chr(10))[1]), trim(string_split(text, chr(10))[-1])])) AS k FROM documents),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (k) WHERE length(k) > 20),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(min(r.b), d.doc_id) AS component FROM documents d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def knowledge_star(spark, sf_dir):
    """Star projection: orders, lines, distinct parts and suppliers of every nation, and key conflicts."""
    n, s, line = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier"), load(spark, sf_dir, "lineitem")
    j = line.join(s, line.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # nations: 25 rows
    return j.groupBy("n_name").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), r6(F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)")).cast("double"), "value"))


_STAR = """
SELECT n_name, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, round(sum(round(l_extendedprice, 2)::DECIMAL(18, 2))::DOUBLE, 6) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
"""


def graph_edges(spark, sf_dir):
    """Typed edges region - nation - supplier - part as one table, counted by type."""
    n, s, line = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier"), load(spark, sf_dir, "lineitem")
    edge = lambda df, a, b, kind: df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.lit(kind).alias("kind")).distinct()
    all_edges = edge(n, "n_nationkey", "n_regionkey", "in_region").unionByName(edge(s, "s_suppkey", "s_nationkey", "in_nation")).unionByName(edge(line, "l_suppkey", "l_partkey", "offers"))
    return all_edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("a").alias("sources"), F.countDistinct("b").alias("targets"))


_GRAPH = """
WITH e AS (SELECT DISTINCT n_nationkey::VARCHAR AS a, n_regionkey::VARCHAR AS b, 'in_region' AS kind FROM nation
  UNION ALL SELECT DISTINCT s_suppkey::VARCHAR, s_nationkey::VARCHAR, 'in_nation' FROM supplier
  UNION ALL SELECT DISTINCT l_suppkey::VARCHAR, l_partkey::VARCHAR, 'offers' FROM lineitem)
SELECT kind, count(*) AS edges, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM e GROUP BY 1
"""


def catalog_status(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    j = e.crossJoin(F.broadcast(last))  # one row
    fresh = F.col("ts") >= F.col("now") - F.expr("INTERVAL 72 HOURS")
    return j.groupBy("event_type").agg(
        F.count("*").alias("stored"), F.count_if(fresh).alias("fresh"), F.count_if(fresh & (F.col("value") > 10)).alias("eligible"),
        F.min("ts").cast("string").alias("oldest"), F.when(F.count_if(fresh) == 0, "stale").otherwise("ready").alias("state"),
    )


_STATUS = """
WITH n AS (SELECT max(ts) AS now FROM events), j AS (SELECT *, ts >= now - INTERVAL 72 HOUR AS fresh FROM events CROSS JOIN n)
SELECT event_type, count(*) AS stored, count(*) FILTER (fresh) AS fresh, count(*) FILTER (fresh AND value > 10) AS eligible, CAST(min(ts) AS VARCHAR) AS oldest,
  CASE WHEN count(*) FILTER (fresh) = 0 THEN 'stale' ELSE 'ready' END AS state FROM j GROUP BY 1
"""


def coverage_by_source(spark, sf_dir):
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    j = d.select("doc_id", "source", "lang", "n_chars").join(lab, "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("known"), F.count("quality").alias("attempted"), F.count_if(F.col("quality").isNull()).alias("unattempted"),
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad"), F.countDistinct("lang").alias("langs"),
        r6(F.count("quality") / F.count("*"), "completeness"),
    )


_BY_SOURCE = """
SELECT source, count(*) AS known, count(quality) AS attempted, count(*) FILTER (quality IS NULL) AS unattempted, count(*) FILTER (quality = 1) AS good,
  count(*) FILTER (toxic = 1) AS bad, count(DISTINCT lang) AS langs, round(count(quality) / count(*), 6) AS completeness
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
"""


def eval_precision_recall(spark, sf_dir):
    """A length rule as a classifier of quality: precision, recall and counts by source."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    j = d.select("doc_id", "source", (F.col("n_chars") >= 600).alias("said")).join(lab, "doc_id")
    good = F.col("quality") == 1
    tp, said, real = F.count_if(F.col("said") & good), F.count_if(F.col("said")), F.count_if(good)
    return j.groupBy("source").agg(tp.alias("tp"), said.alias("said"), real.alias("actual"), r6(F.when(said > 0, tp / said), "precision"), r6(F.when(real > 0, tp / real), "recall"))


_EVAL = """
WITH j AS (SELECT source, n_chars >= 600 AS said, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (said AND good) AS tp, count(*) FILTER (said) AS said, count(*) FILTER (good) AS actual FROM j GROUP BY 1)
SELECT *, CASE WHEN said > 0 THEN round(tp / said, 6) END AS precision, CASE WHEN actual > 0 THEN round(tp / actual, 6) END AS recall FROM c
"""


def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of a measure by kind."""
    found = scans.percentiles(load(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95, 0.99), cut)
    return found.groupBy("event_type").agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))


_PERCENTILES = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1"


def anchor_multiplicity(spark, sf_dir):
    """Session ids: the anchor itself where it is unique, else with its supplier."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat_ws("-", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("anchor"))
    n = line.groupBy("anchor").agg(F.count("*").alias("n"))
    j = line.join(n, "anchor")
    return j.select("l_orderkey", "l_linenumber", text.identity_hash("session", F.when(F.col("n") == 1, F.col("anchor")).otherwise(F.concat_ws("/", "anchor", "l_suppkey", "l_orderkey"))).alias("session"))


_ANCHOR = """
WITH l AS (SELECT *, l_partkey || '-' || strftime(l_shipdate, '%Y%m%d') AS anchor FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY anchor) AS n FROM l)
SELECT l_orderkey, l_linenumber, sha256('session' || chr(31) || CASE WHEN n = 1 THEN anchor ELSE anchor || '/' || l_suppkey || '/' || l_orderkey END) AS session FROM n
"""


def tag_support(spark, sf_dir):
    """Vectors read as score distributions: consistency of an expected score, by label."""
    e = load(spark, sf_dir, "embeddings")
    p = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * x.cast("double"))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    j = e.select("label", "vec_id", p.alias("p"), total.alias("t")).where("t > 0")
    support = (F.col("p")[2] + F.col("p")[3]) / F.col("t")
    score = (F.col("p")[1] + 2 * F.col("p")[2] + 3 * F.col("p")[3]) / F.col("t")
    return j.groupBy("label").agg(F.count_if(support >= 0.7).alias("supported"), r6(F.avg(score), "mean_score"), r6(F.max(numeric.money(score)), "best"))


_SUPPORT = """
WITH e AS (SELECT label, list_transform(embedding[1:4], lambda x: x::DOUBLE * x::DOUBLE) AS p FROM embeddings), t AS (SELECT *, p[1] + p[2] + p[3] + p[4] AS t FROM e)
SELECT label, count(*) FILTER ((p[3] + p[4]) / t >= 0.7) AS supported, round(avg((p[2] + 2 * p[3] + 3 * p[4]) / t), 6) AS mean_score,
  round(max(round((p[2] + 2 * p[3] + 3 * p[4]) / t, 2)), 6) AS best FROM t WHERE t > 0 GROUP BY 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        first_per_key, category_coverage, interleave_orders, cheapest, soonest, fair_round_robin, offer_summary, merge_sessions, block_pairs,
        grid_join, subset_extension, connected_families, knowledge_star, graph_edges, catalog_status, coverage_by_source,
        eval_precision_recall, latency_percentiles, anchor_multiplicity, tag_support,
    )
}
ORACLE = {
    "first_per_key": _FIRST, "category_coverage": _COVERAGE, "interleave_orders": _INTERLEAVE,
    "cheapest": "SELECT p_partkey, round(CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END, 6) AS price FROM part ORDER BY CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END NULLS LAST, p_partkey LIMIT 16",
    "soonest": "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17' ORDER BY o_orderdate, o_orderkey LIMIT 16",
    "fair_round_robin": _ROBIN, "offer_summary": _OFFERS, "merge_sessions": _SESSIONS, "block_pairs": _BLOCKS, "grid_join": _GRID, "subset_extension": _SUBSET,
    "connected_families": _FAMILIES, "knowledge_star": _STAR, "graph_edges": _GRAPH, "catalog_status": _STATUS, "coverage_by_source": _BY_SOURCE,
    "eval_precision_recall": _EVAL, "latency_percentiles": _PERCENTILES, "anchor_multiplicity": _ANCHOR, "tag_support": _SUPPORT,
}
