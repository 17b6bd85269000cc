"""Versioned state: snapshots, versions, observation logs, windows and publication checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking, revisions
from .base import load, r6


def reconcile_snapshot(spark, sf_dir):
    """Events before a day as the old snapshot, later ones as the new: new users replace, last wins."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    out = ranking.reconcile(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "event_id", "user_id", "ts")
    return out.select("event_id", "user_id", r6(F.col("value"), "value"))


_RECONCILE = """
WITH n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15'), o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15')
SELECT event_id, user_id, round(value, 6) AS value FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n))
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, user_id DESC) = 1
"""


def _versions(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ranking.version_intervals(e, "user_id", "ts", ["event_type"], "event_id")


def version_intervals(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return v.select("user_id", "event_id", "event_type", F.col("ts").cast("string").alias("from"), F.col("end").cast("string").alias("to"))


_VERSIONS = """
v AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
k AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop FROM v WHERE p IS NULL OR p <> event_type)
"""


def asof_read(spark, sf_dir):
    """What type of version each user had at noon of chosen days."""
    days = spark.createDataFrame([(d,) for d in range(1, 29, 3)], "d int")
    probes = load(spark, sf_dir, "events").select("user_id").distinct().crossJoin(F.broadcast(days))  # ten rows
    probes = probes.withColumn("at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("d"), F.lit(12), F.lit(0), F.lit(0)))
    v = _versions(spark, sf_dir).withColumnRenamed("ts", "start")
    return ranking.as_of(v, probes, "user_id", "start", "end", "at").select("user_id", "d", "event_type", "event_id")


_ASOF = f"""
WITH {_VERSIONS}, p AS (SELECT DISTINCT user_id, d::INT AS d, make_timestamp(2024, 1, d, 12, 0, 0) AS moment FROM events CROSS JOIN range(1, 29, 3) t(d))
SELECT p.user_id, d, event_type, event_id FROM p JOIN k ON k.user_id = p.user_id AND k.ts <= moment AND (stop IS NULL OR moment < stop)
"""


def latest_wins(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return ranking.latest_wins(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", r6(F.col("value"), "value"))


_LATEST = """
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
"""


def _observations(spark, sf_dir):
    """Events as page observations: clock in days, content by kind, arrival by id shuffled within fifty."""
    e = load(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.date_diff(F.col("ts"), F.lit("2024-01-01")).alias("clock"), F.col("event_type").alias("content"), ((F.floor(F.col("event_id") / 50) * 50) + (F.col("event_id") * 37 % 50)).alias("arrival"))


_OBS = "o AS (SELECT user_id, event_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS clock, event_type AS content, (event_id // 50) * 50 + (event_id * 37 % 50) AS arrival FROM events)"


def page_head_machine(spark, sf_dir):
    return revisions.page_heads(_observations(spark, sf_dir), "user_id", "clock", "content", "arrival").select("user_id", "event_id", "verdict")


_HEADS = f"""
WITH {_OBS}, t AS (
  SELECT *, max(clock) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
    first_value(content) OVER (PARTITION BY user_id, clock ORDER BY arrival) AS f FROM o)
SELECT user_id, event_id, CASE WHEN top IS NULL OR clock > top THEN 'accepted' WHEN clock < top THEN 'stale' WHEN content = f THEN 'same' ELSE 'held' END AS verdict FROM t
"""


def offer_revision_log(spark, sf_dir):
    """Accepted heads per key with counts of what was refused."""
    o = revisions.page_heads(_observations(spark, sf_dir), "user_id", "clock", "content", "arrival")
    return o.groupBy("user_id").agg(
        F.max_by("event_id", F.when(F.col("verdict") == "accepted", F.struct("clock", "arrival"))).alias("head"),
        *(F.count_if(F.col("verdict") == v).alias(v) for v in ("accepted", "stale", "held", "same")),
    )


_LOG = _HEADS.replace("SELECT user_id, event_id, CASE", ", v AS (SELECT user_id, event_id, clock, arrival, CASE").rstrip().removesuffix("FROM t") + """FROM t)
SELECT user_id, arg_max(event_id, (clock, arrival)) FILTER (verdict = 'accepted') AS head, count(*) FILTER (verdict = 'accepted') AS accepted,
  count(*) FILTER (verdict = 'stale') AS stale, count(*) FILTER (verdict = 'held') AS held, count(*) FILTER (verdict = 'same') AS same FROM v GROUP BY 1
"""


def revalidate_heads(spark, sf_dir):
    """Orders as pins against their lines as current heads: reasons why a pin no longer holds."""
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    head = line.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"))
    j = o.join(head, o.o_orderkey == head.l_orderkey, "left")
    codes = revisions.reason_codes(
        missing=F.col("n").isNull(), returned=F.coalesce("returned", F.lit(False)), late=F.coalesce(F.col("last") > F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS"), F.lit(False)),
        status=~F.col("o_orderstatus").eqNullSafe(F.lit("F")),
    )
    return j.select("o_orderkey", codes.alias("reasons"))


_REVALIDATE = """
WITH h AS (SELECT l_orderkey, max(l_shipdate) AS last, bool_or(l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, concat_ws(',', CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN returned THEN 'returned' END,
  CASE WHEN last > o_orderdate + INTERVAL 100 DAY THEN 'late' END, CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN 'status' END) AS reasons
FROM orders LEFT JOIN h ON l_orderkey = o_orderkey
"""


def occurrence_inherit(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("bound"))
    out = revisions.inherit(e, "user_id", ["ts", "event_id"], "bound", "occurrence")
    return out.select("user_id", "event_id", "occurrence")


_INHERIT = """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS occurrence FROM events
"""


def rate_window(spark, sf_dir):
    """Requests per user and hour above a limit of one."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string").alias("hour")).agg(F.count("*").alias("n")).where("n > 1")


_RATE = "SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"


def rolling_pacer(spark, sf_dir):
    """Requests of a user in the hour up to each one."""
    e = load(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return revisions.rolling_counts(e.select("user_id", "event_id", "t"), "user_id", "t", "event_id", 3_600_000_000).withColumnRenamed("n", "in_hour")


_PACER = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events"


def budget_window(spark, sf_dir):
    """Calls of a user on a day whose running value stays within a budget."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.round("value", 2).cast("decimal(18,2)")).over(w)
    return e.select("event_id", (spent <= 100).alias("granted"))


_BUDGET = """
SELECT event_id, sum(round(value, 2)::DECIMAL(18, 2)) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100 AS granted
FROM events
"""


def soak_gaps(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    g = revisions.gaps(e, "user_id", "ts", "event_id", "86400")
    return g.select("user_id", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n", r6(F.col("longest"), "longest"), "breaks")


_SOAK = """
WITH g AS (SELECT user_id, ts, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last, count(*) AS n, round(max(gap), 6) AS longest, count(*) FILTER (gap > 86400) AS breaks FROM g GROUP BY 1
"""


def event_sessions(spark, sf_dir):
    e = revisions.sessions(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), r6(F.sum("value"), "value"))


_SESSIONS = """
WITH n AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600 * 1e6)::INT, 0) AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS session FROM n)
SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY 1, 2
"""


def batch_seal_checks(spark, sf_dir):
    """Partition identities of an order batch: lines counted, numbered without gaps, in one order only."""
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("top"))
    j = o.join(per, o.o_orderkey == per.l_orderkey, "full_outer")
    return j.groupBy("o_orderstatus").agg(
        F.count("*").alias("known"), F.count("n").alias("attempted"), F.count_if(F.col("n").isNull()).alias("unattempted"),
        F.count_if(F.col("o_orderkey").isNull()).alias("orphans"), F.count_if(F.col("n") != F.col("d")).alias("repeated"), F.count_if(F.col("top") != F.col("n")).alias("gaps"),
    )


_SEAL = """
WITH p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS known, count(n) AS attempted, count(*) FILTER (n IS NULL) AS unattempted, count(*) FILTER (o_orderkey IS NULL) AS orphans,
  count(*) FILTER (n <> d) AS repeated, count(*) FILTER (top <> n) AS gaps FROM orders FULL JOIN p ON l_orderkey = o_orderkey GROUP BY 1
"""


def cohort_publish(spark, sf_dir):
    """Cohort of a publication: open orders, this month's orders and orders with a recent line; carried or re-projected."""
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    active = o.where("o_orderstatus = 'O'").select("o_orderkey")
    batch = o.where("o_orderdate >= TIMESTAMP_NTZ '1998-07-01 00:00:00'").select("o_orderkey")
    touched = line.where("l_shipdate >= TIMESTAMP_NTZ '1998-07-01 00:00:00'").select(F.col("l_orderkey").alias("o_orderkey"))
    cohort = active.union(batch).union(touched).distinct()
    changed = touched.distinct().withColumn("changed", F.lit(True))
    return cohort.join(changed, "o_orderkey", "left").select("o_orderkey", F.when(F.col("changed"), "projected").otherwise("carried").alias("how"))


_COHORT = """
WITH t AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01')
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM t) THEN 'projected' ELSE 'carried' END AS how
FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP '1998-07-01' UNION SELECT o_orderkey FROM t)
"""


def publication_integrity(spark, sf_dir):
    """Two snapshots of parts, the second changed by rule: how many keys were added, removed or changed."""
    p = load(spark, sf_dir, "part")
    before = p.where("p_partkey % 17 != 0")
    after = p.where("p_partkey % 19 != 0").withColumn("p_size", F.when(F.col("p_partkey") % 23 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return revisions.full_comparison(before, after, ["p_partkey"], ["p_name", "p_brand", "p_size"]).groupBy("state").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


_INTEGRITY = """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'added' WHEN p_partkey % 19 = 0 THEN 'removed' WHEN p_partkey % 23 = 0 THEN 'changed' ELSE 'same' END AS state
  FROM part WHERE p_partkey % 17 <> 0 OR p_partkey % 19 <> 0)
SELECT state, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM s GROUP BY 1
"""


def content_root(spark, sf_dir):
    return revisions.content_root(load(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


_ROOT = """
WITH h AS (SELECT sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority) AS h FROM orders)
SELECT sha256(sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR || '|' ||
  sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR || '|' || count(*)) AS root, count(*) AS rows FROM h
"""


def chunk_tree(spark, sf_dir):
    """Merkle tree over chunks of 1000 order keys, every level."""
    return revisions.chunk_tree(load(spark, sf_dir, "orders"), "o_orderkey", 1000, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


_TREE = """
WITH RECURSIVE h AS (SELECT o_orderkey // 1000 AS n, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority) AS h FROM orders),
c AS (SELECT n, sha256(sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR || '|' ||
  sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR || '|' || count(*)) AS digest, count(*) AS rows FROM h GROUP BY 1),
t(level, tree) AS (
  SELECT 0, list({'n': n, 'd': digest, 'r': rows} ORDER BY n) FROM c
  UNION ALL
  SELECT level + 1, list_transform(list_sort(list_distinct(list_transform(tree, lambda x: x.n // 2))), lambda p: {'n': p,
    'd': sha256(list_filter(tree, lambda x: x.n // 2 = p)[1].d || '|' || CASE WHEN len(list_filter(tree, lambda x: x.n // 2 = p)) = 2 THEN list_filter(tree, lambda x: x.n // 2 = p)[2].d ELSE '' END),
    'r': list_sum(list_transform(list_filter(tree, lambda x: x.n // 2 = p), lambda x: x.r))::BIGINT}) FROM t WHERE list_max(list_transform(tree, lambda x: x.n)) > 0)
SELECT level, x.n AS n, x.d AS digest, x.r AS rows FROM (SELECT level, unnest(tree) AS x FROM t)
"""


def projection_boundaries(spark, sf_dir):
    """Next instant at which anything of a user changes after a fixed now."""
    e = load(spark, sf_dir, "events")
    now = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    marks = e.select("user_id", F.explode(F.array(F.col("ts") - F.expr("INTERVAL 5 MINUTES"), F.col("ts") + F.expr("INTERVAL 72 HOURS"))).alias("mark"))
    return marks.where(F.col("mark") > now).groupBy("user_id").agg(F.min("mark").cast("string").alias("next"))


_BOUNDARIES = """
WITH m AS (SELECT user_id, unnest([ts - INTERVAL 5 MINUTE, ts + INTERVAL 72 HOUR]) AS mark FROM events)
SELECT user_id, CAST(min(mark) AS VARCHAR) AS next FROM m WHERE mark > TIMESTAMP '2024-01-10' GROUP BY 1
"""


def readiness_reasons(spark, sf_dir):
    """Reason codes of sources: few documents, a drop against the mean, missing labels."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    s = d.select("doc_id", "source").join(lab.select("doc_id", F.lit(1).alias("l")), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("l").alias("labelled"))
    mean = s.agg(F.avg("n").alias("mean"))
    j = s.crossJoin(F.broadcast(mean))  # one row
    return j.select("source", revisions.reason_codes(few=F.col("n") < 20, drop=F.col("n") < 0.5 * F.col("mean"), unlabelled=F.col("labelled") < 0.4 * F.col("n")).alias("reasons"))


_READY = """
WITH s AS (SELECT source, count(*) AS n, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1), m AS (SELECT avg(n) AS mean FROM s)
SELECT source, concat_ws(',', CASE WHEN n < 20 THEN 'few' END, CASE WHEN n < 0.5 * mean THEN 'drop' END, CASE WHEN labelled < 0.4 * n THEN 'unlabelled' END) AS reasons FROM s CROSS JOIN m
"""

QUERIES = {
    f.__name__: f
    for f in (
        reconcile_snapshot, version_intervals, asof_read, latest_wins, page_head_machine, offer_revision_log, revalidate_heads, occurrence_inherit,
        rate_window, rolling_pacer, budget_window, soak_gaps, event_sessions, batch_seal_checks, cohort_publish, publication_integrity, content_root, chunk_tree,
        projection_boundaries, readiness_reasons,
    )
}
ORACLE = {
    "reconcile_snapshot": _RECONCILE,
    "version_intervals": f"WITH {_VERSIONS} SELECT user_id, event_id, event_type, CAST(ts AS VARCHAR) AS \"from\", CAST(stop AS VARCHAR) AS \"to\" FROM k",
    "asof_read": _ASOF, "latest_wins": _LATEST, "page_head_machine": _HEADS, "offer_revision_log": _LOG, "revalidate_heads": _REVALIDATE,
    "occurrence_inherit": _INHERIT, "rate_window": _RATE, "rolling_pacer": _PACER, "budget_window": _BUDGET, "soak_gaps": _SOAK, "event_sessions": _SESSIONS,
    "batch_seal_checks": _SEAL, "cohort_publish": _COHORT, "publication_integrity": _INTEGRITY, "content_root": _ROOT, "chunk_tree": _TREE,
    "projection_boundaries": _BOUNDARIES, "readiness_reasons": _READY,
}
