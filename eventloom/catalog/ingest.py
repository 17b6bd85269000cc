"""Ingest, coverage, location and timing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import location, timing
from ..sources import ingest, jsonld
from .base import load, r6


def performances(spark, sf_dir):
    """Lines as performances of (day, supplier): least price on sale, sold out if all were returned."""
    line = load(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    out = ingest.group_performances(line, "day", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_returnflag") != "R")
    return out.select("day", "l_suppkey", r6(F.col("price"), "price"), "rows", "sold_out")


_PERFORMANCES = """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_suppkey, round(min(round(l_extendedprice * 100)::BIGINT) FILTER (l_returnflag <> 'R') / 100, 6) AS price, count(*) AS rows,
  NOT bool_or(l_returnflag <> 'R') AS sold_out FROM lineitem GROUP BY 1, 2
"""


def session_reasons(spark, sf_dir):
    """Orders as items with nested session lists: sessions found, and reasons for what was not used."""
    o = load(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+03:00").otherwise("")
    items = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("/e/"), "o_custkey").alias("url"), F.when(F.col("o_orderkey") % 11 == 0, "Ankara").otherwise("İstanbul").alias("city"),
        F.lit("Salon").alias("venue"), (F.col("o_orderkey") % 13 == 0).alias("open_ticket"), F.array(F.array(F.concat(day, zone)), F.array(F.lit("x+03:00"))).alias("sessions"),
    )
    events, bad = ingest.expand_sessions(items, F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return events.select(F.lit("session").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_REASONS = """
WITH i AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 13 = 0 AS open, o_orderkey % 11 = 0 AS away FROM orders),
s AS (SELECT CASE WHEN k % 3 = 2 THEN 'ambiguous_session_timezone' WHEN CASE WHEN k % 3 = 1 THEN d - INTERVAL 3 HOUR ELSE d END < TIMESTAMP '1996-01-01' THEN 'invalid_session' ELSE 'session' END AS reason FROM i WHERE NOT open AND NOT away)
SELECT reason, count(*) AS n FROM (SELECT reason FROM s UNION ALL SELECT 'invalid_session' FROM i WHERE NOT open AND NOT away
  UNION ALL SELECT CASE WHEN open THEN 'open_ticket_without_session' ELSE 'sessions_missing_or_non_istanbul' END FROM i WHERE open OR away) GROUP BY 1
"""


def import_outcomes(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderdate").alias("start"), (F.expr("TIMESTAMP_NTZ '1995-06-17 00:00:00'") - F.make_dt_interval(hours=(F.col("o_orderkey") % 100).cast("int"))).alias("checked"))
    return ingest.import_filter(o, F.expr("TIMESTAMP_NTZ '1995-06-17 00:00:00'")).groupBy("o_orderstatus", "what").agg(F.count("*").alias("n"))


_IMPORT = """
SELECT o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 'expired' WHEN o_orderkey % 100 > 72 THEN 'stale' ELSE 'kept' END AS what, count(*) AS n FROM orders GROUP BY 1, 2
"""


def publication_gates(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return ingest.publication_gate(p, p.where("p_partkey % 2 = 0"), F.col("p_size") <= 25)


_GATE = """
WITH c AS (SELECT count(*) FILTER (p_size <= 25) AS old, count(*) FILTER (p_size <= 25 AND p_partkey % 2 = 0) AS new FROM part)
SELECT old, new, CASE WHEN new = 0 THEN 'no_verified_available_events' WHEN old >= 20 AND new < 0.6 * old THEN 'large_catalog_drop' END AS reason FROM c
"""


def coverage_state(spark, sf_dir):
    """Users as urls and their events as crawl attempts."""
    what = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "purchase", "retired").when(F.col("event_type") == "signup", "quarantined").otherwise(F.col("event_type"))
    e = load(spark, sf_dir, "events").withColumn("what", what)
    s = ingest.coverage_state(e, "user_id", "ts", "what", "event_id")
    late = ingest.due(s, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).select("user_id", F.lit(True).alias("due"))
    return s.join(late, "user_id", "left").select("user_id", "attempts", F.col("last_success").cast("string").alias("last_success"), "failure", "state", F.coalesce("due", F.lit(False)).alias("due"))


_STATE = """
WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'success' WHEN 'purchase' THEN 'retired' WHEN 'signup' THEN 'quarantined' ELSE event_type END AS what FROM events),
s AS (SELECT user_id, count(*) AS attempts, max(ts) FILTER (what = 'success') AS ok, arg_max(what, (ts, event_id)) AS last_what,
  arg_max(what, (ts, event_id)) FILTER (what IN ('success', 'retired', 'quarantined')) AS state, max(ts) FILTER (what IN ('success', 'retired', 'quarantined')) AS since FROM e GROUP BY 1)
SELECT user_id, attempts, CAST(ok AS VARCHAR) AS last_success, CASE WHEN last_what NOT IN ('success', 'retired') THEN last_what END AS failure, state,
  coalesce(state, '') <> 'retired' OR since <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS due FROM s
"""


def location_resolve(spark, sf_dir):
    """Places of customers from made-up labels and addresses, counted."""
    c = load(spark, sf_dir, "customer")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("c_custkey") % n + 1).cast("int"))
    label = pick(7, "Kadıköy", "Anadolu Yakası", "Moda / Üsküdar", "", "Levent", "Nowhere", "Taksim")
    address = F.concat(F.lit("Sk. 1 "), pick(5, "Moda", "Şişli", "Beşiktaş", "", "Bağdat Caddesi"), F.when(F.col("c_custkey") % 2 == 0, "/İstanbul").otherwise(""))
    # equal labels and addresses are read once
    said = c.groupBy(label.alias("label"), address.alias("address")).agg(F.count("*").alias("n"))
    at = location.resolve_location(F.col("label"), F.col("address"))
    return said.select(at.alias("at"), "n").groupBy("at.district", "at.side", "at.precision").agg(F.sum("n").alias("n"))


_PLACE = """
WITH c AS (SELECT c_custkey % 7 AS l, c_custkey % 5 AS a FROM customer),
p AS (SELECT ['kadikoy', NULL, NULL, NULL, NULL, NULL, 'beyoglu'][l + 1] AS ld, ['asia', 'asia', 'asia', NULL, 'europe', NULL, 'europe'][l + 1] AS ls,
  ['kadikoy', 'sisli', 'besiktas', NULL, NULL][a + 1] AS ad, ['asia', 'europe', 'europe', NULL, 'asia'][a + 1] AS s FROM c),
o AS (SELECT *, coalesce(ls, s) IS NOT NULL AND coalesce(ls <> s, false) = false AND coalesce(ld <> ad, false) = false AS ok FROM p)
SELECT CASE WHEN ok THEN coalesce(ld, ad) END AS district, CASE WHEN ok THEN coalesce(ls, s) END AS side,
  CASE WHEN NOT ok THEN 'unknown' WHEN coalesce(ld, ad) IS NOT NULL THEN 'district' ELSE 'side' END AS precision, count(*) AS n FROM o GROUP BY 1, 2, 3
"""


def door_times(spark, sf_dir):
    """Orders with made-up descriptions whose start is the door time of an event that starts later."""
    o = load(spark, sf_dir, "orders")
    h = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    text = F.concat(F.lit("Kapı açılış: "), h, F.lit(":00. Etkinlik saati 21.00"))
    start = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(5), (F.col("o_orderkey") * 5 % 24).cast("int"), F.lit(0), F.lit(0))
    return o.select("o_orderkey", timing.labelled_clock(text, timing.DOOR_TIME).alias("door"), timing.door_time_conflict(text, start).alias("conflict"))


_DOORS = """
SELECT o_orderkey, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' AS door, o_orderkey % 24 <> 21 AND (o_orderkey * 5 + 3) % 24 = o_orderkey % 24 AS conflict FROM orders
"""

def jsonld_events(spark, sf_dir):
    """Orders as pages whose lines are nested events, each inside the one before: every event, however deep, as a checked listing."""
    line = load(spark, sf_dir, "lineitem")
    own = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    orders = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(own)).alias("lines"))
    stock = lambda x: F.when(x["l_returnflag"] == "R", "SoldOut").otherwise("InStock")

    def event(inner, x):
        sub = F.when(inner == "", "").when(x["l_linenumber"] % 2 == 0, F.concat(F.lit(', "subEvent": '), inner)).otherwise(F.concat(F.lit(', "subEvent": [['), inner, F.lit("]]")))
        return F.concat(
            F.lit('{"@type": "MusicEvent", "name": "Part <b>'), x["l_partkey"], F.lit('</b>", "startDate": "'), x["day"], F.when(x["l_linenumber"] % 3 == 0, "T20:00:00").otherwise("T20:00:00+03:00"),
            F.lit('", "location": {"name": "Hall '), x["l_suppkey"], F.lit('"}, "offers": {"price": '), F.round(x["l_extendedprice"], 2).cast("decimal(18,2)").cast("string"),
            F.lit(', "priceCurrency": "TRY", "availability": "https://schema.org/'), stock(x), F.lit('"}'), sub, F.lit("}"),
        )

    html = F.concat(F.lit('<html><script type="application/ld+json">{"@graph": ['), F.aggregate(F.reverse("lines"), F.lit(""), event), F.lit("]}</script><script type='application/ld+json'>{broken</script></html>"))
    objects = jsonld.jsonld_objects(orders.select("l_orderkey", html.alias("html")), ["l_orderkey"])
    listed = jsonld.validate_listing(jsonld.events(objects, ["l_orderkey"]), F.expr("TIMESTAMP '1995-01-01 00:00:00'"))
    return listed.select("l_orderkey", "title", "start_text", "venue", r6(F.col("price"), "price"), "availability", F.array_join("errors", ",").alias("errors"))


_JSONLD = """
WITH l AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') || CASE WHEN l_linenumber % 3 = 0 THEN 'T20:00:00' ELSE 'T20:00:00+03:00' END AS start_text FROM lineitem)
SELECT l_orderkey, 'Part ' || l_partkey AS title, start_text, 'Hall ' || l_suppkey AS venue, CASE WHEN l_returnflag <> 'R' THEN round(round(l_extendedprice, 2), 6) END AS price,
  CASE WHEN l_returnflag = 'R' THEN 'sold_out' ELSE 'available' END AS availability,
  CASE WHEN l_linenumber % 3 = 0 THEN 'start_offset' WHEN l_shipdate::DATE + INTERVAL 17 HOUR < TIMESTAMP '1995-01-01' THEN 'past' ELSE '' END AS errors FROM l
"""

QUERIES = {f.__name__: f for f in (jsonld_events, performances, session_reasons, import_outcomes, publication_gates, coverage_state, location_resolve, door_times)}
ORACLE = {
    "jsonld_events": _JSONLD, "performances": _PERFORMANCES, "session_reasons": _REASONS, "import_outcomes": _IMPORT, "publication_gates": _GATE, "coverage_state": _STATE,
    "location_resolve": _PLACE, "door_times": _DOORS,
}
