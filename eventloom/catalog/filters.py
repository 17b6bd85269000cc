"""Filter, evidence and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, numeric, text
from ..operators import filters
from ..plans import conditions as plan
from .base import load, q, r6, sql_fold, sql_identity

NOW = "1995-06-17 00:00:00"


def eligibility_window(spark, sf_dir):
    """Orders as listings: those whose day is ahead, of a customer with a known balance, by priority."""
    orders = load(spark, sf_dir, "orders")
    now = F.lit(NOW).cast("timestamp_ntz")
    ok = filters.eligible(F.col("o_orderdate"), now + F.make_dt_interval(hours=-(F.col("o_orderkey") % 96).cast("int")), now, F.col("o_orderstatus") != "F")
    return orders.where(ok).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").cast("string").alias("first_day"), r6(F.sum("o_totalprice"), "total"))


_ELIGIBLE = f"""
SELECT o_orderpriority, count(*) AS n, CAST(min(o_orderdate) AS VARCHAR) AS first_day, round(sum(o_totalprice), 6) AS total
FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' AND o_orderkey % 96 <= 72 AND o_orderstatus <> 'F' GROUP BY 1
"""


def filters_budget_date(spark, sf_dir):
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    party = (F.col("o_orderkey") % 4 + 1).cast("double")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    near = orders.where(
        filters.within_price(F.col("o_totalprice"), 150000.0, exclusive=True)
        & filters.within_budget(F.col("o_totalprice"), party, 300000.0)
        & filters.overlaps(day, F.date_format(F.date_add("o_orderdate", 14), "yyyy-MM-dd"), "1995-03-01", "1995-05-31")
    )
    joined = near.join(customer.where(~F.col("c_mktsegment").isin("MACHINERY")), near.o_custkey == customer.c_custkey)
    return joined.select("o_orderkey", "c_mktsegment", r6(F.col("o_totalprice"), "o_totalprice"), party.alias("party"), day.alias("day"))


_BUDGET = """
SELECT o_orderkey, c_mktsegment, round(o_totalprice, 6) AS o_totalprice, (o_orderkey % 4 + 1)::DOUBLE AS party, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice < 150000 AND o_totalprice * (o_orderkey % 4 + 1) <= 300000 AND c_mktsegment <> 'MACHINERY'
  AND strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') >= '1995-03-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1995-05-31'
"""


def exclude_production(spark, sf_dir):
    """Line items of no part that a returned line of the first suppliers belongs to."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    hits = line.where((F.col("l_returnflag") == "R") & (F.col("l_suppkey") <= 40))
    return filters.exclude_productions(line, hits, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


_EXCLUDE = """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey <= 40)
"""


def kleene_plan(spark, sf_dir):
    """Three-valued evidence of a nested plan over parts, by status."""
    parts = load(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
    rules = {
        "category": plan.category_evidence("p_brand"),
        "budget": plan.budget_evidence("price", F.col("p_size") != 13),
        "topic": plan.topic_evidence(text.identity_text(F.col("p_type"))),
        "size": lambda a, b: F.col("p_size").between(a, b),
    }
    wanted = plan.All((
        plan.Any((plan.Atom("budget", ("lte", 1400.0)), plan.Atom("category", ("Brand#12", "Brand#23", "Brand#34")))),
        plan.Not(plan.Atom("topic", ("brass", "tin"))),
        plan.Any((plan.Atom("size", (1, 30)), plan.Atom("budget", ("approx", 1000.0)))),
    ))
    found = plan.compile_condition(wanted, rules)
    return parts.withColumn("price", price).select("p_partkey", plan.status(found).alias("status"))


_KLEENE = f"""
WITH p AS (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, ' ' || {sql_identity('p_type')} || ' ' AS t FROM part),
e AS (
  SELECT p_partkey,
    ((CASE WHEN p_size <> 13 THEN price <= 1400 END) OR p_brand IN ('Brand#12', 'Brand#23', 'Brand#34'))
    AND NOT coalesce(CASE WHEN regexp_matches(t, ' (?:brass|tin) ') THEN true END, false)
    AND (p_size BETWEEN 1 AND 30 OR NULL::BOOLEAN) AS ok FROM p)
SELECT p_partkey, CASE WHEN ok THEN 'supported' WHEN NOT ok THEN 'contradicted' ELSE 'unknown' END AS status FROM e
"""


def plan_atoms(spark, sf_dir):
    """Evidence of single tests on parts, their size and key standing for ages and labels."""
    parts = load(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(key % 5 == 0, "children").when(key % 5 == 1, "family").when(key % 5 == 2, "adult_only").when(key % 5 == 3, "general")
    suitable = (key % 100) / 100.0
    a = plan.Audience(
        labelled=size != 13, kind=kind, min_age=F.when(size < 20, size), max_age=F.when(size % 3 == 0, size + 30),
        suitable=suitable, family=F.col("p_type").contains("BRASS"),
    )
    age = plan.attendee_age_evidence(a, lambda years: size + years >= 30, size > 45)
    outdoors = plan.experience_evidence([F.col("p_name"), F.col("p_type")], {"quiet": size > 10}, suitable, suitable)
    tests = {
        "child": age(8), "adult": age(30), "company": plan.companion_evidence(a)("children"), "friends": plan.companion_evidence(a)("friends"),
        "outdoors": outdoors("outdoors"), "seated": outdoors("seated"), "quiet": outdoors("quiet"), "mood": plan.mood_evidence("calm"),
        "total": plan.budget_evidence("p_retailprice", size != 13, F.when(size > 5, F.lit(2)))("lte", 2800.0, "group_total"),
    }
    return parts.select("p_partkey", *(plan.status(found).alias(name) for name, found in tests.items()))


_ATOMS = """
WITH p AS (SELECT p_partkey, p_size, p_type, p_retailprice, p_size <> 13 AS labelled, (p_partkey % 100) / 100.0 AS suitable,
    CASE p_partkey % 5 WHEN 0 THEN 'children' WHEN 1 THEN 'family' WHEN 2 THEN 'adult_only' WHEN 3 THEN 'general' END AS kind,
    CASE WHEN p_size < 20 THEN p_size END AS lo, CASE WHEN p_size % 3 = 0 THEN p_size + 30 END AS hi FROM part),
c AS (SELECT *, CASE WHEN NOT labelled THEN CASE WHEN contains(p_type, 'BRASS') THEN true END
    WHEN kind = 'adult_only' OR lo >= 13 THEN false
    WHEN kind IN ('children', 'family') OR lo <= 10 OR suitable >= 0.65 THEN true
    WHEN suitable <= 0.25 THEN false END AS child_ok FROM p),
e AS (SELECT p_partkey, child_ok AS company, true AS friends, NULL::BOOLEAN AS mood, p_size > 10 AS quiet,
    CASE WHEN labelled AND (lo IS NOT NULL OR hi IS NOT NULL) THEN 8 BETWEEN coalesce(lo, 0) AND coalesce(hi, 120)
         WHEN labelled AND kind = 'adult_only' THEN false WHEN NOT labelled OR p_size > 45 THEN p_size + 8 >= 30 ELSE child_ok END AS child,
    CASE WHEN labelled AND (lo IS NOT NULL OR hi IS NOT NULL) THEN 30 BETWEEN coalesce(lo, 0) AND coalesce(hi, 120)
         WHEN NOT labelled OR p_size > 45 THEN p_size + 30 >= 30 WHEN kind IN ('general', 'family', 'adult_only') THEN true END AS adult,
    CASE WHEN suitable >= 0.7 THEN true END AS outdoors, CASE WHEN suitable >= 0.7 THEN true END AS seated,
    CASE WHEN p_size <> 13 AND p_size > 5 THEN 2 * p_retailprice <= 2800 END AS total FROM c)
SELECT p_partkey, """ + ", ".join(
    f"CASE WHEN {c} THEN 'supported' WHEN NOT {c} THEN 'contradicted' ELSE 'unknown' END AS {c}"
    for c in ("child", "adult", "company", "friends", "outdoors", "seated", "quiet", "mood", "total")
) + " FROM e"


def requirement_evidence(spark, sf_dir):
    """Positive against negative evidence in sentences of documents, with the evidence itself."""
    docs = load(spark, sf_dir, "documents")
    parts = text.sentences(F.col("text"))
    positive = F.exists(parts, lambda s: text.fold(s).rlike("(?:^|[^a-z])the (?:[a-z]+ )?of(?:[^a-z]|$)"))
    negative = F.exists(parts, lambda s: text.fold(s).rlike("(?:idiot|moron|scum)"))
    lines = text.evidence_lines(F.col("text"), "(?:idiot|moron|scum)")
    return docs.select("doc_id", plan.status(plan.presence_evidence(positive, negative)).alias("status"), F.array_join(lines, "|").alias("evidence"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
_REQUIREMENT = f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
e AS (
  SELECT doc_id, s, len(list_filter(s, lambda x: regexp_matches({sql_fold('x')}, '(?:^|[^a-z])the (?:[a-z]+ )?of(?:[^a-z]|$)'))) > 0 AS p,
         list_filter(s, lambda x: regexp_matches({sql_fold('x')}, '(?:idiot|moron|scum)')) AS n FROM s)
SELECT doc_id, CASE WHEN p AND len(n) = 0 THEN 'supported' WHEN len(n) > 0 AND NOT p THEN 'contradicted' ELSE 'unknown' END AS status,
       array_to_string(list_transform(n[1:3], lambda x: substr(x, 1, 240)), '|') AS evidence FROM e
"""


def age_evidence(spark, sf_dir):
    """Numbers of line texts read as ages: whether each stated range includes 12, and whether all agree."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([0-9]{1,3})"), 1).alias("n"))
    ranges = F.transform("n", lambda x: F.when(x.cast("int") <= 120, x.cast("int")))
    ranges = F.filter(ranges, lambda x: x.isNotNull())
    ok = F.size(F.filter("r", lambda x: x <= 12))
    verdict = F.when(F.size("r") == 0, "unknown").when(ok == F.size("r"), "supported").when(ok > 0, "unknown").otherwise("contradicted")
    return docs.where(F.size("n") > 0).withColumn("r", ranges).select("doc_id", F.size("r").cast("long").alias("rules"), verdict.alias("status"))


_AGE = """
WITH n AS (SELECT doc_id, regexp_extract_all(text, '([0-9]{1,3})', 1) AS n FROM documents),
r AS (SELECT doc_id, list_filter(list_transform(n, lambda x: x::INT), lambda x: x <= 120) AS r FROM n WHERE len(n) > 0),
k AS (SELECT doc_id, r, len(list_filter(r, lambda x: x <= 12)) AS ok FROM r)
SELECT doc_id, len(r)::BIGINT AS rules,
       CASE WHEN len(r) = 0 THEN 'unknown' WHEN ok = len(r) THEN 'supported' WHEN ok > 0 THEN 'unknown' ELSE 'contradicted' END AS status FROM k
"""


def category_map(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    label = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 5 == 0, F.lit("Müzik")).when(F.col("event_id") % 5 == 1, "Stand Up ").when(F.col("event_id") % 5 == 2, "ATÖLYELER"))
    return events.select("event_id", text.source_category(label).alias("category"), text.category_key(label).alias("key"))


def _sql_category(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(' ' || {x} || ' ', {q(' ' + p + ' ')}) THEN {q(c)}" for p, c in text.SOURCE_CATEGORIES)
    return f"CASE {cases} END"


_CATEGORY = f"""
WITH l AS (SELECT event_id, {sql_identity("concat_ws(' ', event_type, CASE event_id % 5 WHEN 0 THEN 'Müzik' WHEN 1 THEN 'Stand Up ' WHEN 2 THEN 'ATÖLYELER' END)")} AS k FROM events)
SELECT event_id, {_sql_category('k')} AS category,
       CASE WHEN regexp_matches(' ' || k || ' ', ' (?:konser|muzik) ') THEN 'concert' WHEN regexp_matches(' ' || k || ' ', ' (?:tiyatro|oyun) ') THEN 'theatre'
            WHEN regexp_matches(' ' || k || ' ', ' (?:stand up|standup) ') THEN 'standup' WHEN regexp_matches(' ' || k || ' ', ' (?:atolye|workshop) ') THEN 'workshop' ELSE k END AS key
FROM l
"""


def title_key(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "Konser").when(F.col("p_size") % 3 == 1, "Tiyatro").otherwise("Stand-Up")
    title = F.concat(F.initcap("p_name"), F.when(F.col("p_size") % 3 == 0, " KONSERİ").when(F.col("p_size") % 3 == 1, " Tiyatro Oyunu").otherwise(" Stand-Up"))
    return parts.select("p_partkey", text.title_key(title, kind).alias("key"), text.compact_key(title).alias("compact"), text.identity_hash("part", title, kind).alias("hash"))


_TITLE = f"""
WITH t AS (
  SELECT p_partkey, p_name, p_size % 3 AS m, CASE p_size % 3 WHEN 0 THEN 'Konser' WHEN 1 THEN 'Tiyatro' ELSE 'Stand-Up' END AS kind,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')
      || CASE p_size % 3 WHEN 0 THEN ' KONSERİ' WHEN 1 THEN ' Tiyatro Oyunu' ELSE ' Stand-Up' END AS title FROM part),
k AS (SELECT *, {sql_identity('title')} AS i FROM t)
SELECT p_partkey, CASE m WHEN 0 THEN regexp_replace(i, ' +konseri?$', '') WHEN 1 THEN regexp_replace(i, ' +(?:tiyatro +)?oyunu$', '')
         ELSE regexp_replace(i, ' +stand up$', '') END AS key, replace(i, ' ', '') AS compact, sha256('part' || chr(31) || title || chr(31) || kind) AS hash FROM k
"""


def promotion_price(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("percentage", "fixed", "buy_get", "cashback"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    price = numeric.money(F.col("l_extendedprice") / F.col("l_quantity"))
    tickets = F.col("l_quantity").cast("int")
    qualifying = F.when(F.col("l_orderkey") % 5 != 0, F.floor(tickets / 2).cast("int"))
    fee = F.when(F.col("l_partkey") % 11 != 0, F.lit(2.5))
    cap = F.when(F.col("l_suppkey") % 3 == 0, F.lit(40.0))
    got = numeric.promotion(price, tickets, qualifying, fee, kind, F.lit(3.0), F.lit(1), cap)
    return line.select("l_orderkey", "l_linenumber", kind.alias("kind"), *(r6(got[c], c) for c in ("base_total", "discount", "cashback", "checkout_total")), got["status"].alias("status"), numeric.minor_units(price).alias("minor"))


_PROMOTION = """
WITH i AS (
  SELECT l_orderkey, l_linenumber, ['percentage', 'fixed', 'buy_get', 'cashback'][l_linenumber % 4 + 1] AS kind, floor(l_extendedprice / l_quantity * 100 + 0.5000001::DOUBLE) / 100 AS price,
    l_quantity::INT AS n, CASE WHEN l_orderkey % 5 <> 0 THEN floor(l_quantity::INT / 2.0)::INT END AS qn, CASE WHEN l_partkey % 11 <> 0 THEN 2.5::DOUBLE END AS fee,
    CASE WHEN l_suppkey % 3 = 0 THEN 40.0::DOUBLE END AS cap FROM lineitem),
d AS (
  SELECT *, floor(price * n * 100 + 0.5000001::DOUBLE) / 100 AS base_total, floor(fee * n * 100 + 0.5000001::DOUBLE) / 100 AS fees,
    floor(CASE WHEN cap IS NULL THEN price * qn * 3.0::DOUBLE / 100 ELSE least(price * qn * 3.0::DOUBLE / 100, cap) END * 100 + 0.5000001::DOUBLE) / 100 AS share,
    floor(qn / 4.0::DOUBLE) AS free FROM i),
f AS (
  SELECT *, CASE WHEN qn IS NULL THEN NULL WHEN kind = 'percentage' THEN share
      WHEN kind = 'fixed' THEN floor(CASE WHEN cap IS NULL THEN 3.0::DOUBLE * qn ELSE least(3.0::DOUBLE * qn, cap) END * 100 + 0.5000001::DOUBLE) / 100
      WHEN kind = 'buy_get' THEN floor(price * CASE WHEN cap IS NULL THEN free ELSE least(free, cap) END * 100 + 0.5000001::DOUBLE) / 100 ELSE 0.0::DOUBLE END AS discount,
    CASE WHEN kind = 'cashback' AND qn IS NOT NULL THEN share END AS cashback FROM d)
SELECT l_orderkey, l_linenumber, kind, round(base_total, 6) AS base_total, round(discount, 6) AS discount, round(cashback, 6) AS cashback,
  round(floor((base_total - discount + fees) * 100 + 0.5000001::DOUBLE) / 100, 6) AS checkout_total, CASE WHEN qn IS NULL OR fee IS NULL THEN 'conditional' ELSE 'verified' END AS status,
  round(price * 100, 0)::BIGINT AS minor FROM f
"""


def calendar_dimension(spark, sf_dir):
    """The 120 days from the first order on, with the orders of each."""
    o = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    first = o.agg(F.min("day").cast("string")).first()[0]
    n = o.groupBy("day").agg(F.count("*").alias("orders"))
    days = clock.calendar(spark, first or "1970-01-01", 120).join(n, "day", "left")
    return days.select(F.col("day").cast("string").alias("day"), "offset", "weekday", "nth", "is_last", F.col("week_start").cast("string").alias("week_start"), "weekend", F.coalesce("orders", F.lit(0)).alias("orders"))


_CALENDAR = """
WITH f AS (SELECT min(o_orderdate)::DATE AS first FROM orders), d AS (SELECT (first + i::INT)::DATE AS day, i::INT AS "offset" FROM f, range(120) t(i))
SELECT CAST(day AS VARCHAR) AS day, "offset", isodow(day)::INT AS weekday, ceil(day(day) / 7.0)::INT AS nth, month((day + 7)::DATE) <> month(day) AS is_last,
  CAST((day - (isodow(day) - 1)::INT)::DATE AS VARCHAR) AS week_start, isodow(day) >= 6 AS weekend, (SELECT count(*) FROM orders WHERE o_orderdate::DATE = day) AS orders FROM d
"""


def local_time(spark, sf_dir):
    """Events by local clock hour in the evening."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = clock.local_clock(F.col("ts"))
    return e.where(filters.clock_between(at, "18:00", "22:30", exclusive=True)).select("event_id", clock.local_day(F.col("ts")).alias("day"), at.alias("clock"))


_LOCAL = """
WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul' AS t FROM events)
SELECT event_id, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%H:%M') AS clock FROM l WHERE strftime(t, '%H:%M') > '18:00' AND strftime(t, '%H:%M') < '22:30'
"""


def page_titles_links(spark, sf_dir):
    """Title, number of links and host-relative links of raw pages, and the text without tags."""
    p = load(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return p.select("page_id", text.clean_html(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.size(links).cast("long").alias("links"),
                    F.size(F.filter(links, lambda u: u.startswith("/"))).cast("long").alias("relative"), F.sha2(text.clean_html(F.col("html")), 256).alias("text_hash"))


def _sql_clean(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return rf"trim(regexp_replace({out}, '[\x20\x09-\x0D]+', ' ', 'g'))"


_PAGES = f"""
WITH l AS (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)
SELECT page_id, {_sql_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, len(a)::BIGINT AS links,
       len(list_filter(a, lambda u: starts_with(u, '/')))::BIGINT AS relative, sha256({_sql_clean('html')}) AS text_hash FROM l
"""


def json_props(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", F.from_json("props", "k INT").getField("k").alias("k"), "value")
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), r6(F.avg(F.when(F.col("k") >= 50, F.col("value"))), "mean_high"))


_PROPS = """
SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, round(avg(value) FILTER (k >= 50), 6) AS mean_high
FROM (SELECT event_type, value, (props->>'$.k')::INT AS k FROM events) GROUP BY event_type
"""


def conversation_intent(spark, sf_dir):
    """Turns that ask for alternatives, reset preferences or name a category, by role."""
    c = load(spark, sf_dir, "conversations")
    t = F.concat(F.lit(" "), text.identity_text(F.col("text")), F.lit(" "))
    return c.groupBy("role").agg(
        F.count("*").alias("turns"),
        F.count_if(t.rlike(" (?:baska|alternatif|other|another|else) ")).alias("alternatives"),
        F.count_if(t.rlike(" (?:sifirla|bastan|reset|start over) ")).alias("resets"),
        F.count_if(text.source_category(F.col("text")).isNotNull()).alias("categories"),
        F.max("turn").alias("last_turn"),
    )


_INTENT = f"""
WITH t AS (SELECT *, {sql_identity('text')} AS i FROM conversations)
SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(' ' || i || ' ', ' (?:baska|alternatif|other|another|else) ')) AS alternatives,
  count(*) FILTER (regexp_matches(' ' || i || ' ', ' (?:sifirla|bastan|reset|start over) ')) AS resets,
  count(*) FILTER ({_sql_category('i')} IS NOT NULL) AS categories, max(turn) AS last_turn FROM t GROUP BY role
"""

QUERIES = {
    f.__name__: f
    for f in (
        eligibility_window, filters_budget_date, exclude_production, kleene_plan, plan_atoms, requirement_evidence, age_evidence, category_map,
        title_key, promotion_price, calendar_dimension, local_time, page_titles_links, json_props, conversation_intent,
    )
}
ORACLE = {
    "eligibility_window": _ELIGIBLE, "filters_budget_date": _BUDGET, "exclude_production": _EXCLUDE, "kleene_plan": _KLEENE, "plan_atoms": _ATOMS,
    "requirement_evidence": _REQUIREMENT, "age_evidence": _AGE, "category_map": _CATEGORY, "title_key": _TITLE, "promotion_price": _PROMOTION,
    "calendar_dimension": _CALENDAR, "local_time": _LOCAL, "page_titles_links": _PAGES, "json_props": _PROPS, "conversation_intent": _INTENT,
}
