"""Evidence queries: age rules, schedule gate, attendance, grades that contradict themselves, two orders without repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence
from ..operators import ranking
from .base import load

#: (description, the rule that it states: low, high, denied; or none).
_SAID = (
    ("Yaş sınırı: 6+", (6, 120, False)), ("Yaş aralığı 4 - 10 yaş.", (4, 10, False)), ("Age limit: 16 and over", (16, 120, False)), ("12 yaş sınırı vardır", (12, 120, False)),
    ("5-9 yaş arası çocuklar için", (5, 9, False)), ("7 yaş ve üzeri çocuklar için uygundur", (7, 120, False)), ("Recommended for children aged 8 or older", (8, 120, False)),
    ("Great show. All ages", (0, 120, False)), ("Yaş sınırı yoktur", (0, 120, False)), ("Yetişkinlere özel", (18, 120, False)), ("Not adults only", (18, 120, True)),
    ("Yaş sınırı: 6+ geçerli değildir", (6, 120, True)), ("30 years on stage, 250 songs", None), ("", None),
)


def age_rules(spark, sf_dir):
    """Orders with two of fourteen descriptions, asked for an age: the rules they state and whether they fit."""
    o = load(spark, sf_dir, "orders")
    said = F.array(*(F.lit(t) for t, _ in _SAID))
    pick = lambda n: F.element_at(said, (F.expr(n) % len(_SAID) + 1).cast("int"))
    told = o.select("o_orderkey", F.concat_ws(". ", pick("o_orderkey"), pick("o_orderkey div 14")).alias("text"), (F.col("o_orderkey") % 37).cast("int").alias("years"))
    told = told.select("o_orderkey", "years", evidence.age_rules(F.col("text")).alias("rules"))
    return told.select("o_orderkey", "years", F.size("rules").cast("long").alias("n_rules"), evidence.age_status(F.col("rules"), F.col("years")).alias("status"))


_rule = lambda r: f"{{'low': {r[0]}, 'high': {r[1]}, 'denied': {str(r[2]).lower()}}}" if r else "{'low': NULL, 'high': NULL, 'denied': NULL}"
_AGES = f"""
WITH s AS (SELECT [{', '.join(_rule(r) for _, r in _SAID)}] AS said),
r AS (SELECT o_orderkey, (o_orderkey % 37)::INT AS years, list_filter([said[o_orderkey % 14 + 1], said[o_orderkey // 14 % 14 + 1]], lambda x: x.low IS NOT NULL) AS rules FROM orders, s),
f AS (SELECT *, len(list_filter(rules, lambda x: years >= x.low AND years <= x.high)) AS fits, len(list_filter(rules, lambda x: x.denied)) AS denied FROM r)
SELECT o_orderkey, years, len(rules)::BIGINT AS n_rules, CASE WHEN len(rules) = 0 OR denied > 0 THEN 'unknown' WHEN fits = len(rules) THEN 'supported' WHEN fits > 0 THEN 'unknown' ELSE 'contradicted' END AS status FROM f
"""


def schedule_gates(spark, sf_dir):
    """Orders as collection requests: whether each may run, and why."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ahead = F.date_format(F.expr("TIMESTAMP '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(o_orderkey % 150 - 30 AS INT))"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    until = F.when(k % 11 == 0, "open").when(k % 11 == 1, "2026-02-30T00:00:00.000Z").when(k % 11 == 2, "2026-01-02").when(k % 11 == 3, None).otherwise(ahead)
    event = F.when(k % 7 == 0, "workflow_dispatch").when(k % 7 == 1, "push").otherwise("schedule")
    gate = evidence.schedule_gate(event, F.when(k % 5 != 0, "true").otherwise("false"), until, F.expr("TIMESTAMP '2026-01-01 00:00:00'"))
    return o.select("o_orderkey", gate.alias("g")).select("o_orderkey", "g.run", "g.reason")


_GATES = """
WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'manual' WHEN o_orderkey % 7 = 1 THEN 'unsupported_event' WHEN o_orderkey % 5 = 0 THEN 'disabled' WHEN o_orderkey % 11 = 0 THEN 'open_schedule'
    WHEN o_orderkey % 11 IN (1, 2, 3) THEN 'invalid_deadline' WHEN o_orderkey % 150 - 30 <= 0 THEN 'expired' WHEN o_orderkey % 150 - 30 > 60 THEN 'window_exceeds_60h' ELSE 'scheduled_window' END AS reason FROM orders)
SELECT o_orderkey, reason IN ('manual', 'open_schedule', 'scheduled_window') AS run, reason FROM g
"""


def attendance_kinds(spark, sf_dir):
    """Orders as listings whose lines are performances: what their attendance is said to be."""
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    starts = line.groupBy("l_orderkey").agg(F.collect_list((F.col("l_shipdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(l_linenumber AS INT))"))).alias("starts"))
    j = o.join(starts, o.o_orderkey == starts.l_orderkey, "left")
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, "Seans saatinden sonra geç kalan alınmaz.").otherwise("Seanslar hakkında")
    kind = evidence.attendance_timing(F.when(k % 3 == 0, "Konser").otherwise("Sergi"), text, k % 5 == 0, F.col("o_orderdate"), F.when(k % 10 == 0, F.col("o_orderdate")).otherwise(F.lit("1990-01-01").cast("timestamp_ntz")), F.coalesce("starts", F.array().cast("array<timestamp>")))
    return j.select("o_orderkey", kind.alias("kind"))


_KINDS = """
WITH s AS (SELECT DISTINCT l_orderkey, l_shipdate + to_hours(l_linenumber) + INTERVAL 3 HOUR AS moment FROM lineitem), d AS (SELECT l_orderkey, count(*) > count(DISTINCT moment::DATE) AS several FROM s GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 10 = 0 THEN 'admission_window' ELSE 'unknown' END WHEN o_orderkey % 3 = 0 THEN NULL
  WHEN several AND o_orderkey % 2 = 0 THEN 'timed_session' ELSE 'unknown' END AS kind FROM orders LEFT JOIN d ON l_orderkey = o_orderkey
"""


def grade_faults(spark, sf_dir):
    """Vectors read as distributions over four grades, some of them bent: what contradicts what, and who has support."""
    e = load(spark, sf_dir, "embeddings")
    sq = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * x.cast("double"))
    total = F.aggregate(sq, F.lit(0.0), lambda s, x: s + x)
    k = F.col("vec_id")
    d = e.select("vec_id", sq.alias("sq"), total.alias("t")).where("t > 0").select("vec_id", F.transform("sq", lambda x: x / F.col("t") * F.when(k % 7 == 0, 1.1).otherwise(1.0)).alias("p"))
    expected = F.col("p")[1] + 2 * F.col("p")[2] + 3 * F.col("p")[3]
    support = F.col("p")[2] + F.col("p")[3]
    j = d.withColumns({"score": F.when(k % 11 == 0, F.lit(3.5)).when(k % 5 == 0, expected + 0.06).otherwise(expected), "support": F.when(k % 13 == 0, support - 0.01).otherwise(support)})
    fault = evidence.distribution_fault(F.col("p"), F.col("score"), F.col("support"))
    return j.select("vec_id", fault.alias("fault"), (fault.isNull() & (F.col("support") >= evidence.LEAST_SUPPORT)).alias("supported"))


_GRADES = """
WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE * x::DOUBLE) AS q FROM embeddings), t AS (SELECT *, q[1] + q[2] + q[3] + q[4] AS t FROM e),
p AS (SELECT vec_id, list_transform(q, lambda x: x / t * CASE WHEN vec_id % 7 = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS p FROM t WHERE t > 0),
f AS (SELECT vec_id, p[3] + p[4] AS support, CASE WHEN list_max(p) > 1 THEN 'probabilities' WHEN vec_id % 7 = 0 THEN 'sum' WHEN vec_id % 11 = 0 THEN 'score'
    WHEN vec_id % 5 = 0 THEN CASE WHEN p[2] + 2 * p[3] + 3 * p[4] + 0.06 > 3 THEN 'score' ELSE 'score_contradicts_probabilities' END WHEN vec_id % 13 = 0 THEN 'support' END AS fault FROM p)
SELECT vec_id, fault, fault IS NULL AND support >= 0.7 AS supported FROM f
"""


def interleave_shows(spark, sf_dir):
    """Soonest and dearest orders dealt in turn, each customer and each day once."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderdate", "o_totalprice")
    out = ranking.interleave_unique(o, [F.asc("o_orderdate"), F.asc("o_orderkey")], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderkey", ["o_custkey", "month"], 40)
    return out.select("o_orderkey", F.col("position").cast("long").alias("position"))


_SHOWS = """
WITH RECURSIVE r AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS month, 2 * row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders
  UNION ALL SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m'), 2 * row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) FROM orders),
g(n, customers, months, id, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], NULL::BIGINT, 0
  UNION ALL
  SELECT r.n, CASE WHEN ok THEN list_append(customers, o_custkey) ELSE customers END, CASE WHEN ok THEN list_append(months, month) ELSE months END, CASE WHEN ok THEN o_orderkey END, taken + ok::INT
  FROM (SELECT r.*, g.customers, g.months, g.taken, NOT list_contains(customers, o_custkey) AND NOT list_contains(months, month) AS ok FROM g JOIN r ON r.n = g.n + 1 WHERE taken < 40) r)
SELECT id AS o_orderkey, n AS position FROM g WHERE id IS NOT NULL
"""

#: (title, description, the format it states, whether it is for children).
_TOLD = (
    ("Mum", "Mum atölyesi: katılımcılar kendi mumunu yapacak. Canlı konser de var", "Workshop", False), ("Gece", "Canlı konser ve ardından söyleşi", None, False), ("Panel", "Seminer: moderatör eşliğinde. Kurs", "Söyleşi", False),
    ("Resim", "Yeni dönem kurs kayıtları", "Eğitim", False), ("Ali Veli", "Ali Veli Stand Up Show sahnede", "Stand-up", False), ("Haliç", "Profesyonel rehberle tur boyunca kiliseler ziyaret edilir", "Gezi", False),
    ("Yaz Konseri", "", "Konser", False), ("Çocuk Oyunu", "Çocuklar için", "Tiyatro", True), ("Akşam", "Çocuklar için uygun değildir", None, False), ("Seramik Atölyesi", "Canlı konser", None, False), ("Seramik Workshop", None, "Workshop", False),
    ("Sirk", "4 - 9 yaş arası tüm çocuklar", None, True), ("Kids Show", "Not for adults", None, True),
)


def program_formats(spark, sf_dir):
    """Orders with made-up titles and texts: the format that they state themselves, and whether children are meant."""
    o = load(spark, sf_dir, "orders")
    pick = lambda n: F.element_at(F.array(*(F.lit(t[n]) for t in _TOLD)), (F.col("o_orderkey") % len(_TOLD) + 1).cast("int"))
    return o.select("o_orderkey", evidence.program_format(pick(0), pick(1)).alias("format"), evidence.child_audience(pick(0), pick(1)).alias("children"))


_FORMATS = f"""
SELECT o_orderkey, [{', '.join("NULL" if t[2] is None else f"'{t[2]}'" for t in _TOLD)}][o_orderkey % {len(_TOLD)} + 1] AS format, [{', '.join(str(t[3]).lower() for t in _TOLD)}][o_orderkey % {len(_TOLD)} + 1] AS children FROM orders
"""


def district_veto(spark, sf_dir):
    """Orders as listings with a label, an address and a venue: which lie in Kadıköy."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    label = F.when(k % 4 == 0, "Kadıköy").when(k % 4 == 1, "Beşiktaş").when(k % 4 == 2, "İstanbul Anadolu").otherwise(None)
    address = F.when(k % 3 == 0, "Moda Cd. 5, Kadıköy/İstanbul").when(k % 3 == 1, "Barbaros Blv., Beşiktaş/İstanbul").otherwise("")
    venue = F.when(k % 5 == 0, "Kadıköy Sahnesi").otherwise("Kadıköylü Sahne")
    return o.where(evidence.in_district(label, address, venue, "kadikoy")).select("o_orderkey")


_VETO = """
SELECT o_orderkey FROM orders WHERE CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 3 <> 1 WHEN 1 THEN false
  ELSE CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderkey % 5 = 0 END END
"""


def listing_conflicts(spark, sf_dir):
    """Orders as listings whose text names another venue for their date, or says that they are sold out."""
    o = load(spark, sf_dir, "orders")
    k, date = F.col("o_orderkey"), evidence.day_month(F.col("o_orderdate").cast("timestamp"))
    title, venue = F.lit("Uzun İnce Bir Yol"), F.when(k % 3 == 0, "Moda Sahnesi").otherwise("Zorlu PSM")
    other = F.when(k % 2 == 0, date).otherwise("31 şubat")
    text = F.when(k % 5 < 2, F.concat(title, F.lit(" konseri "), other, F.lit(" Cuma günü Zorlu Salonu'nda"))).when(
        k % 5 < 4, F.concat(title, F.lit(". "), other, F.lit(" de "), venue, F.lit("'nde gerçekleşecek. "), other, F.lit(" "), venue, F.lit(" da gerçekleşecek İstanbul konserinin biletleri tükendi"))).otherwise(None)
    start, city = F.col("o_orderdate").cast("timestamp"), F.when(k % 7 == 0, "Ankara").otherwise("İstanbul")
    return o.select(
        "o_orderkey", evidence.venue_conflict(title, text, start, venue, city).alias("venue"),
        evidence.sold_out_conflict(title, text, start, venue, city, F.when(k % 11 == 0, "sold_out").otherwise("available")).alias("sold_out"),
    )


_CONFLICTS = """
SELECT o_orderkey, o_orderkey % 5 < 2 AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AS venue,
  o_orderkey % 5 IN (2, 3) AND o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS sold_out FROM orders
"""

QUERIES = {f.__name__: f for f in (program_formats, district_veto, listing_conflicts, age_rules, schedule_gates, attendance_kinds, grade_faults, interleave_shows)}
ORACLE = {"program_formats": _FORMATS, "district_veto": _VETO, "listing_conflicts": _CONFLICTS, "age_rules": _AGES, "schedule_gates": _GATES, "attendance_kinds": _KINDS, "grade_faults": _GRADES, "interleave_shows": _SHOWS}
