"""Join shapes, selections and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock, location, numeric, spelling, text
from ..operators import joins, ranking, resolve
from ..operators.scans import scan
from ..scratch import cut
from .base import load, r6, sql_identity


def tolerance_pairs(spark, sf_dir):
    """Clicks and purchases of a user within an hour."""
    e = load(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), "ts")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("ts2"))
    return joins.tolerance_join(a, b, ["user_id"], "ts", "ts2", 3600).select("click", "purchase")


_TOLERANCE = """
SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b USING (user_id)
WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000
"""


def window_overlap(spark, sf_dir):
    """Orders whose ten days from the order overlap fixed admission windows, counted by window."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a1"), F.date_add(F.to_date("o_orderdate"), 10).alias("a2"))
    w = spark.createDataFrame([(i, f"199{3 + i % 5}-0{1 + i % 9}-11") for i in range(20)], "w int, d string")
    w = w.select("w", F.col("d").cast("date").alias("b1"), F.date_add(F.col("d").cast("date"), 4).alias("b2"))
    return joins.overlap_join(o, w, "a1", "a2", "b1", "b2", 14).groupBy("w").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


_OVERLAP = """
WITH w AS (SELECT i::INT AS w, CAST('199' || (3 + i % 5) || '-0' || (1 + i % 9) || '-11' AS DATE) AS b1 FROM range(20) t(i))
SELECT w, count(*) AS n, min(o_orderkey) AS first FROM orders, w
WHERE o_orderdate::DATE <= b1 + 4 AND o_orderdate::DATE + 10 >= b1 GROUP BY 1
"""


def pending_work(spark, sf_dir):
    """The first documents by id whose text has no vector yet, each text once."""
    d, e = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    hashed = d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    done = d.join(e.where("label < 5"), d.doc_id == e.vec_id).select(F.sha2("text", 256).alias("hash"))
    return joins.pending(hashed, done, "hash", ["doc_id"], 25).select("doc_id", "hash")


_PENDING = """
WITH h AS (SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1), d AS (SELECT sha256(text) AS hash FROM documents JOIN embeddings ON vec_id = doc_id WHERE label < 5)
SELECT doc_id, hash FROM h WHERE hash NOT IN (SELECT hash FROM d) ORDER BY doc_id LIMIT 25
"""


def null_safe_changes(spark, sf_dir):
    """Columns that differ between two projections of parts, nulls being equal."""
    p = load(spark, sf_dir, "part")
    a = p.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"), "p_type")
    b = p.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit("Brand#0")).otherwise(F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("p_size"), "p_type")
    return joins.changed(a, b, "p_partkey", ["p_brand", "p_size", "p_type"]).select("p_partkey", F.array_join("columns", ",").alias("columns"))


_CHANGES = """
WITH c AS (SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 7 = 0 AND p_brand IS DISTINCT FROM 'Brand#0' THEN 'p_brand' END,
  CASE WHEN CASE WHEN p_partkey % 5 <> 0 THEN p_size END IS DISTINCT FROM CASE WHEN p_partkey % 10 <> 0 THEN p_size END THEN 'p_size' END) AS columns FROM part)
SELECT * FROM c WHERE columns <> ''
"""


def coverage_check(spark, sf_dir):
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return joins.coverage(o.select(F.col("o_orderkey").alias("k")), line.select(F.col("l_orderkey").alias("k")), "k")


_COVER = """
WITH e AS (SELECT o_orderkey AS k, count(*) AS e FROM orders GROUP BY 1), f AS (SELECT l_orderkey AS k, count(*) AS f FROM lineitem GROUP BY 1),
j AS (SELECT count(e) AS expected, count(f) AS found, count(*) FILTER (f IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected, count(*) FILTER (f > 1) AS repeated FROM e FULL JOIN f USING (k))
SELECT *, missing = 0 AND unexpected = 0 AND repeated = 0 AS exact FROM j
"""


def insert_once(spark, sf_dir):
    """Events of the first half, with those of the second half whose user and kind are new."""
    e = load(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("k"), "ts")
    half = F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00'")
    old = e.where(F.col("ts") < half).select("k").distinct()
    return joins.insert_once(old, e.where(F.col("ts") >= half).select("k"), "k").groupBy(F.substring_index("k", ":", -1).alias("event_type")).agg(F.count("*").alias("users"))


_INSERT = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def spelling_candidates(spark, sf_dir):
    """Name words of parts, misspelt by rule, with the lexicon entries within one edit or swap."""
    words = load(spark, sf_dir, "part").select(F.explode(F.split(text.identity_text(F.col("p_name")), " ")).alias("entry")).distinct()
    n = F.length("entry")
    swapped = F.concat(F.substring(F.col("entry"), 1, 1), F.substring(F.col("entry"), 3, 1), F.substring(F.col("entry"), 2, 1), F.expr("substring(entry, 4)"))
    bad = words.where(n > 3).select(F.explode(F.array(swapped, F.concat("entry", F.lit("x")), F.expr("substring(entry, 2)"))).alias("word"))
    return spelling.candidates(bad, words, "word", "entry").select("word", "entry", "distance")


_SPELLING = f"""
WITH w AS (SELECT DISTINCT unnest(string_split({sql_identity('p_name')}, ' ')) AS entry FROM part),
b AS (SELECT DISTINCT unnest([substr(entry, 1, 1) || substr(entry, 3, 1) || substr(entry, 2, 1) || substr(entry, 4), entry || 'x', substr(entry, 2)]) AS word FROM w WHERE length(entry) > 3)
SELECT word, entry, damerau_levenshtein(word, entry)::INT AS distance FROM b, w WHERE word <> entry AND damerau_levenshtein(word, entry) <= 1
"""


def spelling_suggestions(spark, sf_dir):
    """Words of conversations with the benchmark words that they may have been meant to be, by length, ending and alias."""
    words = lambda df: df.select(F.explode(F.split(text.identity_text(F.col("text")), " ")).alias("w")).distinct()
    lexicon = words(load(spark, sf_dir, "benchmark")).where("length(w) >= 4")
    alias = F.when(F.startswith("w", F.lit("t")), F.array(F.concat("w", F.lit("lar")), F.reverse("w")))
    lexicon = lexicon.select(F.col("w").alias("entry"), F.when(F.length("w") >= 8, "long").when(F.length("w") == 4, "companion").otherwise("short").alias("kind"), alias.alias("aliases"))
    return spelling.suggestions(words(load(spark, sf_dir, "conversations")).select(F.col("w").alias("token")), lexicon)


_ENDS = ", ".join(f"'{s}'" for s in spelling.SUFFIXES)
#: Optimal string alignment by rows, for pairs that the library's distance leaves.
_OSA = """list_reduce(list_prepend({'r': range(0, length(target) + 1), 'b': range(0, length(target) + 1), 'i': 0::BIGINT}, list_transform(range(1, length(form) + 1), lambda i: {'r': []::BIGINT[], 'b': []::BIGINT[], 'i': i})),
  lambda acc, s: {'r': list_reduce(list_prepend([s.i], list_transform(range(1, length(target) + 1), lambda j: [j])), lambda d, jj: list_append(d, least(acc.r[jj[1] + 1] + 1, d[jj[1]] + 1, acc.r[jj[1]] + CASE WHEN form[s.i] = target[jj[1]] THEN 0 ELSE 1 END,
    CASE WHEN s.i > 1 AND jj[1] > 1 AND form[s.i] = target[jj[1] - 1] AND form[s.i - 1] = target[jj[1]] THEN acc.b[jj[1] - 1] + 1 ELSE 99 END))), 'b': acc.r, 'i': s.i}).r[-1]"""
_SUGGESTIONS = f"""
WITH b AS (SELECT DISTINCT unnest(string_split({sql_identity('text')}, ' ')) AS entry FROM benchmark),
l AS (SELECT entry, CASE WHEN length(entry) >= 8 THEN 'long' WHEN length(entry) = 4 THEN 'companion' ELSE 'short' END AS kind FROM b WHERE length(entry) >= 4),
t AS (SELECT entry, kind, entry AS target FROM l UNION SELECT entry, kind, unnest([entry || 'lar', reverse(entry)]) FROM l WHERE starts_with(entry, 't')),
e AS (SELECT *, CASE WHEN length(target) >= 8 THEN 2 WHEN length(target) >= 5 OR kind = 'companion' THEN 1 ELSE 0 END AS most FROM t),
w AS (SELECT DISTINCT unnest(string_split({sql_identity('text')}, ' ')) AS token FROM conversations),
f AS (SELECT token, token AS form FROM w UNION SELECT token, substr(token, 1, length(token) - length(s)) FROM w, (SELECT unnest([{_ENDS}]) AS s) WHERE ends_with(token, s) AND length(token) - length(s) >= 4),
near AS (SELECT * FROM f, e WHERE abs(length(form) - length(target)) <= most AND form <> '' AND CASE WHEN most = 0 THEN form = target ELSE damerau_levenshtein(form, target) <= most END),
met AS (SELECT DISTINCT token, entry, kind FROM near WHERE (form = target AND target <> entry) OR (form <> entry AND {_OSA} <= most))
SELECT token, entry, kind FROM met WHERE NOT EXISTS (SELECT 1 FROM f JOIN l ON l.entry = f.form WHERE f.token = met.token AND l.kind = met.kind)
"""


def earliest_representative(spark, sf_dir):
    """Each recent line with the earliest line of its part."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    first = line.groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("representative"))
    return line.where("l_shipdate >= TIMESTAMP_NTZ '1998-06-01 00:00:00'").join(first, "l_partkey").select("l_orderkey", "l_linenumber", "representative")


_EARLIEST = """
WITH f AS (SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS representative FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, representative FROM lineitem JOIN f USING (l_partkey) WHERE l_shipdate >= TIMESTAMP '1998-06-01'
"""


def stable_partition(spark, sf_dir):
    """Dearest parts with one brand moved behind the others, order kept."""
    p = load(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(60)
    last = (F.col("p_brand") == "Brand#3").cast("int")
    w = Window.orderBy(last, F.desc("p_retailprice"), "p_partkey")  # sixty rows
    return p.select("p_partkey", "p_brand", F.row_number().over(w).cast("long").alias("place"))


_PARTITION = """
WITH p AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60)
SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand = 'Brand#3', p_retailprice DESC, p_partkey) AS place FROM p
"""


def tag_coverage(spark, sf_dir):
    """The first twelve of a ranking, its tail replaced by the first of up to four tags that it lacks."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", ranking.price_order("p_retailprice", "p_partkey").alias("place"))
    first = p.orderBy("place").limit(12)
    best = p.join(first.select("p_brand").distinct(), "p_brand", "left_anti").groupBy("p_brand").agg(F.min("place").alias("place")).orderBy("place").limit(4)
    extra = ranking.ranks_of(best.select(F.col("place.k").alias("p_partkey"), "place"), p, "place").select("p_partkey", "rank")
    n = extra.agg(F.count("*").alias("n"))
    top = first.withColumn("rank", F.row_number().over(Window.orderBy("place")).cast("long"))  # twelve rows
    kept = top.crossJoin(F.broadcast(n)).where("rank <= 12 - n").select("p_partkey", "rank")  # one row
    return kept.unionByName(extra)


_TAGS = """
WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
x AS (SELECT arg_min(p_partkey, r) AS p_partkey, min(r) AS r FROM p WHERE p_brand NOT IN (SELECT p_brand FROM p WHERE r <= 12) GROUP BY p_brand ORDER BY 2 LIMIT 4)
SELECT p_partkey, r AS rank FROM p WHERE r <= 12 - (SELECT count(*) FROM x) UNION ALL SELECT p_partkey, r FROM x
"""


def offer_selection(spark, sf_dir):
    """Per part the offer to show: not returned first, then the preferred suppliers, then the cheapest."""
    line = load(spark, sf_dir, "lineitem")
    price = F.round("l_extendedprice", 2)
    rank = F.struct((F.col("l_returnflag") == "R").alias("a"), (F.col("l_suppkey") % 10 != 1).alias("b"), price.alias("c"), F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("e"))
    return line.groupBy("l_partkey").agg(F.min_by(F.struct("l_orderkey", "l_suppkey", price.alias("price")), rank).alias("o")).select("l_partkey", "o.l_orderkey", "o.l_suppkey", r6(F.col("o.price"), "price"))


_SELECTION = """
SELECT l_partkey, l_orderkey, l_suppkey, round(round(l_extendedprice, 2), 6) AS price FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R', l_suppkey % 10 <> 1, round(l_extendedprice, 2), l_orderkey, l_linenumber) = 1
"""


def time_versions(spark, sf_dir):
    """Pieces of time over which a user's number of fresh observations is constant: from checked - 5 min to
    checked + 72 h each counts, and equal neighbours are one piece."""
    e = load(spark, sf_dir, "events")
    marks = e.select("user_id", F.explode(F.array(F.struct((F.col("ts") - F.expr("INTERVAL 5 MINUTES")).alias("at"), F.lit(1).alias("d")), F.struct((F.col("ts") + F.expr("INTERVAL 72 HOURS")).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    steps = marks.groupBy("user_id", F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"))
    n = scan(steps, "user_id", ["at"], {"n": ("sum", F.col("d"))}, cut)
    pieces = ranking.version_intervals(n.where("d != 0"), "user_id", "at", ["n"], "n")
    return pieces.select("user_id", F.col("at").cast("string").alias("from"), F.col("end").cast("string").alias("to"), F.col("n").alias("fresh"))


_PIECES = """
WITH m AS (SELECT user_id, ts - INTERVAL 5 MINUTE AS t, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 72 HOUR, -1 FROM events),
s AS (SELECT user_id, t, sum(d) AS d FROM m GROUP BY 1, 2 HAVING sum(d) <> 0), n AS (SELECT user_id, t, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS n FROM s)
SELECT user_id, CAST(t AS VARCHAR) AS "from", CAST(lead(t) OVER (PARTITION BY user_id ORDER BY t) AS VARCHAR) AS "to", n::BIGINT AS fresh FROM n
"""


#: Parts of a nation whose pairs are made by different tasks.
PARTS = 16


def pair_decisions(spark, sf_dir):
    """Decision cascade over pairs of suppliers of a nation: same, conflict by balance, or unresolved."""
    s = load(spark, sf_dir, "supplier").withColumn("k", text.compact_key(F.col("s_name")))
    # a nation is dealt to tasks in parts, each of which meets the whole nation
    mine = s.select("s_nationkey", F.pmod(F.hash("s_suppkey"), F.lit(PARTS)).alias("part"), "s_suppkey", "s_acctbal", "k")
    other = s.select("s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("s_suppkey").alias("s_suppkey2"), F.col("s_acctbal").alias("s_acctbal2"), F.col("k").alias("k2"))
    pairs = mine.join(other.hint("shuffle_merge"), ["s_nationkey", "part"]).where("s_suppkey < s_suppkey2")
    gap = F.abs(F.col("s_acctbal") - F.col("s_acctbal2"))
    # one edit leaves at least one half of a name as it is, so the distance is only asked of such pairs
    half = (F.least(F.length("k"), F.length("k2")) / 2).cast("int")
    alike = (F.left("k", half) == F.left("k2", half)) | (F.right("k", half) == F.right("k2", half))
    rule = F.when(gap > 5000, "balance").when(alike & (F.levenshtein("k", "k2", 1) >= 0), "title").when(gap < 100, "seed").otherwise("none")
    ruled = pairs.select("s_suppkey", "s_suppkey2", rule.alias("rule"))
    return ruled.select("s_suppkey", "s_suppkey2", "rule", F.when(F.col("rule") == "balance", "conflict").when(F.col("rule") == "none", "unresolved").otherwise("same").alias("outcome"))


_DECISIONS = f"""
WITH s AS (SELECT *, replace({sql_identity('s_name')}, ' ', '') AS k FROM supplier),
p AS (SELECT a.s_suppkey, b.s_suppkey AS s_suppkey2, CASE WHEN abs(a.s_acctbal - b.s_acctbal) > 5000 THEN 'balance' WHEN levenshtein(a.k, b.k) <= 1 THEN 'title'
  WHEN abs(a.s_acctbal - b.s_acctbal) < 100 THEN 'seed' END AS r FROM s a JOIN s b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey)
SELECT s_suppkey, s_suppkey2, coalesce(r, 'none') AS rule, CASE WHEN r = 'balance' THEN 'conflict' WHEN r IS NOT NULL THEN 'same' ELSE 'unresolved' END AS outcome FROM p
"""


def plan_kind_prf(spark, sf_dir):
    """Expected and found (key, kind) signatures by kind: true and false positives, misses."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    sig = lambda kind, c: j.where(c).select("doc_id", F.lit(kind).alias("kind"))
    want = sig("good", "quality = 1").unionByName(sig("toxic", "toxic = 1"))
    said = sig("good", "n_chars >= 500").unionByName(sig("toxic", F.lower("text").rlike("idiot|moron|scum")))
    both = want.withColumn("w", F.lit(1)).join(said.withColumn("s", F.lit(1)), ["doc_id", "kind"], "full_outer")
    return both.groupBy("kind").agg(F.count_if(F.col("w").isNotNull() & F.col("s").isNotNull()).alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"), F.count_if(F.col("s").isNull()).alias("fn"))


_PRF = """
WITH j AS (SELECT * FROM documents JOIN labels USING (doc_id)),
k AS (SELECT 'good' AS kind, quality = 1 AS w, n_chars >= 500 AS s FROM j UNION ALL SELECT 'toxic', toxic = 1, regexp_matches(lower(text), 'idiot|moron|scum') FROM j)
SELECT kind, count(*) FILTER (w AND s) AS tp, count(*) FILTER (s AND NOT w) AS fp, count(*) FILTER (w AND NOT s) AS fn FROM k GROUP BY 1
"""


def contamination_audit(spark, sf_dir):
    """Sentences that documents share with benchmark items."""
    parts = lambda df, key: df.select(key, F.explode(text.sentences(F.col("text"))).alias("s")).where("length(s) >= 40").distinct()
    d, b = parts(load(spark, sf_dir, "documents"), "doc_id"), parts(load(spark, sf_dir, "benchmark"), "item_id")
    return d.join(b, "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


_AUDIT = r"""
WITH d AS (SELECT DISTINCT doc_id, trim(unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)))) AS s FROM documents),
b AS (SELECT DISTINCT item_id, trim(unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)))) AS s FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) WHERE length(s) >= 40 GROUP BY 1, 2
"""


def month_periods(spark, sf_dir):
    """Early, mid and late days of order months with their number of orders."""
    o = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.to_date("o_orderdate").alias("day"))
    part = F.when(F.dayofmonth("day") <= 10, "early").when(F.dayofmonth("day") <= 20, "mid").otherwise("late")
    first, last = clock.month_thirds(F.col("y"), F.col("m"), F.col("part"))
    g = o.withColumn("part", part).groupBy("y", "m", "part").agg(F.count("*").alias("n"))
    return g.select(first.cast("string").alias("first"), last.cast("string").alias("last"), "part", "n")


_PERIODS = """
WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, CASE WHEN day(o_orderdate) <= 10 THEN 'early' WHEN day(o_orderdate) <= 20 THEN 'mid' ELSE 'late' END AS part, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(m + CASE part WHEN 'mid' THEN 10 WHEN 'late' THEN 20 ELSE 0 END AS VARCHAR) AS first,
  CAST(CASE part WHEN 'early' THEN m + 9 WHEN 'mid' THEN m + 19 ELSE last_day(m) END AS VARCHAR) AS last, part, n FROM g
"""


def money_values(spark, sf_dir):
    """Prices written in four ways and read back."""
    p = load(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole, rest = (F.floor(cents / 100)).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    dotted = F.regexp_replace(whole, r"(\d)(\d{3})$", "$1.$2")
    said = F.when(F.col("p_partkey") % 4 == 0, F.concat(dotted, F.lit(","), rest, F.lit(" TL"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.translate(dotted, ".", ","), F.lit("."), rest)).when(F.col("p_partkey") % 4 == 2, F.concat(F.floor(cents / 100000).cast("string"), F.lit(" bin"))).otherwise(F.lit("çok"))
    return p.select("p_partkey", r6(numeric.parse_money(said), "amount"))


_MONEY = """
WITH c AS (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS cents FROM part)
SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN cents / 100.0::DOUBLE WHEN 1 THEN cents / 100.0::DOUBLE WHEN 2 THEN (cents // 100000) * 1000.0::DOUBLE END, 6) AS amount FROM c
"""


def url_parts(spark, sf_dir):
    """Allowed detail urls of pages: host, last path part, whether a tracking parameter was dropped."""
    p = load(spark, sf_dir, "pages")
    host, path, query = (F.parse_url("url", F.lit(x)) for x in ("HOST", "PATH", "QUERY"))
    ok = F.col("url").startswith("https://") & ~host.rlike(r"(^|\.)ads-")
    return p.where(ok).select("page_id", host.alias("host"), F.regexp_extract(path, r"([0-9]+)(?:\.html)?/?$", 1).alias("item"), F.coalesce(query.rlike("(^|&)utm_"), F.lit(False)).alias("tracked"))


_URL = r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['h', 'p', 'q']) AS x FROM pages)
SELECT page_id, x.h AS host, regexp_extract(x.p, '([0-9]+)(?:\.html)?/?$', 1) AS item, regexp_matches(x.q, '[?&]utm_') AS tracked FROM u
WHERE starts_with(url, 'https://') AND NOT regexp_matches(x.h, '(^|\.)ads-')
"""


def address_districts(spark, sf_dir):
    """Districts read from made-up addresses of customers."""
    c = load(spark, sf_dir, "customer")
    names = F.array(*map(F.lit, ("Kadıköy", "ŞİŞLİ", "Beyoğlu", "Üsküdar", "Nowhere")))
    at = F.concat(F.col("c_name"), F.lit(" Sok. "), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")), F.when(F.col("c_custkey") % 3 == 0, "/İstanbul").when(F.col("c_custkey") % 3 == 1, "").otherwise(" Mah. No 3"))
    return c.groupBy(F.coalesce(location.address_place(at, text.DISTRICTS), F.lit("none")).alias("district")).agg(F.count("*").alias("n"))


_DISTRICTS = """
SELECT CASE WHEN c_custkey % 3 = 2 OR c_custkey % 5 = 4 THEN 'none' ELSE ['kadikoy', 'sisli', 'beyoglu', 'uskudar'][c_custkey % 5 + 1] END AS district, count(*) AS n
FROM customer GROUP BY 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        tolerance_pairs, window_overlap, pending_work, null_safe_changes, coverage_check, insert_once, spelling_candidates, spelling_suggestions, earliest_representative,
        stable_partition, tag_coverage, offer_selection, time_versions, pair_decisions, plan_kind_prf, contamination_audit, month_periods, money_values,
        url_parts, address_districts,
    )
}
ORACLE = {
    "tolerance_pairs": _TOLERANCE, "window_overlap": _OVERLAP, "pending_work": _PENDING, "null_safe_changes": _CHANGES, "coverage_check": _COVER, "insert_once": _INSERT,
    "spelling_candidates": _SPELLING, "spelling_suggestions": _SUGGESTIONS, "earliest_representative": _EARLIEST, "stable_partition": _PARTITION, "tag_coverage": _TAGS, "offer_selection": _SELECTION,
    "time_versions": _PIECES, "pair_decisions": _DECISIONS, "plan_kind_prf": _PRF, "contamination_audit": _AUDIT, "month_periods": _PERIODS, "money_values": _MONEY,
    "url_parts": _URL, "address_districts": _DISTRICTS,
}
