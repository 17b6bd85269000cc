"""Domain rules on small tables: text, conditions, observation logs, clusters, sources, streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from eventloom.scratch import cut
from eventloom.functions import clock, location, numeric, spelling, text
from eventloom.operators import filters, joins, ranking, resolve, revisions
from eventloom.plans import conditions as plan
from eventloom.sources import jsonld, publication
from eventloom.streaming import streams


def values(spark, function, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, v string")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_fold_turkish_and_marks(spark):
    assert values(spark, text.fold, ["İSTANBUL Işık", "ĞÜŞÖÇ âîû", "éa", "Ñandú", "ß"]) == ["istanbul isik", "gusoc aiu", "ea", "nandu", "ß"]
    assert values(spark, text.identity_text, ["  Çay—Bahçesi! 2 ", None, "…"]) == ["cay bahcesi 2", "", ""]
    assert values(spark, text.compact_key, ["Zorlu PSM"]) == ["zorlupsm"]
    assert values(spark, text.search_tokens, ["Bir caz caz ve AŞK için ev", None]) == [["caz", "caz", "ask"], []]


def test_titles_categories_districts(spark):
    df = spark.createDataFrame([("Büyük Ev Ablukada Konseri", "Konser"), ("Konser", "Müzik"), ("Hamlet Tiyatro Oyunu", "TİYATRO"), ("Deniz Stand-Up", "stand up"), ("X Konseri", "Tiyatro")], "t string, c string")
    assert [r.k for r in df.select(text.title_key(F.col("t"), F.col("c")).alias("k")).collect()] == ["buyuk ev ablukada", "konser", "hamlet", "deniz", "x konseri"]
    assert values(spark, text.source_category, ["Stand-Up", "ATÖLYELER", "Rock Müzik", "Turizm", None]) == ["Stand-up", "Workshop", "Konser", None, None]
    assert values(spark, lambda c: location.address_place(c, text.DISTRICTS), ["Moda Cd. Kadıköy/İstanbul", "Kadıköy", "Şişli Beyoğlu", "Kadıköy/İstanbul, Şişli/İstanbul", "Silem", None]) == ["kadikoy", "kadikoy", "beyoglu", None, None, None]


def test_sentences_and_cleaning(spark):
    assert values(spark, text.sentences, ["One. Two!  Three?\nFour", "", None]) == [["One.", "Two!", "Three?", "Four"], [], []]
    assert values(spark, text.clean_html, ["<p>A&amp;lt; &nbsp; B</p><br>", None]) == ["A&lt; B", ""]
    lines = values(spark, lambda c: text.evidence_lines(c, "kopek"), ["Köpek girer. Kedi. " + "köpek " * 80 + ". KÖPEK. köpek!"])[0]
    assert len(lines) == 3 and lines[0] == "Köpek girer." and len(lines[1]) == 240


def test_money_and_vectors(spark):
    assert values(spark, numeric.parse_money, ["1.250,50 TL", "1,250.50", "2 bin", "3k", "99", "1.2.3", "x", None]) == [1250.5, 1250.5, 2000.0, 3000.0, 99.0, None, None, None]
    df = spark.createDataFrame([(0.125,), (1.005,), (None,), (float("nan"),)], "v double")
    assert [r.m for r in df.select(numeric.minor_units(F.col("v")).alias("m")).collect()] == [None, None, None, None]
    assert spark.range(1).select(numeric.minor_units(F.lit(12.34)).alias("m")).first().m == 1234
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],)], "v array<float>")
    assert [r.x for r in v.select(numeric.valid_vector(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False]
    a = F.array(F.lit(1.0), F.lit(1.0))
    assert spark.range(1).select(numeric.cosine(a, F.array(F.lit(2.0), F.lit(0.0)))).first()[0] == pytest.approx(0.70710678)
    assert spark.range(1).select(numeric.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 0


def test_calendar_and_days(spark):
    assert values(spark, clock.valid_day, ["2024-02-29", "2023-02-29", "2024-2-1", None]) == [True, False, False, False]
    days = {str(r.day): r for r in clock.calendar(spark, "2024-01-29", 40).collect()}
    assert days["2024-02-29"].nth == 5 and days["2024-02-29"].is_last and days["2024-02-03"].weekend and str(days["2024-02-01"].week_start) == "2024-01-29"
    row = spark.range(1).select(*clock.month_thirds(F.lit(2024), F.lit(2), F.lit("late"))).first()
    assert [str(x) for x in row] == ["2024-02-21", "2024-02-29"]


def osa(a, b):
    """Optimal string alignment by the whole table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_and_candidates(spark):
    rng = random.Random(3)
    pairs = [("abcd", "abdc"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("", ""), ("same", "same")] + [("".join(rng.choice("abc") for _ in range(rng.randrange(7))), "".join(rng.choice("abc") for _ in range(rng.randrange(7)))) for _ in range(200)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.d == osa(r.a, r.b) for r in frame.select("a", "b", spelling.osa_distance(F.col("a"), F.col("b")).alias("d")).collect())
    lexicon = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(60)}
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(60)}
    frame = lambda x, n: spark.createDataFrame([(w,) for w in sorted(x)], f"{n} string")
    got = {(r.word, r.entry, r.distance) for r in spelling.candidates(frame(words, "word"), frame(lexicon, "entry"), "word", "entry").collect()}
    assert got == {(w, e, 1) for w in words for e in lexicon if w != e and osa(w, e) == 1}
    got = {(r.word, r.entry, r.distance) for r in spelling.candidates(frame(words, "word"), frame(lexicon, "entry"), "word", "entry", 2).collect()}
    assert got == {(w, e, osa(w, e)) for w in words for e in lexicon if w != e and osa(w, e) <= 2}


def test_suggestions_by_length_ending_and_alias(spark):
    lexicon = spark.createDataFrame([("tiyatro", "category", ["oyun"]), ("beyoglu", "district", None), ("yalniz", "companion", None), ("cift", "companion", None), ("komedi", "mood", None), ("festivaller", "category", None), ("caz", "mood", None)], "entry string, kind string, aliases array<string>")
    words = ["tiytaro", "oyun", "oyum", "beyogluda", "beyoglunda", "beyogludan", "bejoglunda", "cfit", "cif", "fesivaler", "komed", "caz", "cax", "tiyatro", None]
    got = {(r.token, r.entry) for r in spelling.suggestions(spark.createDataFrame([(w,) for w in words], "token string"), lexicon).collect()}
    assert got == {("tiytaro", "tiyatro"), ("oyun", "tiyatro"), ("bejoglunda", "beyoglu"), ("cfit", "cift"), ("cif", "cift"), ("fesivaler", "festivaller"), ("komed", "komedi")}


def test_near_pairs_of_a_block(spark):
    rows = [(1, "x", "abc"), (2, "x", "abd"), (3, "x", "abc"), (4, "x", "zzz"), (5, "y", "abc"), (6, "x", "ab")]
    got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame(rows, "id int, b string, t string"), ["b"], "id", "t").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 6), (2, 6), (3, 6)}


def test_kleene_truth_tables(spark):
    df = spark.createDataFrame(list(itertools.product([True, False, None], repeat=2)), "a boolean, b boolean")
    rules = {"col": lambda c: F.col(c), "topic": lambda c: F.col(c)}
    a, b = plan.Atom("col", ("a",)), plan.Atom("col", ("b",))
    rank = {True: 2, None: 1, False: 0}
    back = {v: k for k, v in rank.items()}
    for r in df.select("a", "b", *(plan.compile_condition(c, rules).alias(n) for n, c in (("all_", plan.All((a, b))), ("any_", plan.Any((a, b))), ("not_", plan.Not(a)), ("none", plan.All())))).collect():
        assert r.all_ == back[min(rank[r.a], rank[r.b])] and r.any_ == back[max(rank[r.a], rank[r.b])]
        assert r.not_ == (None if r.a is None else not r.a) and r.none is True
    topic = plan.Atom("topic", ("a",))
    for r in df.select("a", plan.compile_condition(plan.Not(topic), rules).alias("n"), plan.compile_condition(plan.Not(plan.Not(topic)), rules).alias("nn"), plan.compile_condition(topic, rules).alias("t")).collect():
        assert r.n == (not r.a) and r.t == r.a and r.nn == r.a  # closed world under an odd number of negations
    with pytest.raises(ValueError):
        plan.compile_condition(plan.Any(), rules)
    with pytest.raises(ValueError):
        plan.compile_condition(plan.Atom("x"), rules)


def test_plan_evidence_of_time_place_and_audience(spark):
    rows = [
        (1, "2026-03-07 17:30:00", "Belirtilen saat, kapı açılış saatidir", "Kadıköy", None, None),
        (2, "2026-03-07 17:30:00", None, "Kadıköy", None, None),
        (3, "2026-03-07 15:00:00", "x", None, "Şişli", None),
        (4, None, "x", None, None, "online"),
        (5, "2026-03-07 16:00:00", "Açıkhava", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, ts string, d string, label string, labelled string, place string").withColumn("ts", F.to_timestamp("ts"))
    time = plan.time_evidence(F.col("ts"), F.col("d"))
    where = plan.location_evidence(F.col("label"), F.lit(None).cast("string"), F.col("labelled"), F.col("place"))
    no = F.lit(None).cast("double")
    out = plan.experience_evidence([F.col("d")], {}, no, no)
    got = df.select(
        "id", time("18:00", None).alias("open"), time("19:00", "20:30", False, True).alias("before"), time("18:00", "20:30").alias("upto"),
        where("district", "Kadıköy").alias("district"), where("side", "Avrupa Yakası").alias("side"), where("neighborhood", "Moda").alias("near"),
        out("outdoors").alias("outdoors"), out("romantic").alias("romantic"), plan.context_evidence(4).alias("party"),
    ).orderBy("id").collect()
    assert [r.open for r in got] == [None, True, True, None, True]
    assert [r.before for r in got] == [None, False, False, None, True]
    assert [r.upto for r in got] == [None, True, True, None, True]
    assert [r.district for r in got] == [True, True, False, False, None]
    assert [r.side for r in got] == [False, False, True, False, None]
    assert [r.near for r in got] == [None, None, None, False, None]
    assert [r.outdoors for r in got] == [None, None, None, None, True]
    assert all(r.romantic is None and r.party for r in got)


def test_number_words_labels_and_dates(spark):
    said = {
        "yüz": 100, "iki yüz elli": 250, "on iki yüz": 1200, "bin": 1000, "yirmi beş bin üç yüz": 25300, "one hundred thousand": 100000, "Twelve": 12, "sıfır": 0, "bin sıfır": 1000,
        "yirmi yüz": None, "sıfır bin": None, "yüz yüz": None, "bin bin": None, "bes on": None, "iki üç": None, "iki yüz bin": None, "elma": None, "yüz elma": None, "": None, None: None,
    }
    assert values(spark, numeric.word_number, list(said)) == list(said.values())
    df = spark.createDataFrame([(1, {"a": 0.7, "b": 0.3}), (2, {"a": 0.6, "b": 0.5}), (3, {"a": 0.5}), (4, {"b": 1.0}), (5, {}), (6, None)], "i int, p map<string,double>")
    assert [r.k for r in df.select("i", numeric.confident_label(F.col("p")).alias("k")).orderBy("i").collect()] == ["a", None, None, "b", None, None]
    at = lambda f: lambda c: f(F.to_timestamp(c))
    assert values(spark, at(clock.day_label), ["2026-03-06 22:00:00", None]) == ["7 Mart 2026", None]
    assert values(spark, at(clock.session_label), ["2026-03-07 17:30:00", None]) == ["7 Mart Cmt 20:30", None]


def test_soft_signals(spark):
    df = spark.createDataFrame([(80.0,), (120.0,), (200.0,), (None,)], "p double")
    got = df.select(plan.budget_signal(F.col("p"), "lte", 100.0).alias("l"), plan.budget_signal(F.col("p"), "approx", 100.0).alias("a"), plan.soft_signal([F.lit(None).cast("double")]).alias("z")).collect()
    assert [round(r.l, 6) for r in got] == [1.0, -0.4, -1.0, 0.0] and [r.a for r in got] == [1.0, 1.0, -1.0, 0.0] and all(r.z == 0 for r in got)


def test_freshness_bounds(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    times = ["2024-01-07 12:00:00", "2024-01-07 11:59:59.999", "2024-01-10 12:05:00", "2024-01-10 12:05:00.001", None]
    assert values(spark, lambda c: filters.fresh(c.cast("timestamp_ntz"), now), times) == [True, False, True, False, None]
    prices = spark.createDataFrame([(10.0,), (9.0,), (None,)], "p double")
    assert [r[0] for r in prices.select(filters.within_price(F.col("p"), 10.0, True)).collect()] == [False, True, False]
    assert values(spark, lambda c: filters.without_term(c, "caz"), ["bir caz gecesi", "caz degil rock", "cazip", "rock"]) == [False, True, True, True]


def test_page_heads_and_inheritance(spark):
    rows = [("k", 1, 10, "a"), ("k", 2, 10, "a"), ("k", 3, 10, "b"), ("k", 4, 9, "b"), ("k", 5, 11, "b"), ("j", 6, 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, c int, x string")
    got = {r.n: r.verdict for r in revisions.page_heads(df, "k", "c", "x", "n").collect()}
    assert got == {1: "accepted", 2: "same", 3: "held", 4: "stale", 5: "accepted", 6: "accepted"}
    assert {r.n: r.y for r in revisions.inherit(df.withColumn("v", F.when(F.col("n") == 2, 7)), "k", ["n"], "v", "y").collect()} == {1: None, 2: 7, 3: 7, 4: 7, 5: 7, 6: None}


def test_versions_and_as_of(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 5, "y"), ("a", 9, None), ("b", 3, "x")], "k string, at int, v string")
    v = ranking.version_intervals(df, "k", "at", ["v"], "at")
    assert sorted((r.k, r["at"], r.end) for r in v.collect()) == [("a", 1, 5), ("a", 5, 9), ("a", 9, None), ("b", 3, None)]
    probes = spark.createDataFrame([("a", 0), ("a", 4), ("a", 5), ("a", 50), ("b", 3)], "k string, t int")
    got = sorted((r.k, r.t, r.v or "") for r in ranking.as_of(v.withColumnRenamed("at", "s"), probes, "k", "s", "end", "t").collect())
    assert got == [("a", 4, "x"), ("a", 5, "y"), ("a", 50, ""), ("b", 3, "x")]


def test_selection(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2), (4, "c", 9)], "id int, k string, r int")
    assert sorted(r.id for r in ranking.first_per_key(df, ["k"], ["r"]).collect()) == [2, 3, 4]
    got = [(r.id, r.position) for r in ranking.interleave(df, [F.asc("r")], [F.desc("r")], "id", 3).orderBy("position").collect()]
    assert got == [(2, 1), (4, 2), (3, 3)]
    old = spark.createDataFrame([(1, "p", 1), (2, "q", 1)], "id int, page string, at int")
    new = spark.createDataFrame([(3, "p", 2), (3, "p", 3)], "id int, page string, at int")
    assert sorted(tuple(r) for r in ranking.reconcile(old, new, "id", "page", "at").collect()) == [(2, "q", 1), (3, "p", 3)]


def test_joins(spark):
    cov = joins.coverage(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (1,), (4,)], "k int"), "k").first()
    assert tuple(cov) == (3, 2, 2, 1, 1, False)
    a = spark.createDataFrame([(1, "2024-01-01", "2024-01-03"), (2, "2024-01-10", "2024-02-20")], "a int, x string, y string").select("a", F.col("x").cast("date").alias("x"), F.col("y").cast("date").alias("y"))
    b = a.select(F.col("a").alias("b"), F.date_add("x", 2).alias("u"), F.date_add("y", 2).alias("v"))
    assert sorted((r.a, r.b) for r in joins.overlap_join(a, b, "x", "y", "u", "v", 3).collect()) == [(1, 1), (2, 2)]
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    assert sorted(r.k for r in joins.insert_once(target, spark.createDataFrame([(1, "new"), (2, "n"), (2, "n")], "k int, v string"), "k").collect()) == [1, 2]


def test_grid_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    points = [(i, 40.9 + rng.random() * 0.2, 28.9 + rng.random() * 0.2) for i in range(120)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    import math

    def metres(p, q):
        x = math.radians(q[2] - p[2]) * math.cos(math.radians((p[1] + q[1]) / 2))
        return math.hypot(x, math.radians(q[1] - p[1])) * numeric.EARTH_METRES

    want = {(p[0], q[0]) for p, q in itertools.combinations(points, 2) if metres(p, q) <= 900}
    assert {(r.id, r.id2) for r in resolve.grid_pairs(df, "id", "lat", "lon", 900.0).collect()} == want


def test_jsonld_events(spark):
    html = """<script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "A &amp; B", "startDate": "2030-01-02T20:00:00+03:00",
      "location": {"name": "Salon", "geo": {"latitude": 41.0, "longitude": 29.0}, "address": {"streetAddress": "Moda", "addressLocality": "Istanbul"}},
      "offers": [{"price": 30, "availability": "https://schema.org/SoldOut"}, {"price": "50", "priceCurrency": "TRY", "availability": "https://schema.org/InStock"}],
      "subEvent": [{"@type": "Event", "name": "Late", "startDate": "2030-01-03 20:00", "offers": {"lowPrice": 9}}]}]}</script>
      <script type='application/ld+json'>{broken</script><script type="application/ld+json">[{"@type": "Place"}, {"@type": "TheaterEvent", "name": "Old",
      "startDate": "2001-01-01T10:00:00Z", "location": {"name": "X", "geo": {"latitude": 0, "longitude": 0}}}]</script>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id int, html string")
    rows = {r.title: r for r in jsonld.validate_listing(jsonld.events(jsonld.jsonld_objects(pages, ["page_id"]), ["page_id"]), F.lit("2029-01-01").cast("timestamp")).collect()}
    assert set(rows) == {"A & B", "Late", "Old"}
    a = rows["A & B"]
    assert (a.price, a.availability, a.venue, a.lat, a.errors) == (50.0, "available", "Salon", 41.0, []) and a.start.isoformat() == "2030-01-02T17:00:00"
    assert rows["Late"].price == 9.0 and "start_offset" in rows["Late"].errors and "venue" in rows["Late"].errors
    assert rows["Old"].errors == ["past"] and rows["Old"].lat is None and rows["Old"].availability == "unknown"


def test_jsonld_levels(spark):
    from eventloom.scratch import cut

    depth = 40
    text = '{"@type": "Event", "name": "0"}'
    for k in range(1, depth):
        text = f'{{"@type": "Event", "name": "{k}", "subEvent": ' + (f"[[{text}, null, 7]]" if k % 2 else text) + "}"
    html = f'<script type="application/ld+json">{text}</script><script type="application/ld+json">[{{}}, "x", {{"@graph": {{"name": "g", "subEvent": null}}}}]</script>'
    rounds = []
    found = jsonld.jsonld_objects(spark.createDataFrame([(1, html)], "page_id int, html string"), ["page_id"], checkpoint=lambda df: rounds.append(1) or cut(df))
    names = [r.name for r in found.select(F.expr("try_variant_get(v, '$.name', 'string')").alias("name")).collect()]
    assert sorted(names, key=str) == sorted([*map(str, range(depth)), "g", None, None], key=str)
    assert len(rounds) < 10  # not one for each of some 80 levels


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    made = publication.publish(df, root, "p1")
    assert made["rows"] == 100 and publication.active(spark, root) == (0, None)
    publication.activate(spark, root, "p1", None)
    assert publication.read_active(spark, root).count() == 100
    with pytest.raises(ValueError):
        publication.activate(spark, root, "p1", "p0")
    with pytest.raises(Exception, match="exists"):
        publication.publish(df, root, "p1")
    publication.publish(df.where("id < 50"), root, "p2")
    publication.activate(spark, root, "p2", "p1")
    assert publication.active(spark, root) == (2, "p2") and publication.read_active(spark, root).count() == 50
    digest = publication.write_artifact(df, f"{root}/art")
    assert publication.read_artifact(spark, f"{root}/art", df.schema, digest).count() == 100
    assert digest == revisions.content_root(df.orderBy(F.desc("id")), df.columns).first()["root"]
    with pytest.raises(ValueError):
        publication.read_artifact(spark, f"{root}/art", df.schema, "0")


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"2024-01-01 0{i % 9}:00:00", i % 3, i) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, ts string, k int, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(5).write.parquet(src)
    stream = streams.read_events(spark, src, df.schema, files_per_batch=2)
    streams.run(stream, streams.upsert_latest(spark, out, "k", "ts", "id"), str(tmp_path / "cp"), "append")
    versions = sorted((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name[1:]))
    latest = {r.k: r.id for r in spark.read.parquet(str(versions[-1])).collect()}
    want = {k: max((r[1], r[0]) for r in rows if r[2] == k)[1] for k in range(3)}
    assert latest == want
    seen = []
    streams.run(streams.session_windows(streams.read_events(spark, src, df.schema, 99), "k", "90 minutes", "1 day"), lambda b, n: seen.append(b.count()), str(tmp_path / "cp2"), "append")
    streams.run(streams.fresh_once(streams.read_events(spark, src, df.schema, 99), "k", "1 day"), lambda b, n: seen.append(b.count()), str(tmp_path / "cp3"), "append")
    assert 3 in seen


def test_venue_names(spark):
    from eventloom.functions import venues

    names = ["Zorlu PSM Turkcell Sahnesi", "B-B-S Kadıköy Kültür Merkezi", "Moda Sahnesi Büyük Salon", "Eyüp Sultan Sahne", "Salon", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.t for r in df.orderBy("i").select(venues.distinctive_tokens(F.col("n")).alias("t")).collect()]
    assert got == [["zorlu", "psm", "turkcell"], ["bbs"], ["moda", "buyuk"], ["eyupsultan"], [], []]
    titles = [("HABITAT X Evgeny Grinko", "Habitat Hilltown"), ("Anka Workshop: Mum Atölyesi", "Ankaworkshop"), ("Mozaik Workshop: Mum", "Ankaworkshop"), ("Club: Night", "Club"), ("Habitat", "Habitat"), ("Habitat: ", "Habitat")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(titles)], "i int, t string, n string")
    got = [r.x for r in rows.orderBy("i").select(venues.without_venue_prefix(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == ["Evgeny Grinko", "Mum Atölyesi", "Mozaik Workshop: Mum", "Club: Night", "Habitat", "Habitat: "]
    assert [list(r.d) for r in df.orderBy("i").select(venues.name_districts(F.col("n")).alias("d")).collect()] == [[], ["kadikoy"], ["kadikoy"], ["eyupsultan"], [], []]


def test_quarantine_reaches_through_groups(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (None, "a"), (6, None)], "id int, g string")
    flagged = spark.createDataFrame([(1,), (6,), (None,)], "id int")
    assert {(r.id, r.round) for r in resolve.quarantine(members, flagged, "id", "g", cut).collect()} == {(1, 0), (6, 0), (2, 1), (3, 2)}


def test_interleaving_without_repeats(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(400), rng.randrange(400), rng.choice("abcdefghij"), rng.choice([*"stuvwxyz", None])) for i in range(200)]
    one, two = sorted(rows, key=lambda r: (r[1], r[0])), sorted(rows, key=lambda r: (-r[2], r[0]))
    taken, seen_p, seen_s = [], set(), set()
    for pair in zip(one, two):
        for r in pair:
            if r[3] not in seen_p and r[4] not in seen_s and len(taken) < 6:
                taken.append(r[0])
                seen_p.add(r[3])
                seen_s.add(r[4])
    df = spark.createDataFrame(rows, "id int, a int, b int, p string, s string")
    got = ranking.interleave_unique(df, [F.asc("a"), F.asc("id")], [F.desc("b"), F.asc("id")], "id", ["p", "s"], 6)
    assert [r.id for r in got.orderBy("position").collect()] == taken


def test_search_without_a_query_vector(spark):
    from eventloom.operators import search

    docs = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert search.dense_scores(docs, "id", "v", None).count() == 0


def test_acceptance_asks_state_once():
    """Rows of one key that arrive together ask its state for offers and heads once; a replay in a later call is known."""
    from eventloom.streaming.acceptance import Acceptance

    asked = []

    class Kept(dict):
        exists = lambda self: bool(self)
        iterator = lambda self: asked.append("all") or iter(list(self.items()))
        containsKey = lambda self, key: asked.append(key) or key in self  # noqa: E731, N815
        getValue = lambda self, key: asked.append(key) or self.get(key)  # noqa: E731, N815
        updateValue = dict.__setitem__  # noqa: N815

    a = Acceptance()
    a.offers, a.heads, a.seen = Kept(), Kept(), Kept()
    rows = [(i, i, i, f"r{i}", f"s{i % 3}", None, i, "x") for i in range(50)]
    assert [r.status for r in a.take((1,), rows)] == ["accepted"] * 50
    assert asked == ["all", "all"]
    assert len(a.seen) == 50 and a.heads[("offer:s0",)] == ("r48", None, 48, "x") and a.offers == {(f"s{i}",): (f"offer:s{i}",) for i in range(3)}
    again = list(a.take((1,), [(60, 60, 60, "r3", "s0", None, 3, "x"), (61, 61, 61, "r4", "s1", None, 9, "y"), (62, 62, 62, "r9", "s0", None, 1, "x")]))
    assert [(r.status, r.reason, r.head, r.replay) for r in again] == [
        ("accepted", None, "r48", True), ("held_conflict", "revision_id_reused", "r49", False), ("held_conflict", "revision_id_reused", "r48", False)]


def test_venue_edges_read_names_once(spark):
    """What names say is worked out in one table that all kinds of evidence read; the edges are the same."""
    from eventloom.operators.venues import venue_edges

    rows = [(i, "bkt"[i % 3], "c", f"Zorlu {'Salon ' * (i % 2)}Kule{i % 4}", f"v{i % 5}", None, 41.0, 29.0 + i % 4 * 0.0001, ["kadikoy"] if i % 6 == 0 else []) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, provider string, city string, name string, venue_id string, seed string, lat double, lon double, districts array<string>")
    kept = []
    out = venue_edges(df, lambda t: kept.append(spark.createDataFrame(t.collect(), t.schema)) or kept[-1])
    assert len(kept) == 1 and {"compact", "words", "tokens"} <= set(kept[0].columns)
    assert sorted(out.collect()) == sorted(venue_edges(df).collect()) != []
