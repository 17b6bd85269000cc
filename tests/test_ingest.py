"""Ingest, location and timing rules on small tables."""

from pyspark.sql import functions as F

from eventloom.functions import location, timing
from eventloom.sources import ingest


def test_location(spark):
    cases = [
        ("Kadıköy", "x Moda", ("kadikoy", "asia", "district")), ("Kadıköy", "x Şişli/İstanbul", (None, None, "unknown")), ("Moda / Üsküdar", "", (None, "asia", "side")),
        ("Moda/Taksim", "", (None, None, "unknown")), ("Levent", None, (None, "europe", "side")), (None, "Bağdat Caddesi, İstanbul", (None, "asia", "side")), (None, None, (None, None, "unknown")),
        ("Avrupa Yakası", "Beyoğlu", ("beyoglu", "europe", "district")),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: tuple(r.x) for r in df.select("i", location.resolve_location(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    sets = spark.createDataFrame([(["a"], ["b"]), (["a"], ["a", "b"]), ([], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(location.conflict(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_door_times(spark):
    rows = [("Kapı açılış: 19:30 Etkinlik saati 21.00", "2024-01-01 16:30:00"), ("Kapı Açılış 19:30", "2024-01-01 16:30:00"), ("Etkinlik başlangıç saati: 9.05 kapı açılışı", "2024-01-01 06:05:00"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, s string").withColumn("s", F.col("s").cast("timestamp"))
    got = df.orderBy("i").select(timing.labelled_clock(F.col("d"), timing.EVENT_TIME).alias("e"), timing.door_time_conflict(F.col("d"), F.col("s")).alias("c")).collect()
    assert [(r.e, r.c) for r in got] == [("21:00", True), (None, False), ("09:05", False), (None, False)]
    assert spark.range(1).select(timing.doors_only(F.lit("Belirtilen saat, kapı açılış saatidir."))).first()[0]


def test_sessions(spark):
    schema = "id int, name string, url string, city string, venue string, open_ticket boolean, sessions array<array<string>>"
    rows = [
        (1, "A", "/a", "İstanbul Avrupa", "V", None, [["2030-01-01T20:00:00+03:00", "2030-01-01T20:00:00+03:00"], ["2030-01-02T20:00:00"]]),
        (2, "B", "/b", "Istanbul", "V", True, [["2030-01-01T20:00:00Z"]]), (3, "C", "/c", "Ankara", "V", False, [["2030-01-01T20:00:00Z"]]),
        (4, "D", "/d", "istanbul", "", False, [["2030-01-01T20:00:00Z"], ["2001-01-01T00:00:00Z"]]), (5, "E", None, "İstanbul", "V", False, None),
    ]
    events, bad = ingest.expand_sessions(spark.createDataFrame(rows, schema), F.lit("2029-01-01").cast("timestamp"))
    assert [(r.id, r.start.isoformat()) for r in events.collect()] == [(1, "2030-01-01T17:00:00")]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [
        (1, "ambiguous_session_timezone"), (2, "open_ticket_without_session"), (3, "sessions_missing_or_non_istanbul"), (4, "invalid_session"), (4, "invalid_session"), (5, "sessions_missing_or_non_istanbul"),
    ]


def test_performances_gate_store(spark):
    df = spark.createDataFrame([(1, "v", 500, True), (1, "v", 300, False), (2, "v", 100, False)], "t int, venue string, p int, ok boolean")
    got = {r.t: (r.price, r.rows, r.sold_out) for r in ingest.group_performances(df, "t", "venue", F.col("p"), F.col("ok")).collect()}
    assert got == {1: (5.0, 2, False), 2: (None, 1, True)}
    ok = F.col("id") < 100
    assert ingest.publication_gate(spark.range(30), spark.range(10), ok).first().reason == "large_catalog_drop"
    assert ingest.publication_gate(spark.range(30), spark.range(18), ok).first().reason is None
    assert ingest.publication_gate(spark.range(3), spark.range(0), ok).first().reason == "no_verified_available_events"
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b"yyyy"))], "path string, content binary")
    assert [(r.first_path, r.receipts) for r in ingest.raw_store(files, 3).collect()] == [("a", 2)]


def test_coverage_state(spark):
    rows = [("u", 1, "success"), ("u", 2, "timeout"), ("u", 3, "retired"), ("u", 4, "http_500"), ("w", 1, "quarantined"), ("w", 2, "success"), ("x", 1, "timeout")]
    df = spark.createDataFrame([(k, f"2024-01-0{n} 00:00:00", o, n) for k, n, o in rows], "k string, at string, o string, n int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    state = ingest.coverage_state(df, "k", "at", "o", "n")
    got = {r.k: (r.attempts, r.failure, r.state) for r in state.collect()}
    assert got == {"u": (4, "http_500", "retired"), "w": (2, None, "success"), "x": (1, "timeout", None)}
    assert {r.k for r in ingest.due(state, F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'")).collect()} == {"w", "x"}
    assert {r.k for r in ingest.due(state, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).collect()} == {"u", "w", "x"}
