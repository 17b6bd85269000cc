"""Queries do the whole job: every row counts, against brute force on small tables."""

import datetime
import random

from eventloom import catalog
from eventloom.catalog import search as catalog_search
from eventloom.operators import search


def test_time_versions_and_overlaps_take_every_key(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(u, start + datetime.timedelta(hours=7 * i * u)) for u in range(1, 13) for i in range(4)] + [(3, start), (4, start)]
    spark.createDataFrame(events, "user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    expected = []
    for u in range(1, 13):
        own = [t for k, t in events if k == u]
        spans = [(t - datetime.timedelta(minutes=5), t + datetime.timedelta(hours=72)) for t in own]
        pieces = [(at, sum(a <= at < b for a, b in spans)) for at in sorted({x for s in spans for x in s})]
        pieces = [p for i, p in enumerate(pieces) if not i or p[1] != pieces[i - 1][1]]
        ends = [str(at) for at, _ in pieces[1:]] + [None]
        expected += [(u, str(at), end, n) for (at, n), end in zip(pieces, ends)]
    found = [tuple(r) for r in catalog.QUERIES["time_versions"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)

    orders = [(k, datetime.datetime(1992, 12, 25) + datetime.timedelta(days=3 * k)) for k in range(1, 700)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    windows = [(i, datetime.date(1993 + i % 5, 1 + i % 9, 11)) for i in range(20)]
    expected = {}
    for w, b1 in windows:
        hits = [k for k, d in orders if d.date() <= b1 + datetime.timedelta(days=4) and d.date() + datetime.timedelta(days=10) >= b1]
        if hits:
            expected[w] = (len(hits), min(hits))
    assert {r["w"]: (r["n"], r["first"]) for r in catalog.QUERIES["window_overlap"](spark, str(tmp_path)).collect()} == expected


def test_age_evidence_reads_all_numbers(spark, tmp_path):
    texts = {1: "from 5, 6, 7 and 8 years", 2: "5 6 7 then 18", 3: "20 30 40 50 11", 4: "13 14 15 16 17", 5: "none", 6: "999 500 300 12"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: (r["rules"], r["status"]) for r in catalog.QUERIES["age_evidence"](spark, str(tmp_path)).collect()}
    assert found == {1: (4, "supported"), 2: (4, "unknown"), 3: (5, "unknown"), 4: (5, "contradicted"), 6: (1, "supported")}


def test_coverage_sees_parts_behind_a_long_head(spark, tmp_path):
    """One brand and type holds the dearest 450 parts; every other brand and type comes behind them."""
    parts = [(k, "Hot", "HOT", 5000.0 - k // 3) for k in range(450)] + [(450 + i, f"B{i % 7}", f"T{i % 60}", 900.0 - i // 2) for i in range(300)] + [(800, "Last", "TLAST", None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    ordered = sorted(parts, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(ordered)}

    once, heads, shown, extra = {}, {}, {r[1] for r in ordered[:12]}, {}
    for r in ordered:
        once.setdefault(r[2], r)
    for r in sorted(once.values(), key=lambda r: rank[r[0]]):
        heads.setdefault(r[1], r)
    expected = sorted(once.values(), key=lambda r: (heads[r[1]] != r, rank[r[0]]))[:40]
    found = catalog.QUERIES["category_coverage"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted((*r[:3], rank[r[0]]) for r in expected)
    assert "Last" in {r["p_brand"] for r in found}

    for r in ordered:
        if r[1] not in shown:
            extra.setdefault(r[1], r)
    tail = sorted(extra.values(), key=lambda r: rank[r[0]])[:4]
    expected = [(r[0], rank[r[0]]) for r in ordered[: 12 - len(tail)] + tail]
    assert len(tail) == 4
    assert sorted(tuple(r) for r in catalog.QUERIES["tag_coverage"](spark, str(tmp_path)).collect()) == sorted(expected)


def test_rrf_hybrid_fuses_whole_rankings(spark, tmp_path):
    """A hot source holds the first 300 places of both lists; the others come behind, many with equal scores."""
    words = "attion hean tionre thed"
    docs = [(i, f"{words} " + "filler " * (i % 3), "hot") for i in range(300)] + [(300 + i, "attion " + "other " * (5 + i // 3), f"s{i % 11}") for i in range(240)]
    vectors = [(i, [1.0, i / 1000.0]) for i in range(300)] + [(300 + i, [1.0, 2.0 + (i * 7 % 240) // 2]) for i in range(230)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    scored = search.bm25(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", search.tokens_of("text"), catalog_search.TERMS).collect()
    lexical = sorted((-round(r["score"], 9), r["doc_id"]) for r in scored)
    qv = catalog_search._query_vector(spark, str(tmp_path))
    similar = search.dense_scores(spark.read.parquet(str(tmp_path / "embeddings.parquet")), "vec_id", "embedding", qv).collect()
    dense = sorted((-round(r["similarity"], 9), r["vec_id"]) for r in similar)
    assert len(lexical) == 540 and len(dense) == 530
    score, best = {}, {}
    for ranking in (lexical, dense):
        for r, (_, i) in enumerate(ranking):
            score[i] = score.get(i, 0.0) + 1 / (61 + r)
    for i, _, source in docs:
        best[source] = max(best.get(source, (-1.0, 0)), (score[i], -i))
    found = catalog.QUERIES["rrf_hybrid"](spark, str(tmp_path)).collect()
    assert sorted((r["source"], r["doc_id"], round(r["score"], 6)) for r in found) == sorted((s, -i, round(x, 6)) for s, (x, i) in best.items())


def test_stream_page_heads_take_arrival_order_across_triggers(spark, tmp_path):
    """Twenty shuffled files, which are three triggers; one user holds a third of the rows."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, 0 if i % 3 == 0 else rng.randrange(1, 9), rng.choice("ab"), start + datetime.timedelta(days=i // 100 + rng.randrange(3))) for i in range(1200)]
    shuffled = rng.sample(events, len(events))
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    spark.createDataFrame(spark.sparkContext.parallelize(shuffled, 20), schema).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*.parquet"))) == 20
    heads, expected = {}, []
    for i, user, content, ts in sorted(events, key=lambda e: e[0] // 50 * 50 + e[0] * 37 % 50):
        clock, old = heads.get(user, (-1, None))
        day = (ts - start).days
        verdict = "accepted" if day > clock else "stale" if day < clock else "same" if content == old else "held"
        if verdict == "accepted":
            heads[user] = (day, content)
        expected.append((user, i, verdict))
    found = [tuple(r) for r in catalog.QUERIES["stream_page_heads"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
