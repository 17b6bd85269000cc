"""Operators 11 to 13 against plain Python on small tables, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("eventloom.llm")
from eventloom.llm import dialogue, resample, sitetree  # noqa: E402
from eventloom.llm.sitetree import page_nodes  # noqa: E402

# importance resampling ---------------------------------------------------------------------------


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c > "\x7f" or c.isascii() and c.isalnum() else " " for c in low).split(" ")


def plain_features(text, ngram):
    ws = [w for w in plain_words(text) if w]
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, ngram + 1) for i in range(len(ws) - n + 1)]


TEXTS = [None, "", " .\n", "A-b_c", "É é x　y", "\x7fdel\x00nul", "a b a b a b", "Ünï 12 cödé " * 40]


@pytest.mark.parametrize("ngram", [1, 2, 4])
def test_ring_gives_the_crc_of_every_run(ngram):
    rng = random.Random(3)
    for text in [*TEXTS, *("".join(rng.choice("abC é.1　") for _ in range(rng.randrange(80))) for _ in range(200))]:
        n, runs = plain_features(text, ngram)
        words = resample.words_of(None if text is None else text.encode())
        assert len(words) == n and sorted(resample.crc_ring(words, ngram)) == sorted(zlib.crc32(r.encode()) for r in runs)


def plain_draw(docs, target, ngram, buckets, least, percent, seed):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, ngram)[1])
    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        n, runs = plain_features(text, ngram)
        gains = [gain(zlib.crc32(r.encode()) % buckets) for r in runs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, long[: percent * len(long) // 100]


@pytest.mark.parametrize("ngram,buckets", [(1, 10_000), (3, 64)])
def test_resampling_equals_plain_python(spark, ngram, buckets):
    rng = random.Random(ngram)
    docs = [(i, " ".join(rng.choice("alpha beta Gamma délta é 7 x".split()) for _ in range(rng.randrange(12)))) for i in range(300)]
    docs += [(None, None), (None, "alpha beta " * 9), (7, docs[7][1]), (900, "x" * 40_000), *((1000 + k, t) for k, t in enumerate(TEXTS))]
    target = ["alpha beta", None, "Gamma gamma 7", ""]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, key int").repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.importance_resample(frame, aim, ngram=ngram, buckets=buckets, min_words=5, percent=30, seed="s").collect()
    want, drawn = plain_draw(docs, target, ngram, buckets, 5, 30, "s")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert [tuple(r)[:5] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert resample.importance_resample(none, some).count() == 0
    assert [r.weight for r in resample.importance_resample(some, none).collect()] == [math.floor(1000 * math.log(10_003 / 20_000))] * 2


# conversation repair -----------------------------------------------------------------------------


def plain_repair(rows):
    """rows (turn, role, text) -> report by the least (cost, audit) to every state, row after row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}

    def put(best, state, value):
        if state not in best or value < best[state]:
            best[state] = value

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for i in "ua":
                    if (state, i) in moves:
                        put(best, moves[state, i], (cost + 5, audit + "I", [*out, f"{name[i]}:"]))
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        new: dict = {}
        for state, (cost, audit, out) in inserted(best).items():
            put(new, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if (state, role[:1]) in moves:
                put(new, moves[state, role[:1]], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
            for i in "ua":
                if (state, i) in moves:
                    put(new, moves[state, i], (cost + 1 + more, audit + "R", [*out, f"{name[i]}:{text}"]))
        best = new
    cost, audit, out = min(v for s, v in inserted(best).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def report_of(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, run int, at int").repartition(3)
    return {tuple(r)[0]: tuple(r)[1:] for r in dialogue.repair_conversations(frame, **more).report.collect()}


def grouped(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return out


def test_repair_equals_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn + rng.randrange(2), rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["Yes.", "No!", "cut", "", " \n", "so?  ", "Ü.", "a" * 5000])))
    rows += [(500, None, None, None), (500, None, "user", "x."), (500, 3, "", "y."), (None, 1, "user", "n."), (None, 2, "assistant", "m."), (501, 1, "user", "same."), (501, 1, "user", "same.")]
    want = {conv: plain_repair(r) for conv, r in grouped(rows).items()}
    got = report_of(spark, rows)
    assert got == want
    assert {len(w[6]) for w in want.values()} >= {1, 5} and set("".join(w[6] for w in want.values())) == set("DKR")  # to delete a row is cheaper than to add one


def test_walk_with_cheap_inserts(monkeypatch):
    """The DAG with inserts at 1, against the least (cost, audit) of every state, row after row."""
    monkeypatch.setattr(dialogue, "INSERT", 1)
    monkeypatch.setattr(dialogue, "FREE", dialogue._inserts())
    monkeypatch.setattr(dialogue, "STEP", {c: tuple(dialogue.over(row, dialogue._matrix(c, 1)) for row in dialogue.FREE) for c in dialogue.STEP})
    end = dialogue.back(dialogue.FREE, (0, dialogue.FAR, dialogue.FAR, 0))
    rng = random.Random(2)
    audits = set()
    for _ in range(400):
        codes = [rng.choice(list(dialogue.STEP)) for _ in range(rng.randrange(9))]
        best = {0: (0, "")}

        def spread(best, code, taken):
            out = dict(best) if not taken else {}
            for state, (cost, audit) in best.items():
                for letter, price, to, n, _ in dialogue.arcs(code, state):
                    if n == taken and (to not in out or (cost + price, audit + letter) < out[to]):
                        out[to] = (cost + price, audit + letter)
            return out

        for code in [*codes, ""]:
            for _ in range(4):
                best = spread(best, code, 0)
            best = spread(best, code, 1) if code else best
        want = min(v for s, v in best.items() if s in dialogue.ENDS)
        edits, _ = dialogue.walk(codes, dialogue.Around(end=end))
        assert (sum(e[3] for e in edits), "".join(e[0] for e in edits)) == want
        # the same path in two runs
        k = rng.randrange(len(codes) + 1)
        behind = end
        for code in reversed(codes[k:]):
            behind = dialogue.back(dialogue.STEP[code], behind)
        first, frontier = dialogue.walk(codes[:k], dialogue.Around(end=behind, last=False))
        arrival = dialogue.BEGIN
        for code in codes[:k]:
            arrival = dialogue.over(arrival, dialogue.STEP[code])
        second, _ = dialogue.walk(codes[k:], dialogue.Around(start=arrival, end=end, frontier=frontier))
        assert "".join(e[0] for e in [*first, *second]) == want[1]
        audits.add(want[1])
    assert set("".join(audits)) == set("DIKR")


def test_repair_of_a_conversation_over_all_runs(spark):
    """One conversation with nearly all rows crosses every range, as does a turn of many equal rows."""
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(7, t, rng.choice(roles), rng.choice([f"t{t}.", f"t{t}", "", "again."])) for t in range(900)]
    rows += [(7, 450, "user", "the same.")] * 700 + [(c, 0, "user", "hi.") for c in (1, 9)]
    runs = dialogue.in_runs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert runs.where("conv_id = 7").select("run").distinct().count() >= 3
    want = {conv: plain_repair(r) for conv, r in grouped(rows).items()}
    assert report_of(spark, rows) == want


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(200) for t in range(1 + c % 2)] + [(None, None, None, "z.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if k == 4 else role or " ", {1: "", 2: "One Two" if conv is not None else "z"}.get(k, text))
        want += [row] * {0: 0, 3: 2}.get(k, 1)
    hurt = dialogue.damage(frame)
    assert Counter(map(tuple, hurt.collect())) == Counter(want)
    report = dialogue.repair_conversations(hurt, frame).report.collect()
    assert {r.conv_id for r in report} == {r[0] for r in rows} and len(report) == 201
    gone = {r[0] for r in rows} - {r[0] for r in want}
    assert gone and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in report if r.conv_id in gone)


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_conversations(none).report.count() == 0


def test_repaired_rows_follow_the_pattern(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("assistant", "a."), ("user", "b."), ("user", "c."), ("system", "d."), ("assistant", "e")])]
    fixed = dialogue.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = [r.role for r in fixed.rows.orderBy("run", "at", "place").collect()]
    assert out in (["user", "assistant"] * (len(out) // 2), ["system", *["user", "assistant"] * (len(out) // 2)])


# site style tree ---------------------------------------------------------------------------------


def test_blocks_of_a_page():
    texts = lambda h: page_nodes(h)["texts"]
    assert texts("<div class=menu><a>Home</a></div><div class=content><p>Hello <span class=ad>Buy</span> you<p>b<br>c</div>") == ["Hello you", "b c"]
    assert texts("<article><header><h1>T</h1></header><p>x<div class='share'>s</div><footer>f</footer></article><aside>q</aside>rest") == ["T", "x"]
    assert texts("<p>a &lt;b&gt; &amp &copy; c <3 d</p><ul><li>one<li>two</ul>") == ["a <b> & © c <3 d", "one", "two"]
    assert texts("<article><p>x<div id='comments'><article>reader</article></div></article>") == ["x"]
    assert texts("<article><h2 id=related>Related</h2><p>y<script>var t='</p>';</script><style>p{}</style><!-- <p>no --></article>") == ["Related", "y"]
    assert texts("<div class='has-sidebar'><p>kept</div><div class='post-sidebar'>gone</div><p hidden>h<p style='display: none'>n") == ["kept"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"] and texts("<b>" * 3000 + "x") == ["x"]
    assert texts("<a b='c>x</a> tail") == ["x tail"] and texts("<script>x") == [] and texts("") == [] and texts("<template>" * 50 + "t") == ["t"]


def site(host, n, **fixed):
    rng = random.Random(host)
    line = lambda k: " ".join(f"w{rng.randrange(999)}" for _ in range(k))
    return [(f"http://{host}/{k}", f"<title>{line(4)}</title><div class=top>{fixed.get('top', 'Home News')}</div><div class=body><h1>{line(5)}</h1>" + f"<p>{line(20)}</p>" * (k % 3 + 1) + "<p>Fixed licence line.</p></div><div class=end>All rights</div>") for k in range(n)]


def frame_of(spark, pages):
    return spark.createDataFrame([(k, u, h, "x", 1) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string, row int")


def test_repeated_branches_of_a_site_go(spark):
    pages = site("a.org", 12) + site("few.org", 3) + [("http://few.org/x", "<article><p>in</article>out")]
    got = {r.url: r.text.split("\n\n") for r in sitetree.extract_text(frame_of(spark, pages)).collect()}
    for url, _ in pages[:12]:
        assert "Home News" not in got[url] and "All rights" not in got[url] and got[url][-1] == "Fixed licence line." and len(got[url]) >= 3
    assert all("Home News" in got[u] for u, _ in pages[12:15])  # too few pages for statistics
    assert got["http://few.org/x"] == ["in"]


def test_site_tree_equals_plain_python(spark):
    pages = site("a.org", 9) + site("b.org", 4) + [("http://a.org/0b", site("a.org", 9)[0][1])]
    units = defaultdict(set)
    below = defaultdict(set)
    for url, html in pages:
        host, p = url.split("/")[2], page_nodes(html)
        for node, feature, style in zip(p["nodes"], p["features"], p["styles"]):
            units[host, node, style, feature].add(p["unit"])
        for chain in p["chains"]:
            for node in chain:
                below[host, node].add(chain[-1])
    content, shape, styles = {}, {}, {}
    for host, node, style in {k[:3] for k in units}:
        m = len(units[host, node, style, 0])
        ks = [len(v) for (h, n, s, f), v in units.items() if (h, n, s) == (host, node, style) and f]
        if style:
            total = sum(ks)
            shape[host, node] = 1.0 if m == 1 else -sum(k / total * math.log(k / total, m) for k in ks)
            styles[host, node] = len(ks)
        else:
            content[host, node] = 1.0 if m == 1 else 1 - sum(math.log(k, m) for k in ks) / len(ks)
    tree = {(r.host, r.node): r for r in sitetree.site_tree(sitetree.parsed_pages(frame_of(spark, pages))).collect()}
    assert set(tree) == set(below)
    for (host, node), leaves in below.items():
        under = sum(content[host, x] for x in leaves) / len(leaves)
        r, l = tree[host, node], styles[host, node]
        want = under if leaves == {node} and l <= 1 else (1 - 0.9**l) * shape[host, node] + 0.9**l * under
        assert r.presentation == pytest.approx(shape[host, node], abs=1e-9) and r.importance == pytest.approx(want, abs=1e-9)


def test_pages_at_the_edges(spark):
    pages = [(None, None), ("no host", "<p>a"), ("http://h/", ""), ("http://h/", None), (None, "<p>b"), ("http://h/", "<p>" + "w " * 200_000)]
    out = sitetree.extract_text(frame_of(spark, pages * 2)).collect()
    assert Counter((r.url, len(r.text)) for r in out) == Counter([(None, 0), ("no host", 1), ("http://h/", 0), ("http://h/", 0), (None, 1), ("http://h/", 399_999)] * 2)
    assert sitetree.extract_text(frame_of(spark, pages).where("false")).count() == 0
    same = [(f"http://copy.org/{k}", "<title>t</title><div class=x>one text</div>") for k in range(40)]
    assert {r.text for r in sitetree.extract_text(frame_of(spark, same)).collect()} == {"one text"}
