"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("eventloom.llm")

from eventloom.llm import components, decontaminate, jaccard, langid, lines, mixing, quality, secrets, substring, toxicity, urls  # noqa: E402
from eventloom.llm import textnp  # noqa: E402
from eventloom.llm.oracle import OP8_RULES  # noqa: E402
from eventloom.llm.queries import URL_RULES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int"


def words(text):
    return WORD.findall(text or "")


def docs_of(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rng_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edit(rng, text, n):
    out = text.split(" ")
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


ODD = [None, "", " \n\t ", "a", "é ü", "one two three", "Ünï\tcödé\n\n\x0bx", "#" * 50, "w " * 3000]


# vectorised words -------------------------------------------------------------------------------


def test_words_match_regex(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("ab \né\t") for _ in range(rng.randrange(60))) for _ in range(800))]
    monkeypatch.setattr(textnp, "SLICE", 300)
    seen = {}
    for w in textnp.words_of(pa.array(texts, pa.string())):
        for d in range(w.lo, w.hi):
            a, b = w.bounds[d - w.lo : d - w.lo + 2]
            got = [w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(a, b)]
            assert got == words(texts[d])
            for k, x in zip(range(a, b), got):
                assert seen.setdefault(x, w.hashes[k]) == w.hashes[k]
    assert len(set(seen.values())) == len(seen)


# components -------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 urls -----------------------------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "https://WWW.Example.com/en/1?x#y", None),
        (2, "http://m.example.com/en/2", None),
        (3, "https://a.net/es/", None),
        (4, "https://plain.org/x", '<link rel="canonical" href="https://a.net/es/">'),
        (5, "https://alias.org/y", '<meta http-equiv="refresh" content="0; url=https://plain.org/x">'),
        (6, "https://mixed.org/z", '<link href="//www.example.com/en/9" rel=canonical><link rel=canonical href=https://b.net/fr/q>'),
        (7, None, "<p>"),
        (8, "not a url", None),
        (9, "https://notexample.com", "x"),
        (9, "https://notexample.com", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(list)
    for r in urls.filter_urls(pages, URL_RULES).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert got[2] == [("m.example.com", "/en/2", "example.com/en/", "block")]
    assert got[3][0][2:] == ("net/es/", "block")
    assert got[4][0][2:] == (None, "block") and got[5][0][2:] == (None, "block")
    assert got[6][0][2:] == (None, "allow")  # an allowed alias takes precedence over a blocked one
    assert got[7] == [("", "", None, "allow")] and got[8] == [("", "", None, "allow")]
    assert got[9] == [("notexample.com", "", None, "allow")] * 2  # com/ needs a path


def test_url_rules_joined_as_literal(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://{h}.example.{t}/{p}/{i}", None) for i, (h, t, p) in enumerate((h, t, p) for h in ("www", "m") for t in ("com", "net") for p in ("en", "es", "fr"))], "page_id long, url string, html string")
    literal = urls.filter_urls(pages, URL_RULES).select("page_id", "rule", "verdict").collect()
    monkeypatch.setattr(urls, "MAX_LITERAL_RULES", 0)
    assert sorted(urls.filter_urls(pages, URL_RULES).select("page_id", "rule", "verdict").collect()) == sorted(literal)
    assert urls.filter_urls(pages.where("false"), URL_RULES).count() == 0
    # rules of one length: an allow first, then the longer host, however many rules there are
    tie = [("a.com", "/x", "block"), ("com", "/xyz", "block"), ("b.org", "/x", "block"), ("org", "/xyz", "allow")]
    page = spark.createDataFrame([(1, "http://a.com/xyz"), (2, "http://b.org/xyz")], "page_id long, url string")
    for most in (0, 64):
        monkeypatch.setattr(urls, "MAX_LITERAL_RULES", most)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(page, tie).collect()} == {1: ("a.com/x", "block"), 2: ("org/xyz", "allow")}


# 2 secrets --------------------------------------------------------------------------------------


def brute_base(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate((
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    )):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def test_secrets(spark):
    hexa = "0123456789abcdef" * 2
    texts = [
        *ODD, f'é token = "{hexa}" x', "token=token:abcdefgh secret: ab password='hunter22'", f"AKIA{'A1' * 8} {hexa}{hexa}", "API_KEY=" + "k" * 9,
        "client_id = joe1234 then Xy9Zk2Lm8Qw4Rt6Vb1 at https://h.example.com/p", "Xy9Zk2Lm8Qw4Rt6Vb1 alone", "client_id = joe1234 alone",
        "client_id = joe1234 " + "far " * 100 + "Xy9Zk2Lm8Qw4Rt6Vb1", "AKIA" + "B2" * 8 + " Xy9Zk2Lm8Qw4Rt6Vb1", "token=" * 400,
    ]
    df = docs_of(spark, texts)
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.rank, s.end, s.kind) for s in got[i].base] == brute_base(t), t
        assert [s for s in got[i].spans if s.kind in secrets.BASE] == got[i].base
    kinds = {i: [s.kind for s in got[i].spans] for i in got}
    at = len(ODD) + 4
    assert kinds[at] == ["ident", "value", "endpoint"]
    assert kinds[at + 1] == [] and kinds[at + 2] == [] and kinds[at + 3] == []
    assert kinds[at + 4] == ["access", "value"]
    row = secrets.digest_columns(secrets.scan_secrets(df.where(f"doc_id = {len(ODD)}"))).first()
    line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_base(texts[len(ODD)]))
    assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and row.spans == line
    assert secrets.scan_secrets(df.where("false")).count() == 0


def brute_spans(text):
    """All spans by the rules of the method, each weak part against all others."""
    base = brute_base(text)
    over = lambda a, others: any(b[0] < a[2] and a[0] < b[2] for b in others)
    have, weak = list(base), []
    for kind in ("ident", "endpoint", "value"):
        rank, hits = secrets.KINDS.index(kind), [m for m in re.finditer(secrets.WEAK[kind][0], text)]
        if kind == "value":
            hits = [m for m in hits if all(re.search(p, m[0]) for p in secrets.HOLDS["value"])]
        new = [(m.start(), rank, m.end(), kind) for m in hits if not over((m.start(), rank, m.end()), have)]
        have, weak = have + new, weak + new
    near = lambda a, kinds: any(b[3] in kinds and b[0] <= a[2] + secrets.REACH and b[2] >= a[0] - secrets.REACH for b in have)
    i, v = (lambda a: near(a, secrets.IDENTIFIERS)), (lambda a: near(a, secrets.VALUES))
    return sorted([*base, *(w for w in weak if (w[3] == "value" and i(w)) or (w[3] == "ident" and v(w)) or (w[3] == "endpoint" and i(w) and v(w)))])


def test_secrets_against_brute_force_and_in_time(spark):
    """Random mixtures of parts, and 5000 weak triples in one text: time must not grow with their square."""
    import time

    rng = random.Random(4)
    pick = ["user = joe{}", "https://h{}.example.com/p?Ab3Ab3Ab3Ab3Ab3Ab3", "Xy9Zk2Lm8Qw4Rt6Vb{}", "token: abc{}defg", "AKIAABCDEFGHIJKLMN{}", "0123456789abcdef01234567{}", "10.0.0.{}", "login=Xy9Zk2Lm8Qw4Rt6Vb{}", "é" * 90, "plain words"]
    texts = [" ".join(rng.choice(pick).format(rng.randrange(10, 99)) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[5]), (None, texts[7]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in secrets.scan_secrets(df).collect())
    assert got == sorted((str(i), brute_spans(t or "")) for i, t in rows)
    triple = lambda k: f"user=joe{k} https://h{k}.example.com Xy9Zk2Lm8Qw4Rt6Vb{k}\n"
    began = time.time()
    found = secrets.scan_secrets(spark.createDataFrame([(1, "".join(map(triple, range(5000))))], "doc_id long, text string")).first()
    assert len(found.spans) == 15000 and time.time() - began < 40


# 3 mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mixing(spark):
    rng = random.Random(5)
    sources = [rng.choice(["a", "a", "a", "b", "c", "d", None]) for _ in range(400)]
    texts = [rng_text(rng, rng.choice([1, 5, 40, 200, 900])) for _ in sources]
    texts[3], texts[4] = None, ""
    df = docs_of(spark, texts, sources)
    rows = mixing.mix_sources(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    sizes = Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[sources[r.doc_id]]
        assert r.target == pytest.approx(want[sources[r.doc_id]])
        assert r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 5, (s, taken[s], t)
    assert sorted(mixing.mix_sources(df).collect(), key=lambda r: r.doc_id) == sorted(rows, key=lambda r: r.doc_id)
    assert mixing.mix_sources(df.where("false")).count() == 0
    assert mixing.mix_sources(docs_of(spark, [None, ""])).agg({"taken": "sum"}).first()[0] == 0


def test_pareto_inclusion_is_fair(spark):
    """Over many seeds each document of a length class is chosen about as often as expected."""
    df = docs_of(spark, [f"w{i} x y z" for i in range(40)], ["a"] * 10 + ["b"] * 30).cache()
    seen = Counter()
    for seed in range(12):
        seen.update({r.doc_id: r.copies for r in mixing.mix_sources(df, seed=seed).collect()})
    b = [seen[i] for i in range(10, 40)]
    assert all(seen[i] == 24 for i in range(10))  # source a takes two of each
    assert 0.9 * 12 * 40 <= sum(b) <= 1.1 * 12 * 40 and min(b) >= 12 and max(b) <= 24


# 4 lines ----------------------------------------------------------------------------------------


def test_line_dedup(spark):
    site = [f"s{i % 12}" for i in range(36)]
    texts = [f"Common  Line\nown {i}\n\ncommon line " for i in range(36)]
    texts[20] = "rare line\nown"
    texts[21], texts[22], texts[23] = None, "", "common line"
    texts += ["seven sites\nz"] * 7 + ["eight sites\ny"] * 8
    site += [f"s{i}" for i in range(7)] + [f"s{i}" for i in range(8)]
    df = docs_of(spark, texts, site)
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert set(lines.dedup_lines(df).columns) == {*df.columns, "n_lines", "n_removed"}
    assert out[0].text == texts[0] and out[0].n_removed == 0
    assert out[1].text == "own 1\n" and (out[1].n_lines, out[1].n_removed) == (4, 2)
    assert out[20].text == texts[20] and out[21].text is None and out[22].text == "" and out[23].text == ""
    assert all(out[i].text == texts[i] for i in range(36, 43))
    assert out[43].text == texts[43] and out[44].text == ""  # both lines stand on eight sites
    assert lines.dedup_lines(df.where("false")).count() == 0


# 5 language -------------------------------------------------------------------------------------

TONGUES = {"aa": "lo ka mi ta re", "bb": "zur wes pol hyn quo", "cc": "ёж да не вот мир"}


def tongue(rng, lang, n):
    part = TONGUES[lang].split()
    return " ".join("".join(rng.choice(part) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(6)
    langs = [rng.choice(list(TONGUES)) for _ in range(300)]
    texts = [tongue(rng, x, rng.randrange(8, 60)) for x in langs]
    model = langid.fit_languages(docs_of(spark, texts, langs=langs))
    assert model.languages == ["aa", "bb", "cc"]
    fresh = [rng.choice(list(TONGUES)) for _ in range(200)]
    test = [tongue(rng, x, 20) for x in fresh]
    mixed = tongue(rng, "aa", 40) + " " + tongue(rng, "bb", 20)
    odd = [None, "", "123 ###", "Ω Ψ", mixed, "x " * 5000]
    rows = {r.doc_id: r for r in langid.predict_languages(docs_of(spark, [*test, *odd]), model, spans=True).collect()}
    assert sum(rows[i].lang_pred == x for i, x in enumerate(fresh)) >= 195
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[200 + k].lang_pred for k in range(3)] == ["und"] * 3
    assert rows[203].lang_pred in model.languages
    spans = rows[204].spans
    assert [s.lang for s in spans] == ["aa", "bb"] and abs(spans[1].first - 40) <= 2 and rows[204].lang_pred == "aa"
    assert langid.fit_languages(docs_of(spark, ["a"]).where("false")) is None
    assert langid.predict_languages(docs_of(spark, ["a"]), None).first().lang_pred == "und"


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(0, 30, 5)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(size=(bounds[-1], 3)) * rng.choice([0.3, 2])
        best, fixed = langid._constant(scores, bounds, 2.5)
        found = langid._viterbi(scores, bounds, np.flatnonzero(sizes > 0), 2.5)
        for d, path in zip(np.flatnonzero(sizes > 0), found):
            s = scores[bounds[d] : bounds[d + 1]]
            value = lambda p: s[np.arange(len(s)), p].sum() - 2.5 * (np.diff(p) != 0).sum()
            v = s[0]
            for row in s[1:]:
                v = np.maximum(v, v.max() - 2.5) + row
            assert value(path) == pytest.approx(v.max())
            if fixed[d]:
                assert value(np.full(len(s), best[d])) == pytest.approx(v.max())


def test_viterbi_of_many_languages():
    scores = np.full((4, 200), -6.0)
    scores[:2, 150], scores[2:, 190] = 6.0, 6.0
    assert langid._viterbi(scores, np.array([0, 4]), np.array([0]), 3.0)[0].tolist() == [150, 150, 190, 190]


def brute_language(model, text, penalty=langid.SWITCH_PENALTY):
    """Main language and its share of letters, word by word in plain Python."""
    import pyarrow as pa

    mask = (1 << 64) - 1

    def mix(h):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> 33)) * c & mask
        return h ^ (h >> 33)

    def kind(ch):
        return [name for first, name in langid.SCRIPTS if first <= ord(ch)][-1]

    fold = {i: i + 32 for i in range(65, 91)}
    rows, letters, n_lang = [], [], len(model.languages)
    for word in words(text.translate(fold)):
        whole = next(iter(textnp.words_of(pa.array([word])))).hashes[0]
        data = [0, *(b + 1 for b in word.encode()), 0]
        codes = [b for b in data if b]
        for k in range(1, langid.MAX_ORDER):
            for i in range(len(data) - k):
                code = 0
                for b in data[i : i + k + 1]:
                    code = (code * 263 + b) & mask
                codes.append((code + (k << 56)) & mask)
        bucket = [int(whole) >> 48] + [mix(c) >> 48 for c in codes]
        score = np.clip(model.ratios[bucket].sum(0) * 2 / len(bucket) ** 0.5, -langid.WORD_BOUND, langid.WORD_BOUND)
        found = Counter(kind(c) for c in word if kind(c))
        script = langid.NAMES.index(min(found, key=lambda x: (-found[x], x)) if found else "")
        allowed = model.scripts[script]
        score = np.where(allowed, score, -langid.WORD_BOUND)
        rows.append(score if found and allowed.any() else np.zeros(n_lang))
        letters.append(sum(found.values()))
    if not sum(letters):
        return "und", 0.0
    value, back = list(rows[0]), []
    for row in rows[1:]:
        step = [max(range(n_lang), key=lambda j: value[j] - penalty * (j != i)) for i in range(n_lang)]
        back.append(step)
        value = [value[step[i]] - penalty * (step[i] != i) + row[i] for i in range(n_lang)]
    path = [int(np.argmax(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    share = Counter()
    for lang, n in zip(reversed(path), letters):
        share[lang] += n
    best = min(share, key=lambda x: (-share[x], x))
    return model.languages[best], share[best] / sum(letters)


def test_language_against_brute_force(spark):
    rng = random.Random(16)
    langs = [rng.choice(list(TONGUES)) for _ in range(120)]
    model = langid.fit_languages(docs_of(spark, [tongue(rng, x, 30) for x in langs], langs=langs))
    texts = [*ODD, *(" ".join(tongue(rng, rng.choice(list(TONGUES)), rng.randrange(1, 25)) for _ in range(rng.randrange(1, 5))) for _ in range(60)), "Ω ψ ka", "12 lo-ka ДА"]
    for r in langid.predict_languages(docs_of(spark, texts), model).collect():
        assert (r.lang_pred, pytest.approx(r.score)) == brute_language(model, texts[r.doc_id] or ""), texts[r.doc_id]


# 6 Jaccard --------------------------------------------------------------------------------------


def brute_components(texts, k, num, den):
    fold = {i: i + 32 for i in range(65, 91)}
    sets = []
    for t in texts:
        w = words((t or "").translate(fold))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "num", "common_from", "bucket", "fan"), [(4, 85, 24, 256, 1000), (5, 80, 10**9, 3, 4)])
def test_jaccard_components(spark, monkeypatch, k, num, common_from, bucket, fan):
    """Common shingles known or not, keys of few groups dealt by further shingles, leaders in parts."""
    monkeypatch.setattr(jaccard, "COMMON_FROM", common_from)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "FAN", fan)
    rng = random.Random(7)
    texts = [*ODD, "A b C", "a B c", "one two three"]
    for _ in range(12):
        base = rng_text(rng, rng.choice([9, 30, 120, 400]))
        texts += [edit(rng, base, rng.randrange(0, 4 + len(base) // 120)) for _ in range(rng.choice([1, 2, 8, 25]))]
    passage = rng_text(rng, 60)
    texts += [f"{rng_text(rng, 12)} {passage} {rng_text(rng, 10)}" for _ in range(40)]
    chain = rng_text(rng, 200).split(" ")
    for k in range(8):
        chain = [*chain[6:], *rng_text(rng, 6).split(" ")]
        texts.append(" ".join(chain))
    texts += texts[20:30]
    texts = [t and f"{t} it is in every text" for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts), k=k, num=num).collect()}
    assert got == brute_components(texts, k, num, 100)
    assert jaccard.jaccard_components(docs_of(spark, texts).where("false")).count() == 0


def test_common_shingles_across_tasks(spark, monkeypatch):
    """A shingle that each block holds but once is common all the same, and the most common go first into a full bit set."""
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    texts = [f"{'often in every text ' if i % 2 else ''}here are four words own{i} words alone" for i in range(60)]
    docs = docs_of(spark, texts).repartition(7)
    every, half = "here are four words", "often in every text"

    def level(bits, text):
        batch = pa.RecordBatch.from_pydict({"text": pa.array([text], pa.large_string())})
        return int(jaccard._levels(bits, next(jaccard._sets(batch, 4))[1])[0])

    bits = jaccard.common_shingles(docs, 4)
    assert level(bits, every) >= level(bits, half) > 0 and level(bits, "four words own1 words") == 0
    monkeypatch.setattr(jaccard, "LEVEL_FACTOR", 2)
    monkeypatch.setattr(jaccard, "COMMON_FROM", 20)
    bits = jaccard.common_shingles(docs, 4)
    assert level(bits, every) == 2 and level(bits, half) == 1
    monkeypatch.setattr(jaccard, "COMMON_SHARE", jaccard.COMMON_BITS // 3)
    bits = jaccard.common_shingles(docs, 4)
    assert level(bits, every) == 2 and level(bits, half) == 0


# 7 decontamination ------------------------------------------------------------------------------


def test_decontamination_recall_and_exactness(spark):
    rng = random.Random(8)
    items = [rng_text(rng, n, 5000) for n in (3, 5, 8, 14, 20, 30, 45, 70) for _ in range(6)]
    texts, planted = [*ODD], []
    for q, item in enumerate(items):
        n = len(item.split(" "))
        for share in (0, 0.1, 0.2):
            planted.append((len(texts), q, n))
            texts.append(f"{rng_text(rng, rng.randrange(90), 5000)} {edit(rng, item, int(n * share)).upper()}, {rng_text(rng, 50, 5000)}")
    texts += [rng_text(rng, 300, 5000) for _ in range(40)]
    bench = spark.createDataFrame([*enumerate(items), (900, None), (901, "")], "item_id long, text string")
    rows = decontaminate.find_leaks(docs_of(spark, texts), bench).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    long_enough = [p for p in planted if p[2] >= decontaminate.MIN_TERMS]
    hit = sum((d, q) in found for d, q, _ in long_enough)
    assert hit >= 0.97 * len(long_enough)
    assert {d for d, _ in found} <= {d for d, _, _ in planted}
    for r in rows:
        term = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (texts[r.doc_id] or "").lower())[r.first_term : r.end_term]
        item = items[r.item_id].split(" ")
        table = list(range(len(item) + 1))
        for i, x in enumerate(term, 1):
            before, table = table, [i]
            for j, y in enumerate(item, 1):
                table.append(min(before[j] + 1, table[-1] + 1, before[j - 1] + (x != y)))
        assert table[-1] == r.edits <= len(item) // 5
    assert decontaminate.find_leaks(docs_of(spark, texts), bench.where("false")).count() == 0


def test_decontamination_recall_of_the_shortest_items(recwarn):
    """Items at the lower end of a class among many long ones, with all edits of the limit used up."""
    rng = np.random.default_rng(21)
    for least, most in ((5, 9), (10, 19), (20, 39), (24, 300), (40, 79)):
        terms = [rng.integers(1 << 62, size=least if q < 150 else most, dtype=np.uint64) for q in range(250)]
        index = decontaminate.ItemIndex(np.arange(250), terms, 20).build(0.99)
        for even in (False, True):
            hit = 0
            for q in range(150):
                e = decontaminate._edited(rng, terms[q], least // 5, even)
                h = np.concatenate([rng.integers(1 << 62, size=int(rng.integers(50)), dtype=np.uint64), e, rng.integers(1 << 62, size=90, dtype=np.uint64)])
                hit += any(m[1] == q for m in decontaminate._matches(index, h, np.array([0, len(h)])))
            assert hit >= 147, (least, most, even, hit)
    assert not recwarn.list
    same = decontaminate.ItemIndex(np.arange(2), [np.full(30, 7, np.uint64), np.arange(4, dtype=np.uint64)], 20).build(0.99)
    assert [m[1] for m in decontaminate._matches(same, np.array([0, 1, 2, 3, 9], np.uint64), np.array([0, 5]))] == [1]  # short: exact


def test_decontamination_against_all_stretches(spark):
    """Small texts of few different terms: everything reported is within the limit, and what is left out by
    chance is little."""
    rng = random.Random(22)
    items = [rng_text(rng, n, 40) for n in (3, 4, 6, 9, 12, 15, 20) for _ in range(3)]
    texts = [" ".join([rng_text(rng, rng.randrange(30), 40), edit(rng, rng.choice(items), rng.randrange(3)), rng_text(rng, 9, 40)]) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    want = {}
    for d, text in enumerate(texts):
        for q, item in enumerate(items):
            w, row = item.split(" "), [0] * (len(text.split()) + 1)
            for i, y in enumerate(w, 1):
                last, row = row, [i]
                for j, x in enumerate(text.split(), 1):
                    row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if min(row) <= len(w) // 5:
                want[d, q] = min(row)
    assert all(want.get(k, 99) <= e for k, e in got.items()) and len(got) >= 0.97 * len(want)


# 8 quality --------------------------------------------------------------------------------------


def brute_rules(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality(spark, monkeypatch):
    rng = random.Random(9)
    texts = [*ODD, "a b c a b c\nx y\nx y\n\nx y\n é", "line\n" * 80]
    y = []
    for _ in range(260):
        good = rng.random() < 0.7
        t = rng_text(rng, 80)
        texts.append(t if good else " ".join(x + rng.choice(["###", "$$$", "!!"]) for x in t.split(" ")))
        y.append((len(texts) - 1, int(good), 0))
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([*y[:200], (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels)
    monkeypatch.setattr(textnp, "SLICE", 4000)
    rows = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    # the fixed counts in SQL as well
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert sorted(con.execute(OP8_RULES).fetchall()) == sorted(tuple(rows[i][c] for c in names) for i in rows)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t), t
        assert not (r.base_failed and r.kept)
    assert sum((rows[i].p_good >= 0.5) == bool(g) for i, g, _ in y[200:]) >= 57
    assert quality.fit_quality(df, labels.where("quality = 1")) is None
    assert quality.score_quality(df.where("false"), model).count() == 0
    assert quality.score_quality(df, None).where("kept").count() > 0


# 9 toxicity -------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(10)
    texts, y = [*ODD], []
    for _ in range(500):
        bad, t = rng.random() < 0.25, rng_text(rng, 60).split(" ")
        for _ in range(rng.randrange(2, 9) if bad else 0):
            t[rng.randrange(60)] = rng.choice(["Grob!", "fies,", "übel"])
        texts.append(" ".join(t))
        y.append((len(texts) - 1, 1, int(bad)))
    df = docs_of(spark, texts)
    model = toxicity.fit_toxicity(df, spark.createDataFrame(y[:350], "doc_id long, quality int, toxic int"))
    assert len(model.theta) == toxicity.GRADES and (np.diff(model.theta) > 0).all()
    rows = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert sum(rows[i].toxic == bool(t) for i, _, t in y[350:]) >= 147
    assert all(0 <= r.severity <= toxicity.GRADES for r in rows.values()) and not any(rows[i].toxic for i in range(len(ODD)))
    mild, harsh = docs_of(spark, ["a grob b", "grob " * 9 + "fies " * 9]), None
    mild, harsh = (r.severity for r in toxicity.score_toxicity(mild, model).orderBy("doc_id").collect())
    assert harsh > mild
    assert toxicity.fit_toxicity(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert not toxicity.score_toxicity(df, None).where("toxic").count()


def test_toxicity_scores_against_brute_force(spark):
    import pyarrow as pa

    of = lambda x, terms: next(iter(textnp.words_of(pa.array([x]), lower=True, terms=terms))).hashes[0]
    begin = lambda x, n: textnp.span_hashes(toxicity._LETTER[np.frombuffer(x.encode(), np.uint8)], toxicity._BASE, np.array([0]), np.array([n]))[0]
    weight = {of("grob", True): 1.5, begin("fies", 4): 0.7, begin("übelst", 6): 2.0, of("nett", True): -1.0}
    terms = np.sort(np.array(list(weight), np.uint64))
    model = toxicity.ToxicityModel(terms, np.array([weight[t] for t in terms]), np.array([0.5, 1.5, 3.0]))
    rng = random.Random(17)
    texts = [*ODD, *(" ".join(rng.choice(["Grob!", "fieser", "fies", "ÜBELSTE", "übelste", "nett", "nette,", "so"]) for _ in range(rng.randrange(1, 30))) for _ in range(40))]
    for r in toxicity.score_toxicity(docs_of(spark, texts), model).collect():
        seen = Counter()
        for t in re.findall(r"[a-z0-9\x80-\U0010ffff]+", (texts[r.doc_id] or "").translate({i: i + 32 for i in range(65, 91)})):
            seen[of(t, True)] += 1
            seen.update(begin(t, n) for n in toxicity.PREFIXES if len(t.encode()) >= n)
        score = sum(weight[t] * np.log1p(n) for t, n in seen.items() if t in weight)
        up = 1 / (1 + np.exp(-(score - model.theta)))
        assert (r.severity, r.p_toxic) == (pytest.approx(up.sum()), pytest.approx(up[0]))
        assert (r.grade, r.toxic) == ((up >= 0.5).sum(), up[0] >= 0.5)


# 10 substrings ----------------------------------------------------------------------------------


def brute_substrings(texts, window):
    first, out = {}, {}
    w = [words(t) for t in texts]
    for i, x in enumerate(w):
        for j in range(len(x) - window + 1):
            first.setdefault(tuple(x[j : j + window]), i)
    for i, x in enumerate(w):
        gone = set()
        for j in range(len(x) - window + 1):
            if first[tuple(x[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out[i] = (len(x), len(gone), " ".join(v for j, v in enumerate(x) if j not in gone))
    return out


@pytest.mark.parametrize(("window", "bits"), [(50, 1 << 26), (9, 1 << 26), (9, 8)])
def test_substring_dedup(spark, monkeypatch, window, bits):
    """bits 8: what repeats is joined to the documents instead of looked up."""
    monkeypatch.setattr(substring, "FILTER_BITS", bits)
    rng = random.Random(11)
    passage = [rng_text(rng, n) for n in (49, 50, 51, 120, 9, 12)]
    texts = [*ODD]
    for _ in range(60):
        texts.append(" ".join(rng.choice([rng_text(rng, rng.randrange(30)), rng.choice(passage), "w " * 70]) for _ in range(4)))
    texts += texts[12:18]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(docs_of(spark, texts), window).collect()}
    assert got == brute_substrings(texts, window)
    assert substring.dedup_substrings(docs_of(spark, texts).where("false"), window).count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_substrings_of_ids_with_several_texts(spark, monkeypatch, bits):
    """Each text of an id is cut by its own words, also where one is a copy or shorter than another."""
    monkeypatch.setattr(substring, "FILTER_BITS", bits)
    rng = random.Random(12)
    a, b, c = (rng_text(rng, n, 10**6) for n in (60, 70, 100))
    rows = [(1, a), (2, a), (2, b), (3, f"{c} {a}"), (3, "q " * 10), (3, f"{b} {a}"), (4, b), (4, f"{a} {b}"), (5, None), (5, c), (None, a), (None, None), (6, c), (6, c)]

    def brute():
        first = {}
        for i, t in rows:
            w = words(t)
            for j in range(len(w) - 49):
                if i is not None:
                    first[tuple(w[j : j + 50])] = min(i, first.get(tuple(w[j : j + 50]), i))
        for i, t in rows:
            w, gone = words(t), set()
            for j in range(len(w) - 49):
                if i is not None and first[tuple(w[j : j + 50])] < i:
                    gone |= set(range(j, j + 50))
            yield str(i), len(w), len(gone), " ".join(v for j, v in enumerate(w) if j not in gone)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(df).collect()) == sorted(brute())


def test_held_out_rule_is_crc32(spark):
    row = spark.sql("SELECT crc32(encode('123', 'UTF-8')) AS c").first()
    assert row.c == zlib.crc32(b"123")


# faults of earlier forms -------------------------------------------------------------------------


def test_letters_are_told_by_category(spark):
    """Letters of any script make a text one with letters; digits, marks and signs of a script don't."""
    model = langid.fit_languages(docs_of(spark, ["the cat sat " * 9, "le chat est " * 9], langs=["en", "fr"]))
    some = ["𞤀𞤁", "𐌰𐌱", "𝐀𝐁", "ℝ", "ʼ", "ª", "中"]
    none = ["٣٤", "३४", "๓", "،", "־", "12", "€", "", None, "्"]
    got = [r.lang_pred for r in langid.predict_languages(docs_of(spark, [*some, *none]), model).orderBy("doc_id").collect()]
    assert all(g in ("en", "fr") for g in got[: len(some)]) and got[len(some) :] == ["und"] * len(none)


def test_long_values_are_linked(spark):
    text = "user=abcdef " + "Ab1" * 200
    found = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.end) for s in found.spans] == [("ident", 0, 11), ("value", 12, 612)]


def test_long_words_are_told_apart():
    import pyarrow as pa

    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    (w,) = textnp.words_of(pa.array([f"{word} {other} {word} {word[:200]}"]))
    assert w.hashes[0] != w.hashes[1] and w.hashes[0] == w.hashes[2]


def test_items_with_one_opening(monkeypatch):
    """Items that share their first terms and a text that repeats the opening: candidates come in bounded parts."""
    rng = random.Random(6)
    opening = [f"o{k}" for k in range(12)]
    items = [" ".join(opening + [f"i{rng.randrange(10**6)}" for _ in range(28)]) for _ in range(200)]
    text = " ".join(" ".join(opening + [f"t{rng.randrange(10**6)}" for _ in range(28)]) for _ in range(120)) + " " + items[7]
    index = decontaminate.ItemIndex(np.arange(len(items)), decontaminate.item_terms(items), 20).build(0.95)
    (terms,) = decontaminate.item_terms([text])
    bounds = np.array([0, len(terms)])
    whole = decontaminate._matches(index, terms, bounds)
    monkeypatch.setattr(decontaminate, "PART", 4000)
    parts = [len(p) for p in decontaminate._candidates(index, terms, bounds)]
    assert len(parts) > 3 and max(parts) < 4000 + 200 * 60
    assert decontaminate._matches(index, terms, bounds) == whole and [m[1] for m in whole] == [7]


def test_walks_reach_the_end_of_their_windows():
    for c in range(6):
        depths = [decontaminate._bands(c, r)[0] for r in range(200)]
        assert max(depths) > 1.6 * decontaminate._class(c)[0]


def test_bit_sets_take_few_jobs(spark):
    from eventloom.llm import bits

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bits", "bits")
        found = bits.build(spark.range(0, 3000, 3), 1 << 23)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert bits.holds(found, np.arange(0, 3000, 3), 1 << 23).all() and bits.holds(found, np.arange(1, 3000, 3), 1 << 23).sum() < 50
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bits")) < 10


def test_pairs_send_prefixes_of_their_groups_only(spark):
    from pyspark.sql import functions as F

    prefix = F.expr("transform(sequence(0L, 5L), x -> 10 * (id DIV 2) + x)")
    heads = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(20).alias("n"), prefix.alias("prefix"))
    pairs = spark.createDataFrame([(6, 7), (7, 8)], "gid long, gid2 long")
    found = jaccard._possible(pairs, heads, 85, 100)
    assert [tuple(r) for r in found.collect()] == [(6, 7)]
    read = {f.rsplit("/", 1)[0] for f in found.inputFiles() if "prefixes" in f}
    assert read and 3 <= spark.read.parquet(*read).count() < 100
