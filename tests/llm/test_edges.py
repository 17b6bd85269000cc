"""Null ids, repeated rows, extra columns with clashing names and empty tables in every operator."""

import pytest

pytest.importorskip("eventloom.llm")
from eventloom.llm import decontaminate, jaccard, langid, lines, mixing, quality, secrets, substring, toxicity, urls  # noqa: E402

CLASH = "n size key row h p u t k lines line gone kept cuts words spans base first last bucket need edge whole lead component".split()
ROWS = [(None, None), (None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, ""), (3, "x " * 60), (4, "x " * 60)]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, None, None, None, *[7] * len(CLASH)) for i, t in ROWS]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (1, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, _: secrets.digest_columns(secrets.scan_secrets(d)),
    "mixing": lambda d, _: mixing.mix_sources(d),
    "lines": lambda d, _: lines.dedup_lines(d),
    "langid": lambda d, _: langid.predict_languages(d, langid.fit_languages(d)),
    "jaccard": lambda d, _: jaccard.jaccard_components(d),
    "quality": lambda d, y: quality.score_quality(d, quality.fit_quality(d, y)),
    "toxicity": lambda d, y: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, y)),
    "substring": lambda d, _: substring.dedup_substrings(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, name):
    out = OPERATORS[name](docs, labels)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, _ in ROWS)
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0


def test_values_at_the_edges(docs):
    sets = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert sets == {(None, 0, None), (None, 3, None), (1, 3, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)}
    cut = {(r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_substrings(docs).collect()}
    assert cut == {(None, 0, 0), (None, 7, 0), (1, 7, 0), (2, 0, 0), (3, 60, 0), (4, 60, 60)}
    assert all(r.taken in (r.size, 2 * r.size) for r in mixing.mix_sources(docs).collect())  # 150 % of one source


def test_leaks_at_the_edges(spark, docs):
    items = spark.createDataFrame([(None, "A, b c d e f g!", 1), (5, "a b c d e f g", 2), (6, None, 3), (7, "a b", 4)], "item_id long, text string, h int")
    found = sorted(((str(r.doc_id), str(r.item_id), r.edits) for r in decontaminate.find_leaks(docs, items).collect()))
    assert found == sorted((d, q, 0) for d in ("None", "1", "1") for q in ("None", "5"))
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "None"]


def test_urls_at_the_edges(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "x://A", "<link rel=canonical>", 1), (1, "x://A", "<link rel=canonical>", 1), (2, "://", "", 1)], "page_id long, url string, html string, host int")
    got = sorted((str(r.page_id), r.host, r.path, r.verdict) for r in urls.filter_urls(pages, [("a", "", "block")]).collect())
    assert got == [("1", "a", "", "block"), ("1", "a", "", "block"), ("2", "", "", "allow"), ("None", "", "", "allow")]
    assert urls.filter_urls(pages, []).where("verdict = 'allow'").count() == 4
