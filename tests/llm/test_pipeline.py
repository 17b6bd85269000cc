"""The pipeline's stages, one by one and together, on a small corpus."""

import random

import pytest

pytest.importorskip("eventloom.llm")
import corpus_pipeline  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(20)
    part = {"en": "the on ing er ti ha", "de": "sch ein ung ver ich"}
    make = lambda lang, n: " ".join("".join(rng.choice(part[lang].split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    item = make("en", 40)
    rows = [(make("en", 60), "en") for _ in range(60)] + [(make("de", 60), "de") for _ in range(30)]
    rows += [(rows[0][0], "en"), (rows[1][0] + " extra", "en"), (make("en", 20) + " " + item + " " + make("en", 9), "en")]
    rows += [(None, "en"), ("123 456", "en"), ("", None)]
    rows += [("The very same footer line.\n" + make("en", 50), "en") for _ in range(12)]
    data = [(i, t, lang, f"s{i % 10}", len(t or "")) for i, (t, lang) in enumerate(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[k] = {r.doc_id: r for r in docs.collect()}
    n = len(rows)
    assert set(kept[0]) == set(range(n)) - {93, 94, 95}  # no letter, no text
    assert set(kept[1]) == set(kept[0])
    assert kept[1][96].text == rows[96][0] and not any("footer" in kept[1][i].text for i in range(97, n))
    assert kept[1][97].n_chars == len(kept[1][97].text)
    assert set(kept[1]) - set(kept[2]) == {90, 91}  # the copy and the near copy; the first of each stays
    assert set(kept[2]) - set(kept[3]) == {92}
    assert set(kept[4]) == set(kept[3]) and sum(r.taken for r in kept[4].values()) > 0
    run = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {i: r.taken for i, r in kept[4].items()}


def test_near_copies_of_ids_with_several_texts(spark, tmp_path):
    """Only the text that is a copy goes, not the other text of its id."""
    rng = random.Random(3)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (None, a, "en", "s", 1), (3, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.ngram_jaccard(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((str(i), str(t)) for i, t, *_ in rows if (i, t) != (2, a))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_and_odd_tables(spark, tmp_path, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept long, gone string, row int, key string"
    odd = [(None, None, None, None, None, 1, "g", 2, "k"), (1, "a b c d e f", None, None, None, 1, None, 2, "k"), (1, "a b c d e f", None, None, None, 1, None, 2, "k")]
    spark.createDataFrame([(0, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    out = stage(spark, spark.createDataFrame(odd, schema), str(tmp_path))
    rows = out.collect()
    if k < 4:  # without a labelled row no language is known, and nothing is rejected
        assert len(rows) == 3 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "gone", "row", "key"]
    else:
        assert len(rows) == 3
