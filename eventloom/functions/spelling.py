"""Spelling: optimal string alignment distance in columns, and candidates from an index of deletions.

Two words within d edits or swaps have a form in common that both reach by deleting d letters at most, so the
deletions of the lexicon's words are an index: a word is looked up by its own deletions, by equality, and
only what meets there is measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that a place name may take.  Fixed values.
SUFFIXES = "dan den tan ten nda nde ya ye da de ta te na ne a e".split()
#: Letters that are left of a word without its ending.
LEAST_STEM = 4


def osa_distance(a: Column, b: Column) -> Column:
    """Edits and swaps of neighbours that turn a into b, no part edited twice."""
    n, m = F.length(a), F.length(b)
    letter = lambda s, i: F.substring(s, i, F.lit(1))
    one = F.lit(1)

    def row(acc: Column, i: Column) -> Column:
        x = letter(a, i)

        def cell(done: Column, j: Column) -> Column:
            y = letter(b, j)
            plain = F.least(F.get(acc["row"], j) + 1, F.get(done, j - 1) + 1, F.get(acc["row"], j - 1) + (x != y).cast("int"))
            swap = F.when((i > 1) & (j > 1) & (x == letter(b, j - 1)) & (letter(a, i - 1) == y), F.get(acc["before"], j - 2) + 1)
            return F.concat(done, F.array(F.least(plain, swap)))

        return F.struct(F.aggregate(F.sequence(one, m), F.array(i), cell).alias("row"), acc["row"].alias("before"))

    first = F.sequence(F.lit(0), m)
    whole = F.aggregate(F.sequence(one, n), F.struct(first.alias("row"), first.alias("before")), row, lambda acc: F.element_at(acc["row"], -1))
    return F.when(n == 0, m).when(m == 0, n).otherwise(whole)


def deletions(word: Column, most: int) -> Column:
    """The word and all that is left of it without ``most`` letters or fewer."""
    without = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    forms = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, without)))
        forms = F.concat(forms, last)
    return F.array_distinct(forms)


def candidates(words: DataFrame, lexicon: DataFrame, word: str, entry: str, limit: int = 1) -> DataFrame:
    """(word, entry, distance) of entries within a distance of each word, but the word itself."""
    keyed = lexicon.select(entry).distinct().select(entry, F.explode(deletions(F.col(entry), limit)).alias("k"))
    probe = words.select(word).distinct().select(word, F.explode(deletions(F.col(word), limit)).alias("k"))
    pairs = probe.join(keyed, "k").select(word, entry).distinct().where(F.col(word) != F.col(entry))
    near = pairs.where(F.levenshtein(word, entry, 2 * limit) >= 0)  # a swap is two plain edits
    return near.withColumn("distance", osa_distance(F.col(word), F.col(entry))).where(F.col("distance") <= limit)


def near_pairs(df: DataFrame, block: list[str], id_col: str, text: str, limit: int = 1) -> DataFrame:
    """(id, id2) with id < id2 of one block whose texts are within a number of plain edits: pairs meet by their
    deletions, so no block is compared all with all.  Rows of one text meet through their least id."""
    own = df.select(*block, id_col, text)
    heads = own.groupBy(*block, text).agg(F.min(id_col).alias("head"))
    keyed = heads.select(*block, text, F.explode(deletions(F.col(text), limit)).alias("_k"))
    other = keyed.select(*block, "_k", F.col(text).alias("_text2"))
    texts = keyed.join(other, [*block, "_k"]).where(F.levenshtein(text, "_text2", limit) >= 0).select(*block, text, "_text2").distinct()
    far = own.select(*block, F.col(id_col).alias(f"{id_col}2"), F.col(text).alias("_text2"))
    return own.join(texts, [*block, text]).join(far, [*block, "_text2"]).where(F.col(id_col) < F.col(f"{id_col}2")).select(id_col, f"{id_col}2")


def most_edits(target: Column, kind: Column) -> Column:
    """Edits that a target of the lexicon allows: two from eight letters on, one from five, else one for companions only."""
    n = F.length(target)
    return F.when(n >= 8, 2).when(n >= 5, 1).when(kind == "companion", 1).otherwise(0)


def suggestions(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, entry, kind): what a folded token may have been meant to be.

    lexicon: (entry, kind, aliases).  A token is tried as it stands and without an ending, against the entry and
    its aliases; kinds of which the token is an entry as it stands give nothing.  An alias that is met exactly
    counts; the entry itself doesn't."""
    ends = F.array(*map(F.lit, SUFFIXES))
    cut = F.transform(F.filter(ends, lambda s: F.endswith("token", s) & (F.length("token") - F.length(s) >= LEAST_STEM)), lambda s: F.substring("token", F.lit(1), F.length("token") - F.length(s)))
    forms = tokens.where("token IS NOT NULL").select("token").distinct().select("token", F.explode(F.array_distinct(F.concat(F.array("token"), cut))).alias("form"))
    entries = lexicon.select("entry", "kind", F.explode(F.array_distinct(F.concat(F.array("entry"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("target")).distinct()
    entries = entries.withColumn("most", most_edits(F.col("target"), F.col("kind")))
    by_limit = lambda c, m: F.when(m == 2, deletions(c, 2)).when(m == 1, deletions(c, 1)).otherwise(F.array(c))
    index = entries.select("entry", "kind", "target", "most", F.explode(by_limit(F.col("target"), F.col("most"))).alias("k"))
    asked = forms.select("token", "form", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("most"))
    asked = asked.select("token", "form", "most", F.explode(by_limit(F.col("form"), F.col("most"))).alias("k"))
    met = asked.join(index, ["most", "k"]).select("token", "form", "entry", "kind", "target", "most").distinct()
    alias = (F.col("form") == F.col("target")) & (F.col("target") != F.col("entry"))
    close = (F.col("form") != F.col("entry")) & (F.levenshtein("form", "target", 4) >= 0) & (osa_distance(F.col("form"), F.col("target")) <= F.col("most"))
    found = met.where(alias | close).select("token", "entry", "kind").distinct()
    exact = forms.join(lexicon.select(F.col("entry").alias("form"), "kind"), "form").select("token", "kind").distinct()
    return found.join(exact, ["token", "kind"], "left_anti").select("token", "entry", "kind")
