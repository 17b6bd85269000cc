"""Numbers: money, promotions, vectors and distances as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

EARTH_METRES = 6_371_000.0


def money(value: Column) -> Column:
    """Rounded to hundredths, halves up; what is a hair below a half by its binary form counts as a half."""
    return F.floor(value * 100 + 0.5000001) / 100.0


def minor_units(value: Column) -> Column:
    """Hundredths as a long, or null where the value has more than two decimals or isn't finite."""
    scaled = F.round(value * 100, 0)
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e13) & (F.abs(value * 100 - scaled) < 1e-6)
    return F.when(ok, scaled.cast("long"))


def parse_money(text: Column) -> Column:
    """An amount with Turkish or English separators and k / bin for thousands; null if it isn't one."""
    flat = F.regexp_replace(F.lower(F.trim(text)), r"\s*(tl|try|lira|₺)$", "")
    thousand = flat.rlike(r"(?:k|bin)$")
    digits = F.trim(F.regexp_replace(flat, r"\s*(?:k|bin)$", ""))
    plain = (
        F.when(digits.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$"), F.translate(F.translate(digits, ".", ""), ",", "."))
        .when(digits.rlike(r"^\d{1,3}(,\d{3})+(\.\d{1,2})?$"), F.translate(digits, ",", ""))
        .when(digits.rlike(r"^\d+([.,]\d{1,2})?$"), F.translate(digits, ",", "."))
    )
    return plain.try_cast("double") * F.when(thousand, 1000.0).otherwise(1.0)


#: Number words on folded text.  Fixed values.
NUMBER_WORDS = {
    **{w: i for i, w in enumerate("sifir bir iki uc dort bes alti yedi sekiz dokuz on".split())},
    **{w: 10 * i for i, w in enumerate("yirmi otuz kirk elli altmis yetmis seksen doksan".split(), 2)},
    **{w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())},
    **{w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)},
}


def _below_hundred(tokens: Column) -> Column:
    """One number word, or tens and a unit; null for anything else."""
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    first, second = F.try_element_at(words, F.get(tokens, 0)), F.try_element_at(words, F.get(tokens, 1))
    both = F.when((first >= 10) & (first % 10 == 0) & second.between(1, 9), first + second)
    return F.when(F.size(tokens) == 1, first).when(F.size(tokens) == 2, both)


def _split(tokens: Column, words: Sequence[str]) -> tuple[Column, Column, Column]:
    """The tokens before and after the one that is among words, and how many such there are."""
    scale = lambda t: t.isin(*words)
    at = F.coalesce(F.array_position(F.transform(tokens, scale), True), F.lit(0))
    head = F.when(at > 1, F.slice(tokens, 1, (at - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return head, F.slice(tokens, (at + 1).cast("int"), F.greatest(F.size(tokens), F.lit(1))), F.size(F.filter(tokens, scale))


def _below_thousand(tokens: Column) -> Column:
    """A number with at most one word for hundred, before which a number of 1 to 19 may stand."""
    head, rest, hundreds = _split(tokens, ("yuz", "hundred"))
    times = F.when(F.size(head) == 0, 1).otherwise(_below_hundred(head))
    more = F.when(F.size(rest) == 0, 0).otherwise(_below_hundred(rest))
    return F.when(hundreds == 0, _below_hundred(tokens)).when((hundreds == 1) & times.between(1, 19), 100 * times + more)


def word_number(text: Column) -> Column:
    """The value, 0 to 100000, of number words in Turkish or English; null if the text isn't one number."""
    tokens = F.filter(F.split(F.trim(fold(text)), r"\s+"), lambda t: t != "")
    head, rest, thousands = _split(tokens, ("bin", "thousand"))
    times = F.when(F.size(head) == 0, 1).otherwise(_below_thousand(head))
    more = F.when(F.size(rest) == 0, 0).otherwise(_below_thousand(rest))
    value = F.when(thousands == 0, _below_thousand(tokens)).when((thousands == 1) & (times > 0), 1000 * times + more)
    return F.when(value <= 100_000, value.cast("int"))


#: Least probability of a label and least distance to the next one.  Fixed values.
LABEL_LEAST, LABEL_MARGIN = 0.6, 0.15


def confident_label(probabilities: Column) -> Column:
    """The key of a map of probabilities with the highest one, if that is high enough and far enough from the next."""
    falling = F.sort_array(F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))), False)
    top = F.get(falling, 0)
    second = F.coalesce(F.get(falling, 1)["p"], F.lit(0.0))
    return F.when((top["p"] >= LABEL_LEAST) & (top["p"] - second >= LABEL_MARGIN), top["k"])


def promotion(price: Column, tickets: Column, qualifying: Column, fee: Column, kind: Column, amount: Column, get: Column, cap: Column) -> dict[str, Column]:
    """Checkout figures of a promotion: percentage, fixed per ticket, buy_get (amount: buy) or cashback.

    Unknown fees or an unknown number of qualifying tickets leave the total unknown."""
    base = money(price * tickets)
    fees = money(fee * tickets)
    limit = lambda x: money(F.when(cap.isNull(), x).otherwise(F.least(x, cap)))
    share = limit(price * qualifying * amount / 100)
    free = F.floor(qualifying / (amount + get)) * get
    discount = (
        F.when(qualifying.isNull(), F.lit(None).cast("double"))
        .when(kind == "percentage", share)
        .when(kind == "fixed", limit(amount * qualifying))
        .when(kind == "buy_get", money(price * F.when(cap.isNull(), free).otherwise(F.least(free, cap))))
        .when(kind == "cashback", F.lit(0.0))
    )
    cashback = F.when((kind == "cashback") & qualifying.isNotNull(), share)
    total = money(base - discount + fees)
    status = F.when(qualifying.isNull() | fee.isNull(), "conditional").otherwise("verified")
    return {"base_total": base, "discount": discount, "cashback": cashback, "fees": fees, "checkout_total": total, "status": status}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def valid_vector(v: Column, dimension: int) -> Column:
    """A vector of the dimension, finite, and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or different lengths."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), _dot(a, b) / scale).otherwise(F.lit(0.0))


def distance_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_METRES
