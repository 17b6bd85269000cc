"""Districts, neighbourhoods and sides of the city, read from labels and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DISTRICTS, fold

#: Districts on the Asian side; all others are on the European side.  Fixed values.
ASIAN = "adalar atasehir beykoz cekmekoy kadikoy kartal maltepe pendik sancaktepe sultanbeyli sile tuzla umraniye uskudar".split()
#: Neighbourhoods by district; "" where only the side is known.  Fixed values.
EUROPEAN_PLACES = {
    "beyoglu": "taksim, karakoy, galata, cihangir, tophane, istiklal, pera, sishane, tunel, kasimpasa, haskoy, sutluce",
    "sisli": "nisantasi, bomonti, harbiye, mecidiyekoy, kurtulus, ferikoy, cevahir, tesvikiye, esentepe",
    "besiktas": "bebek, ortakoy, etiler, arnavutkoy koyu, zorlu, gayrettepe, balmumcu",
    "sariyer": "maslak, emirgan, rumelihisari, tarabya, ayazaga",
    "fatih": "balat, fener, sultanahmet, tarihi yarimada, eminonu, kumkapi, cagaloglu, beyazit, vefa",
    "bakirkoy": "florya, yesilkoy",
    "eyupsultan": "kemerburgaz",
    "bahcelievler": "yenibosna",
    "": "levent, dolapdere",
}
ASIAN_PLACES = {
    "kadikoy": "moda, caddebostan, suadiye, bostanci, fenerbahce, goztepe, erenkoy, yeldegirmeni, kozyatagi, kalamis, bahariye",
    "uskudar": "kuzguncuk, cengelkoy, altunizade",
    "beykoz": "anadoluhisari, kanlica",
    "maltepe": "kucukyali",
    "": "bagdat caddesi, acibadem",
}
#: Labels that name a side.  Fixed values.
SIDE_LABELS = {"istanbul avrupa": "europe", "istanbul anadolu": "asia", "avrupa yakasi": "europe", "anadolu yakasi": "asia"}

PLACES = {d: (d, "asia" if d in ASIAN else "europe") for d in DISTRICTS} | {
    name: (district, side)
    for side, table in (("europe", EUROPEAN_PLACES), ("asia", ASIAN_PLACES))
    for district, names in table.items()
    for name in names.split(", ")
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _side(name: Column) -> Column:
    return F.try_element_at(_map({n: s for n, (_, s) in PLACES.items()}), name)


def _district(name: Column) -> Column:
    return F.nullif(F.try_element_at(_map({n: d for n, (d, _) in PLACES.items()}), name), F.lit(""))


def address_names(address: Column) -> Column:
    """The last word and the last two words before each /city and at the end of an address, folded."""
    parts = F.split(F.trim(fold(F.coalesce(address, F.lit("")))), r"[/,]\s*istanbul(?![a-z0-9_])")
    tails = F.transform(parts, lambda s: F.regexp_extract(s, r"((?:[a-z0-9_]+ )?[a-z0-9_]+)\s*$", 1))
    return F.filter(F.array_distinct(F.concat(tails, F.transform(tails, lambda s: F.substring_index(s, " ", -1)))), lambda s: s != "")


def address_place(address: Column, names: list[str]) -> Column:
    """The one of some names that an address ends in; null for none or several."""
    found = F.array_intersect(address_names(address), F.array(*map(F.lit, names)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def resolve_location(label: Column, address: Column) -> Column:
    """Struct of district, side and precision from a label and an address.

    Label and address must agree: two sides or two districts make the place unknown."""
    name = F.trim(fold(F.coalesce(label, F.lit(""))))
    parts = F.transform(F.split(name, "/"), lambda s: F.trim(s))
    part_sides = F.transform(parts, _side)
    shared = F.when((F.size(parts) > 1) & F.forall(part_sides, lambda s: s.isNotNull()) & (F.size(F.array_distinct(part_sides)) == 1), F.get(part_sides, 0))
    label_side = F.coalesce(F.try_element_at(_map(SIDE_LABELS), name), shared)
    in_label = F.when(label_side.isNull(), name)
    district = address_place(address, DISTRICTS)
    other = F.when(district.isNull(), address_place(address, [n for n in PLACES if n not in DISTRICTS]))
    sides = F.array_distinct(F.array_compact(F.array(label_side, _side(in_label), _side(district), _side(other))))
    districts = F.array_distinct(F.array_compact(F.array(_district(in_label), district, _district(other))))
    one = (F.size(sides) == 1) & (F.size(districts) <= 1)
    return F.struct(
        F.when(one, F.get(districts, 0)).alias("district"), F.when(one, F.get(sides, 0)).alias("side"),
        F.when(~one, "unknown").when(F.size(districts) == 1, "district").otherwise("side").alias("precision"),
    )


def conflict(a: Column, b: Column) -> Column:
    """Whether two sets of places are both known and have none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
