"""schema.org events in raw pages: JSON-LD blocks to typed rows, and listings with validation codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html
from ..scratch import cut

BLOCK = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _get(path: str, kind: str, of: str = "v") -> Column:
    return F.expr(f"""try_variant_get({of}, '{path}', '{kind}')""")


#: Levels that are taken out of a value in one pass over it; what lies deeper is another round.
LEVELS = 16


def _levels() -> Column:
    """LEVELS + 1 arrays from a variant column v: itself, then level by level the members of arrays and what @graph
    and subEvent of objects hold."""
    held = lambda path: f"coalesce(try_variant_get(x, '{path}', 'array<variant>'), array_compact(array(try_variant_get(x, '{path}', 'variant'))))"
    inner = f"""coalesce(try_variant_get(x, '$', 'array<variant>'), concat({held('$["@graph"]')}, {held('$.subEvent')}))"""
    return F.expr(f"aggregate(sequence(1, {LEVELS}), array(array(v)), (s, i) -> concat(s, array(flatten(transform(element_at(s, -1), x -> {inner})))))")


def jsonld_objects(pages: DataFrame, keep: list[str], html: str = "html", checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(keep..., v): every object in JSON-LD blocks, at any depth of arrays, @graph and subEvent.

    Blocks are parsed once and written (checkpoint).  Their levels are taken out in memory: a level holds all that
    is below it, so writing each would take the square of the depth.  Only what lies deeper than LEVELS is
    written again, for another round.  Blocks that aren't JSON are left out."""
    # filters stand after what is written, and explode is the outer one, which infers none: a filter that is pushed
    # down works out once more what it asks about
    blocks = pages.select(*keep, F.explode_outer(F.regexp_extract_all(html, F.lit(BLOCK), 1)).alias("b"))
    top, out = checkpoint(blocks.select(*keep, F.try_parse_json("b").alias("v"))).where("v IS NOT NULL"), None
    while out is None or not top.isEmpty():
        levels = top.select(*keep, _levels().alias("levels"))
        found = levels.select(*keep, F.explode_outer(F.flatten(F.slice("levels", 1, LEVELS))).alias("v"))
        out = found if out is None else out.unionByName(found)
        top = checkpoint(levels.select(*keep, F.explode_outer(F.element_at("levels", -1)).alias("v")).where("v IS NOT NULL"))
    return out.where("try_variant_get(v, '$', 'struct<`@type`: variant>') IS NOT NULL")


def events(objects: DataFrame, keep: list[str]) -> DataFrame:
    """Event rows: name, description, start as written, venue, address, place, least offered price, availability.

    Prices of offers that aren't in stock don't count; without an offer list the offer's lowPrice or price
    is taken."""
    offers = F.expr("coalesce(try_variant_get(v, '$.offers', 'array<variant>'), array(variant_get(v, '$.offers')))")
    o = objects.where(F.coalesce(_get('$["@type"]', "string"), F.lit("")).endswith("Event")).select(*keep, "v", F.filter(offers, lambda x: x.isNotNull()).alias("o"))
    stock = "coalesce(try_variant_get(x, '$.availability', 'string'), 'InStock')"
    price = "coalesce(try_variant_get(x, '$.lowPrice', 'double'), try_variant_get(x, '$.price', 'double'))"
    return o.select(
        *keep, clean_html(_get("$.name", "string")).alias("title"), clean_html(_get("$.description", "string")).alias("description"), _get("$.startDate", "string").alias("start_text"),
        clean_html(_get("$.location.name", "string")).alias("venue"), _get("$.location.address.streetAddress", "string").alias("address"),
        _get("$.location.address.addressLocality", "string").alias("city"), _get("$.location.geo.latitude", "double").alias("lat"), _get("$.location.geo.longitude", "double").alias("lon"),
        F.expr(f"array_min(transform(filter(o, x -> {stock} LIKE '%InStock'), x -> {price}))").alias("price"),
        F.expr("try_variant_get(get(o, 0), '$.priceCurrency', 'string')").alias("currency"),
        F.when(F.size("o") == 0, "unknown").when(F.expr(f"exists(o, x -> {stock} LIKE '%InStock')"), "available").otherwise("sold_out").alias("availability"),
    )


def validate_listing(df: DataFrame, now: Column) -> DataFrame:
    """Rows with start as an instant and codes of what is wrong; an empty array is a valid listing.  A start
    must state its offset, and a place at 0, 0 or outside the province is no place."""
    stated = F.col("start_text").rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    df = df.withColumn("start", F.when(stated, F.try_to_timestamp("start_text")))
    inside = F.col("lat").between(40.5, 41.8) & F.col("lon").between(27.5, 30.2)
    df = df.withColumns({"lat": F.when(inside, F.col("lat")), "lon": F.when(inside, F.col("lon"))})
    tests = {
        "title": F.length("title") == 0, "start_offset": ~F.coalesce(stated, F.lit(False)), "start": stated & F.col("start").isNull(),
        "past": F.col("start") < now, "venue": F.coalesce(F.length("venue"), F.lit(0)) == 0, "price": F.col("price") < 0,
    }
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items()))))
