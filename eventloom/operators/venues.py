"""Venue identity: candidate edges of six kinds of evidence, and the anchors that name the clusters.

Listings are rows of id, provider, city, name, venue_id (the provider's), seed (a reviewed alias), lat, lon and
districts (what label, address and name say, sorted).  Every kind of evidence is a block with equi-join
keys.  Within a block the listings of one place are linked to their least id, and the least ids of the places,
of which there are no more than districts and pairs of them, to each other: linear in the block, and
listings of places that agree can join whatever the conflicts of others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, venues
from ..functions.location import conflict
from ..functions.numeric import distance_metres
from ..scratch import drop
from .joins import dealt

GEO_METRES = 75
#: Degrees that are more than GEO_METRES anywhere in the city's latitudes, and degrees of a cell.
REACH, CELL = 0.001, 0.002
EVIDENCE = ("provider-venue-id", "manual-venue-seed", "compact-name", "geo-name-overlap", "distinctive-name", "distinctive-name-extension")


def _heads(rows: DataFrame) -> DataFrame:
    """(key, districts, head): the least id of each block and place."""
    return rows.groupBy("key", "districts").agg(F.min("id").alias("head"))


def _inside(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return dealt(rows, heads, ["key", "districts"]).where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"), "key")


def _between(heads: DataFrame, agree: bool) -> DataFrame:
    other = heads.select("key", F.col("head").alias("b"), F.col("districts").alias("d2"))
    pairs = dealt(heads, other, "key").where(F.col("head") < F.col("b"))
    if agree:
        pairs = pairs.where(~conflict(F.col("districts"), F.col("d2")))
    return pairs.select(F.col("head").alias("a"), "b", "key")


def _block(listings: DataFrame, key: Column, agree: bool = False) -> DataFrame:
    rows = listings.select("id", "districts", key.alias("key")).where("key IS NOT NULL")
    heads = _heads(rows)
    return _inside(rows, heads).unionByName(_between(heads, agree))


def _near(listings: DataFrame) -> DataFrame:
    """Listings within GEO_METRES whose names share a word.  Listings of one point and name are linked to their
    least id, and only those are compared, by cell and word: each is sent to its own cell and to those within reach that
    come after it, so two cells meet once."""
    points = listings.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "city", "lat", "lon", "words")
    points = points.where("size(words) > 0").withColumn("key", F.concat_ws("\x1f", "city", "lat", "lon", F.array_join(F.array_sort("words"), " ")))
    heads = points.groupBy("key").agg(F.min(F.struct("id", "city", "lat", "lon", "words")).alias("h"))
    same = dealt(points, heads.select("key", F.col("h.id").alias("head")), "key").where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"), "words")
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / CELL)
    cells = heads.select("h.id", "h.city", "h.lat", "h.lon", F.explode("h.words").alias("word")).withColumns({"cx": cell("lat"), "cy": cell("lon")})
    sent = cells.withColumn("cx2", F.explode(F.sequence("cx", cell("lat", REACH)))).withColumn("cy2", F.explode(F.sequence(cell("lon", -REACH), cell("lon", REACH)))).where("cx2 > cx OR cy2 >= cy")
    sent = sent.select("city", "word", F.col("cx2").alias("cx"), F.col("cy2").alias("cy"), ((F.col("cx2") == F.col("cx")) & (F.col("cy2") == F.col("cy"))).alias("own"), F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = dealt(cells, sent, ["city", "word", "cx", "cy"]).where("NOT own OR id < b").where(distance_metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= GEO_METRES)
    pairs = near.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "word").groupBy("a", "b").agg(F.collect_set("word").alias("words"))
    return same.unionByName(pairs).select("a", "b", F.array_join(F.array_sort("words"), ",").alias("key"))


def _extended(listings: DataFrame) -> DataFrame:
    """Names that exactly one other name of the city extends by a single word; a name with two telling words is
    only extended by one that tells nothing."""
    rows = listings.select("id", "districts", "city", F.col("tokens").alias("t"))
    rows = rows.where(F.exists("t", lambda t: ~t.isin(venues.WEAK)) & (F.length(F.array_join("t", "")) >= 3))
    rows = rows.withColumn("key", F.concat_ws("\x1f", "city", F.array_join("t", " ")))
    heads = _heads(rows)
    names = rows.select("key", "city", "t").distinct()
    own = names.withColumn("telling", F.size(F.filter("t", venues.identifying))).where("telling > 0").select("city", F.array_join("t", " ").alias("n"), "key", "telling")
    longer = names.where("size(t) > 1").select("city", F.col("key").alias("key2"), F.explode("t").alias("x"), "t")
    longer = longer.select("city", "key2", "x", F.array_join(F.array_remove("t", F.col("x")), " ").alias("n"))
    pairs = dealt(own, longer, ["city", "n"]).where((F.col("telling") < 2) | ~venues.identifying(F.col("x")))
    only = pairs.groupBy("key").agg(F.count("*").alias("k"), F.min("key2").alias("key2")).where("k = 1")
    far = heads.select(F.col("key").alias("key2"), F.col("head").alias("b"))
    return dealt(dealt(only, heads, "key"), far, "key2").select(F.col("head").alias("a"), "b", F.concat("key", F.lit(">"), "key2").alias("key"))


def _kinds(listings: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], told: bool) -> list[DataFrame]:
    """(a, b, priority, evidence if told) of each kind, with a < b.

    All kinds read what names say from one table, which checkpoint(df) may write so that it is worked out once; it writes
    the edges of each kind too, so that what one kind deals out is gone before the next begins."""
    city = F.coalesce("city", F.lit(""))
    said = {
        "compact": F.nullif(text.compact_key(F.col("name")), F.lit("")), "words": F.array_distinct(venues.name_tokens(F.col("name"))),
        "tokens": F.array_sort(F.array_distinct(venues.distinctive_tokens(F.col("name")))),
    }
    own = listings.withColumns({"city": city, "districts": F.coalesce("districts", F.array().cast("array<string>")), **said})
    own = checkpoint(own.select("id", "provider", "city", "venue_id", "seed", "lat", "lon", "districts", *said))
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    block = lambda c: F.when(c.isNotNull(), F.concat_ws("\x1f", "city", c))
    compact, tokens = F.col("compact"), F.col("tokens")
    name = F.when(F.exists(tokens, lambda t: ~t.isin(venues.WEAK)) & (F.length(F.array_join(tokens, "")) >= 3), F.array_join(tokens, " "))
    given = own.select("id", F.when(filled(F.col("venue_id")).isNotNull(), F.concat_ws("\x1f", "city", "provider", filled(F.col("venue_id")))).alias("key")).where("key IS NOT NULL")
    first = given.groupBy("key").agg(F.min("id").alias("a"))
    kinds = (
        dealt(given, first, "key").where("id != a").select("a", F.col("id").alias("b"), "key"), _block(own, block(filled(F.col("seed"))), agree=True), _block(own, block(compact)),
        _near(own), _block(own, block(name)), _extended(own),
    )
    what = lambda p: [F.concat(F.lit(f"{EVIDENCE[p]}:"), F.replace("key", F.lit("\x1f"), F.lit("/"))).alias("evidence")] if told else []
    out = [checkpoint(k.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(p).alias("priority"), *what(p))) for p, k in enumerate(kinds)]
    drop(own)
    return out


def venue_edges(listings: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(a, b, priority, evidence) with a < b: the best evidence of each pair, priority 0 to 5 by EVIDENCE.

    Nulls and empty names give no edge of the kinds that need them."""
    every = reduce(DataFrame.unionByName, _kinds(listings, checkpoint, told=True))
    return every.groupBy("a", "b").agg(F.min(F.struct("priority", "evidence")).alias("e")).select("a", "b", "e.priority", "e.evidence")


def venue_links(listings: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(a, b, priority) with a < b, once for each kind of evidence that a pair has: what clusters are made from."""
    return reduce(DataFrame.unionByName, _kinds(listings, checkpoint, told=False))


def venue_keys(listings: DataFrame) -> DataFrame:
    """(id, key, value) that a venue has one of: a provider's venue id, the district, the side of the city."""
    one = F.when(F.size("districts") == 1, F.get("districts", 0))
    given = F.filter(
        F.array(
            F.struct(F.concat(F.lit("provider:"), "provider").alias("key"), F.nullif(F.trim("venue_id"), F.lit("")).alias("value")),
            F.struct(F.lit("district").alias("key"), one.alias("value")), F.struct(F.lit("side").alias("key"), venues.side(one).alias("value")),
        ), lambda s: s.value.isNotNull(),
    )
    return listings.select("id", F.explode(given).alias("k")).select("id", "k.key", "k.value")


def venue_anchors(listings: DataFrame, clusters: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(cluster, listings, name, anchor, venue) of every cluster (id, cluster); checkpoint(df) may write what both the anchors
    and their number of uses are read from.

    The anchor is the least seed; else the one compact name with a district; else the least provider id; else the
    first point; else the least listing.  The venue's id is a hash of the anchor, and of what tells clusters
    of one anchor apart.  The name is the least by folded text, then as written, in binary order."""
    scope = F.transform("districts", lambda d: F.concat(venues.side(d), F.lit(":"), d))
    own = dealt(listings, clusters, "id").withColumns({"compact": F.nullif(text.compact_key(F.col("name")), F.lit("")), "scope": F.array_min(scope)})
    own = own.withColumn("given", F.when(F.nullif(F.trim("venue_id"), F.lit("")).isNotNull(), F.concat_ws(":", "provider", F.trim("venue_id"))))
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws(":", F.lit("geo"), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon")))
    drafts = own.groupBy("cluster").agg(
        F.count("*").alias("listings"), F.min(F.struct(text.identity_text(F.col("name")).alias("plain"), "name")).alias("name"), F.min(F.nullif("seed", F.lit(""))).alias("seed"),
        F.min("compact").alias("compact"), (F.min("compact") == F.max("compact")).alias("one_name"), F.min("scope").alias("scope"), F.min("given").alias("given"),
        F.min(F.when(point.isNotNull(), F.struct("id", point.alias("point"))))["point"].alias("point"), F.min("id").alias("least"),
    )
    anchor = F.coalesce(
        "seed", F.when(F.col("one_name") & F.col("scope").isNotNull(), F.concat_ws(":", F.lit("compact"), "compact", "scope")), "given",
        F.when(F.col("point").isNotNull(), F.concat_ws(":", "point", "compact")), F.concat(F.lit("isolated:"), F.col("least").cast("string")),
    )
    apart = F.coalesce("point", "given", "scope", F.concat(F.lit("listing:"), F.col("least").cast("string")))
    drafts = checkpoint(drafts.select("cluster", "listings", F.col("name.name").alias("name"), anchor.alias("anchor"), apart.alias("apart")))
    shared = drafts.groupBy("anchor").agg(F.count("*").alias("uses"))
    named = dealt(drafts, shared, "anchor")
    venue = F.when(F.col("uses") == 1, text.identity_hash("venue", F.col("anchor"))).otherwise(text.identity_hash("venue", F.col("anchor"), F.col("apart")))
    return named.select("cluster", "listings", "name", "anchor", venue.alias("venue"))
