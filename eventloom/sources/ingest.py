"""Provider records to sessions, import filters, crawl coverage and publication gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, identity_hash


def group_performances(df: DataFrame, instant: str, venue: str, price: Column, on_sale: Column) -> DataFrame:
    """Sessions of (instant, venue): least price on sale in units, number of rows, and sold out if no row is
    on sale.  price is in hundredths."""
    return df.groupBy(instant, venue).agg(
        (F.min(F.when(on_sale, price)) / 100).alias("price"), F.count("*").alias("rows"), (~F.bool_or(on_sale)).alias("sold_out")
    )


def expand_sessions(items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events, unresolved) of items with nested session lists.

    items: id, name, url, city, venue, open_ticket, sessions array<array<string>>.  A session must state its
    offset and lie ahead; what can't be used goes to unresolved with a reason."""
    flat = items.withColumns({"title": clean_html("name"), "place": clean_html("venue"), "all": F.array_distinct(F.flatten(F.coalesce("sessions", F.array().cast("array<array<string>>"))))})
    whole = F.when(F.coalesce("open_ticket", F.lit(False)), "open_ticket_without_session").when(
        (F.col("title") == "") | F.col("url").isNull() | ~F.coalesce(F.translate(F.lower("city"), "İı", "ii").rlike("^i̇?stanbul"), F.lit(False)) | (F.size("all") == 0), "sessions_missing_or_non_istanbul"
    )
    flat = flat.withColumn("reason", whole)
    each = flat.where("reason IS NULL").withColumn("session", F.explode("all"))
    start = F.when(F.col("session").rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp("session"))
    each = each.withColumn("start", start).withColumn(
        "reason",
        F.when(~F.col("session").rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), "ambiguous_session_timezone").when(F.col("start").isNull() | (F.col("start") < now) | (F.col("place") == ""), "invalid_session"),
    )
    events = each.where("reason IS NULL").select(identity_hash("session", F.col("url"), F.col("start"), F.col("place")).alias("event_id"), "id", "title", F.col("place").alias("venue"), "url", "start")
    bad = flat.where("reason IS NOT NULL").select("id", F.lit(None).cast("string").alias("session"), "reason").unionByName(each.where("reason IS NOT NULL").select("id", "session", "reason"))
    return events, bad


def import_filter(pages: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Events of page batches with what becomes of each: kept, expired (started) or stale (checked too long
    ago).  pages: page, start, checked, one row for each event."""
    what = F.when(F.col("start") < now, "expired").when(F.col("checked") < now - F.expr(f"INTERVAL {hours} HOURS"), "stale").otherwise("kept")
    return pages.withColumn("what", what)


def publication_gate(old: DataFrame, new: DataFrame, available: Column) -> DataFrame:
    """One row with the reason not to publish, or null: no available event, or under 60 % of twenty or more."""
    counts = old.agg(F.count_if(available).alias("old")).crossJoin(new.agg(F.count_if(available).alias("new")))  # two single rows
    reason = F.when(F.col("new") == 0, "no_verified_available_events").when((F.col("old") >= 20) & (F.col("new") < 0.6 * F.col("old")), "large_catalog_drop")
    return counts.select("old", "new", reason.alias("reason"))


def coverage_state(attempts: DataFrame, key: str, at: str, outcome: str, tie: str) -> DataFrame:
    """State of each url from its attempts (success, retired, quarantined or a failure code).

    Retirement and quarantine last until the next success, retirement or quarantine; the failure is that of
    the last attempt, none after success or retirement."""
    when = F.struct(at, tie)
    final = F.col(outcome).isin("success", "retired", "quarantined")
    return attempts.groupBy(key).agg(
        F.count("*").alias("attempts"), F.max(at).alias("last_attempt"), F.max(F.when(F.col(outcome) == "success", F.col(at))).alias("last_success"),
        F.max(F.when(F.col(outcome) != "success", F.col(at))).alias("last_failure"), F.nullif(F.max_by(F.when(F.col(outcome).isin("success", "retired"), "").otherwise(F.col(outcome)), when), F.lit("")).alias("failure"),
        F.max_by(outcome, F.when(final, when)).alias("state"), F.max(F.when(final, F.col(at))).alias("since"),
    )


def due(state: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Urls to visit: all but those retired within so many days."""
    return state.where((F.coalesce("state", F.lit("")) != "retired") | (F.col("since") <= now - F.expr(f"INTERVAL {days} DAYS")))


def raw_store(files: DataFrame, max_bytes: int) -> DataFrame:
    """Content-addressed bodies from (path, content): one row for each body of an admitted size."""
    sized = files.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content")}).where(F.col("size") <= max_bytes)
    return sized.groupBy("sha256").agg(F.first("content").alias("content"), F.first("size").alias("size"), F.min("path").alias("first_path"), F.count("*").alias("receipts"))
