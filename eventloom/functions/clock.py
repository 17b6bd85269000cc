"""Local days and clocks, date dimension and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Europe/Istanbul"


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """YYYY-MM-DD of an instant on the local calendar."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def local_clock(ts: Column, zone: str = ZONE) -> Column:
    """HH:mm of an instant on the local clock."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm")


#: Turkish names of months and weekdays (Monday first).  Fixed values.
MONTHS = "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split()
WEEKDAYS = "Pzt Sal Çar Per Cum Cmt Paz".split()


def day_label(ts: Column, zone: str = ZONE) -> Column:
    """An instant's local day in Turkish: 7 Mart 2026."""
    at = F.from_utc_timestamp(ts, zone)
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(at) - 1)
    return F.when(ts.isNotNull(), F.concat_ws(" ", F.dayofmonth(at).cast("string"), month, F.year(at).cast("string")))


def session_label(ts: Column, zone: str = ZONE) -> Column:
    """An instant on the local calendar and clock in Turkish: 7 Mart Cmt 20:30."""
    at = F.from_utc_timestamp(ts, zone)
    month, weekday = F.get(F.array(*map(F.lit, MONTHS)), F.month(at) - 1), F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(at))
    return F.when(ts.isNotNull(), F.concat_ws(" ", F.dayofmonth(at).cast("string"), month, weekday, F.date_format(at, "HH:mm")))


def valid_day(text: Column) -> Column:
    """Whether a text is an existing day written YYYY-MM-DD."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(day, "yyyy-MM-dd") == text), F.lit(False))


def month_thirds(year: Column, month: Column, part: Column) -> tuple[Column, Column]:
    """First and last day of early, mid or late in a month (days 1-10, 11-20, 21-end), or all of it."""
    first = F.make_date(year, month, F.lit(1))
    last = F.last_day(first)
    start = F.when(part == "mid", F.date_add(first, 10)).when(part == "late", F.date_add(first, 20)).otherwise(first)
    end = F.when(part == "early", F.date_add(first, 9)).when(part == "mid", F.date_add(first, 19)).otherwise(last)
    return start, end


def calendar(spark: SparkSession, first: str, days: int) -> DataFrame:
    """Date dimension from a day on: weekday (1 Monday to 7), place of the weekday in its month, whether it
    is the month's last such weekday, week start, weekend flag, days from the first."""
    base = spark.range(days).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").cast("int").alias("offset"))
    weekday = F.weekday("day") + 1
    return base.select(
        "day", "offset", weekday.cast("int").alias("weekday"),
        F.ceil(F.dayofmonth("day") / 7).cast("int").alias("nth"),
        (F.month(F.date_add("day", 7)) != F.month("day")).alias("is_last"),
        F.date_sub("day", (weekday - 1).cast("int")).alias("week_start"),
        (weekday >= 6).alias("weekend"),
    )
