"""Eligibility and preference filters as boolean columns; all push down to the scan where they can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_HOURS, FUTURE_MINUTES = 72, 5


def fresh(checked: Column, now: Column) -> Column:
    """Checked within the last 72 hours, or as much as five minutes ahead; both ends count."""
    return (checked >= now - F.expr(f"INTERVAL {STALE_HOURS} HOURS")) & (checked <= now + F.expr(f"INTERVAL {FUTURE_MINUTES} MINUTES"))


def eligible(starts: Column, checked: Column, now: Column, available: Column) -> Column:
    return (starts >= now) & fresh(checked, now) & available


def within_price(price: Column, ceiling: float, exclusive: bool = False, known_currency: Column | None = None) -> Column:
    """A known price below the ceiling, or at it unless exclusive; unknown prices fail."""
    test = (price < ceiling) if exclusive else (price <= ceiling)
    return F.coalesce(test if known_currency is None else known_currency & test, F.lit(False))


def within_budget(price: Column, party: Column, total: float) -> Column:
    return F.coalesce(price * party <= total, F.lit(False))


def overlaps(first: Column, last: Column, a, b) -> Column:
    return (last >= a) & (first <= b)


def clock_between(clock: Column, after: str | None = None, before: str | None = None, exclusive: bool = False) -> Column:
    test = F.lit(True)
    if after is not None:
        test = test & ((clock > after) if exclusive else (clock >= after))
    if before is not None:
        test = test & ((clock < before) if exclusive else (clock <= before))
    return test


def exclude_productions(df: DataFrame, hits: DataFrame, production: str) -> DataFrame:
    """Rows of no production that a hit belongs to: productions of the hits, then an anti-join."""
    return df.join(hits.select(production).distinct(), production, "left_anti")


def without_term(text: Column, term: str, negations: str = "degil|yok|haric|not|without") -> Column:
    """No whole-word hit of a term in folded text, but for hits that a negation follows."""
    return ~text.rlike(rf"(?:^|[^a-z0-9]){term}(?![a-z0-9])(?!\s+(?:{negations}))")


def reasons(**tests: Column) -> Column:
    """Codes of the tests that hold, in order, as an array."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in tests.items())))
