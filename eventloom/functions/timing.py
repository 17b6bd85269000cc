"""What descriptions say about doors and start times, on folded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import local_clock
from .text import fold

EVENT_TIME = r"(?:etkinlik\s+saati|etkinlik\s+baslangic(?:\s+saati)?)"
DOOR_TIME = r"kapi\s+acilis(?:\s+saati)?"
DOORS_ONLY = r"belirtilen\s+saat\s*,?\s*kapi\s+acilis\s+saatidir"


def labelled_clock(description: Column, label: str) -> Column:
    """HH:mm after a label, or null."""
    pattern = rf"{label}(?:\s*:\s*|\s+)([01]?[0-9]|2[0-3])[.:]([0-5][0-9])(?:$|[^0-9])"
    hour = F.regexp_extract(fold(description), pattern, 1)
    return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract(fold(description), pattern, 2)))


def doors_only(description: Column) -> Column:
    return F.coalesce(fold(description).rlike(DOORS_ONLY), F.lit(False))


def door_time_conflict(description: Column, start: Column) -> Column:
    """Whether the start is the stated door time although another event time is stated."""
    event, door = labelled_clock(description, EVENT_TIME), labelled_clock(description, DOOR_TIME)
    return F.coalesce((event != door) & (local_clock(start) == door), F.lit(False))
