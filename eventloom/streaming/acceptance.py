"""Keyed stream state: acceptance of observations in order of arrival, and reserved slots of a pacer.

Rows of a key wait in its state until the watermark has passed their arrival, and are then taken in order,
so files may come shuffled, late within the watermark, or again.  State is kept by RocksDB; what waits for a
key is bounded by what arrives within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Why an observation is held against the head of its offer.  Fixed values.
REASONS = (
    "source_updated_at_missing_against_versioned_current", "source_updated_at_older_than_current", "same_source_version_has_different_content",
    "observed_at_older_at_same_source_version", "observed_at_older_without_source_version", "same_observation_time_has_different_content",
)
AMBIGUOUS, REUSED = "ambiguous_source_identity", "revision_id_reused"
ACCEPTED, STALE, CONFLICT = "accepted", "held_stale", "held_conflict"


@contextmanager
def keyed_state(spark: SparkSession):
    """RocksDB as the state store while a query runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class InOrder(StatefulProcessor):
    """Rows with an event time ``at`` (milliseconds) and a place ``turn`` among equals, taken in this order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        new = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if not ready:
            return
        if later:
            self.waiting.put([tuple(r) for r in later])
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()
        yield from self.take(key, ready)


class Acceptance(InOrder):
    """Offers of a scope: an observation belongs to the one offer that its source ids are known for."""

    names = ("at", "turn", "record", "revision", "ids", "clock", "observed", "content")
    columns = "at bigint, turn bigint, record bigint, revision string, ids string, clock bigint, observed bigint, content string"
    output = "scope {}, record bigint, offer string, status string, reason string, head string, replay boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.offers = handle.getMapState("offers", "id string", "offer string")
        self.heads = handle.getMapState("heads", "offer string", "revision string, clock bigint, observed bigint, content string")
        self.seen = handle.getMapState("seen", "revision string", "print string, offer string, status string, reason string")

    @staticmethod
    def verdict(head, clock, observed, content) -> tuple[str, str | None]:
        _, old, old_observed, old_content = head
        if old is not None and clock is None:
            return CONFLICT, REASONS[0]
        if old is not None and clock < old:
            return STALE, REASONS[1]
        if old is not None and clock == old:
            if content != old_content:
                return CONFLICT, REASONS[2]
            if observed < old_observed:
                return STALE, REASONS[3]
        if old is None and clock is None:
            if observed < old_observed:
                return STALE, REASONS[4]
            if observed == old_observed and content != old_content:
                return CONFLICT, REASONS[5]
        return ACCEPTED, None

    @staticmethod
    def row(key, record, offer, status, reason, head, replay) -> Row:
        return Row(scope=key[0], record=record, offer=offer, status=status, reason=reason, head=head, replay=replay)

    def take(self, key, rows) -> Iterator[Row]:
        # state is asked for once for all rows, since every call goes to the JVM and back
        offers = {i: o for (i,), (o,) in self.offers.iterator()}
        heads = {o: tuple(h) for (o,), h in self.heads.iterator()}
        kept_offers, kept_heads = dict(offers), dict(heads)
        known_before = self.seen.exists()
        seen: dict[str, tuple] = {}
        for _, _, record, revision, ids, clock, observed, content in rows:
            print_ = "\x1f".join(str(x) for x in (ids, clock, observed, content))
            if revision not in seen and known_before and self.seen.containsKey((revision,)):
                seen[revision] = tuple(self.seen.getValue((revision,)))
            if revision in seen:
                known, offer, status, reason = seen[revision]
                if known != print_:
                    status, reason = CONFLICT, REUSED
                yield self.row(key, record, offer, status, reason, heads[offer][0] if offer in heads else None, known == print_)
                continue
            own = ids.split(",")
            found = {offers[i] for i in own if i in offers}
            if len(found) > 1:
                offer, status, reason, head = None, CONFLICT, AMBIGUOUS, None
            else:
                offer = found.pop() if found else f"offer:{min(own)}"
                current = heads.get(offer)
                status, reason = self.verdict(current, clock, observed, content) if current else (ACCEPTED, None)
                if status == ACCEPTED:
                    heads[offer] = (revision, clock, observed, content)
                    offers.update(dict.fromkeys(own, offer))
                head = revision if status == ACCEPTED else current[0]
            seen[revision] = (print_, offer, status, reason)
            self.seen.updateValue((revision,), seen[revision])
            yield self.row(key, record, offer, status, reason, head, False)
        for state, now, before in ((self.offers, {i: (o,) for i, o in offers.items()}, {i: (o,) for i, o in kept_offers.items()}), (self.heads, heads, kept_heads)):
            for name, value in now.items():
                if before.get(name) != value:
                    state.updateValue((name,), value)


class Pacer(InOrder):
    """Calls of a key that reserve slots: as many starts in a window, a longest wait, a pause after failures.

    A call gets the first start that leaves no more than ``calls`` starts within ``window`` before it; if that
    is more than ``longest`` away, or the key is paused, it is refused.  A call that fails at its start
    pauses the key from then for ``pause``.  Times are milliseconds."""

    names = ("at", "turn", "record", "failed")
    columns = "at bigint, turn bigint, record bigint, failed boolean"
    output = "scope {}, record bigint, start bigint, outcome string"

    def __init__(self, calls: int, window: int, longest: int, pause: int):
        self.calls, self.window, self.longest, self.pause = calls, window, longest, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("pace", "starts array<bigint>, paused bigint")

    def take(self, key, rows) -> Iterator[Row]:
        starts, paused = self.state.get() if self.state.exists() else ([], 0)
        starts = list(starts)
        for at, _, record, failed in rows:
            if at < paused:
                yield Row(scope=key[0], record=record, start=None, outcome="paused")
                continue
            starts = [s for s in starts if s > at - self.window]
            start = at if len(starts) < self.calls else max(at, starts[-self.calls] + self.window)
            if start - at > self.longest:
                yield Row(scope=key[0], record=record, start=None, outcome="busy")
                continue
            starts = sorted([*starts, start])
            if failed:
                paused = max(paused, start + self.pause)
            yield Row(scope=key[0], record=record, start=start, outcome="failed" if failed else "started")
        self.state.update((starts, paused))


class Recheck(StatefulProcessor):
    """Pages of a key that were retired come up again after ``wait`` milliseconds, unless seen in between.

    Rows have ``at``, ``turn``, ``record`` and ``retired``; one row is given for each page that comes due, at the
    moment that it is due."""

    output = "scope {}, due bigint"

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, turn bigint, retired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        newest = max((r["at"], r["turn"], r["retired"]) for r in rows)
        if not self.last.exists() or tuple(self.last.get()) < newest:
            if self.last.exists() and self.last.get()[2]:
                self.handle.deleteTimer(self.last.get()[0] + self.wait)
            self.last.update(newest)
            if newest[2]:
                self.handle.registerTimer(newest[0] + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield Row(scope=key[0], due=expiredTimerInfo.getExpiryTimeInMs())


def keyed(rows: DataFrame, scope: str, processor: StatefulProcessor, delay: str) -> DataFrame:
    """A stream of rows with an event time ``at`` (milliseconds) through a processor, keyed by scope."""
    timed = rows.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", delay)
    kind = rows.schema[scope].dataType.simpleString()
    return timed.groupBy(scope).transformWithState(processor, processor.output.format(kind), "append", "EventTime")
