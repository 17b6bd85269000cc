"""Streaming queries: the stream is run to its end and its table returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..scratch import cut, scratch_root
from ..sources import refresh
from ..streaming import acceptance, streams
from .base import load
from .state import ORACLE as STATE

HEADS = STATE["page_head_machine"]


def _run(spark, sf_dir, build, mode):
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    # a pattern, since the table may be a file or a folder of files
    events = streams.read_events(spark, f"{sf_dir}/events.parque[t]", load(spark, sf_dir, "events").schema)
    streams.run(build(events), streams.land(f"{root}/out") if mode == "append" else lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out"), f"{root}/state", mode)
    return spark.read.parquet(f"{root}/out")


def stream_rate_window(spark, sf_dir):
    out = _run(spark, sf_dir, lambda e: streams.rate_windows(e, "user_id", "6 hours", "72 hours"), "complete")
    return out.select("user_id", F.col("start").cast("string").alias("start"), "n")


def stream_page_heads(spark, sf_dir):
    def build(e):
        arrival = (F.floor(F.col("event_id") / 50) * 50) + (F.col("event_id") * 37 % 50)
        return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), arrival.alias("arrival"), F.date_diff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("clock"), F.col("event_type").alias("content"))

    log = _run(spark, sf_dir, build, "append")
    heads = streams.page_heads(log, int(spark.conf.get("spark.sql.shuffle.partitions")), cut)
    return heads.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "verdict")


#: A time after all others: the row that carries it lets the watermark pass everything before.
_LAST = 200_000_000_000_000


def _keyed(spark, rows, processor, files: int = 4):
    """Rows (scope, at, turn, ...) as shuffled files, run through a processor of keyed state to the end of the stream."""
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows.repartition(files, F.xxhash64("scope", "at", "turn")).write.parquet(f"{root}/in")
    end = rows.limit(1).withColumns({"at": F.lit(_LAST), "scope": F.lit(-1).cast(rows.schema["scope"].dataType)})
    end.coalesce(1).write.mode("append").parquet(f"{root}/in")  # newest, so read last
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    with acceptance.keyed_state(spark):
        streams.run(acceptance.keyed(stream, "scope", processor, "3650 days"), streams.land(f"{root}/out"), f"{root}/state", "append")
    return spark.read.schema(processor.output.format(rows.schema["scope"].dataType.simpleString())).parquet(f"{root}/out").drop("batch")


def stream_acceptance(spark, sf_dir):
    """Events as observations of offers, a user's in order of arrival: source ids, revisions and clocks against the head."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    arrival = (F.floor(k / 50) * 50) + (k * 37 % 50)
    ids = F.when(k % 9 == 0, F.concat_ws(",", F.concat(F.lit("s"), k % 4), F.concat(F.lit("s"), (k + 1) % 4))).otherwise(F.concat(F.lit("s"), k % 4))
    day = F.date_diff("ts", F.lit("2024-01-01").cast("date")).cast("long")
    log = e.select(
        F.col("user_id").alias("scope"), ((arrival + 1) * 1000).cast("long").alias("at"), k.alias("turn"), k.alias("record"), F.concat(F.lit("r"), F.when(k % 10 == 0, k + 1).otherwise(k)).alias("revision"),
        ids.alias("ids"), F.when(k % 4 < 2, F.floor(day / 3)).alias("clock"), F.when(k % 8 == 2, F.lit(0)).otherwise(day).cast("long").alias("observed"), F.col("event_type").alias("content"),
    )
    return _keyed(spark, log, acceptance.Acceptance()).withColumnRenamed("scope", "user_id")


_ACCEPT = """
WITH RECURSIVE o AS (
  SELECT user_id, event_id AS record, 'r' || CASE WHEN event_id % 10 = 0 THEN event_id + 1 ELSE event_id END AS revision, CASE WHEN event_id % 9 = 0 THEN ['s' || (event_id % 4), 's' || ((event_id + 1) % 4)] ELSE ['s' || (event_id % 4)] END AS ids,
    CASE WHEN event_id % 4 < 2 THEN date_diff('day', DATE '2024-01-01', ts::DATE) // 3 END AS clock, CASE WHEN event_id % 8 = 2 THEN 0 ELSE date_diff('day', DATE '2024-01-01', ts::DATE) END AS observed, event_type AS content,
    row_number() OVER (PARTITION BY user_id ORDER BY (event_id // 50) * 50 + (event_id * 37 % 50), event_id) AS n FROM events),
run(user_id, n, known, heads, seen, record, offer, status, reason, head, replay) AS (
  SELECT DISTINCT user_id, 0::BIGINT, MAP {'': ''}, [{'offer': '', 'revision': '', 'clock': NULL::BIGINT, 'observed': 0::BIGINT, 'content': ''}],
    [{'revision': '', 'print': '', 'offer': '', 'status': '', 'reason': ''}], 0::BIGINT, '', '', '', '', false FROM o
  UNION ALL
  SELECT user_id, n, CASE WHEN st = 'accepted' AND old IS NULL THEN map_concat(known, map_from_entries(list_transform(ids, lambda i: {'key': i, 'value': off}))) ELSE known END,
    CASE WHEN st = 'accepted' AND old IS NULL THEN list_append(list_filter(heads, lambda h: h.offer <> off), {'offer': off, 'revision': revision, 'clock': clock, 'observed': observed, 'content': content}) ELSE heads END,
    CASE WHEN old IS NULL THEN list_append(seen, {'revision': revision, 'print': print, 'offer': off, 'status': st, 'reason': why}) ELSE seen END,
    record, off, st, why, CASE WHEN old IS NULL AND st = 'accepted' THEN revision WHEN old IS NULL THEN cur.revision ELSE list_filter(heads, lambda h: h.offer = off)[1].revision END, old IS NOT NULL AND old.print = print
  FROM (SELECT *, CASE WHEN old IS NOT NULL THEN CASE WHEN old.print = print THEN old.status ELSE 'held_conflict' END WHEN many THEN 'held_conflict' WHEN cur IS NULL OR why0 IS NULL THEN 'accepted'
            WHEN why0 IN ('source_updated_at_older_than_current', 'observed_at_older_at_same_source_version', 'observed_at_older_without_source_version') THEN 'held_stale' ELSE 'held_conflict' END AS st,
          CASE WHEN old IS NOT NULL THEN CASE WHEN old.print = print THEN old.reason ELSE 'revision_id_reused' END WHEN many THEN 'ambiguous_source_identity' ELSE why0 END AS why
        FROM (SELECT *, CASE WHEN cur IS NULL THEN NULL WHEN cur.clock IS NOT NULL AND clock IS NULL THEN 'source_updated_at_missing_against_versioned_current'
            WHEN cur.clock IS NOT NULL AND clock < cur.clock THEN 'source_updated_at_older_than_current' WHEN cur.clock IS NOT NULL AND clock = cur.clock AND content <> cur.content THEN 'same_source_version_has_different_content'
            WHEN cur.clock IS NOT NULL AND clock = cur.clock AND observed < cur.observed THEN 'observed_at_older_at_same_source_version'
            WHEN cur.clock IS NULL AND clock IS NULL AND observed < cur.observed THEN 'observed_at_older_without_source_version'
            WHEN cur.clock IS NULL AND clock IS NULL AND observed = cur.observed AND content <> cur.content THEN 'same_observation_time_has_different_content' END AS why0
          FROM (SELECT *, CASE WHEN old IS NULL AND NOT many THEN list_filter(heads, lambda h: h.offer = off)[1] END AS cur
            FROM (SELECT *, CASE WHEN old IS NOT NULL THEN old.offer WHEN many THEN NULL ELSE coalesce(found[1], 'offer:' || list_min(ids)) END AS off
              FROM (SELECT *, len(found) > 1 AS many, list_filter(seen, lambda x: x.revision = revision)[1] AS old
                FROM (SELECT o.*, known, heads, seen, list_distinct(list_filter(list_transform(ids, lambda i: known[i]), lambda x: x IS NOT NULL)) AS found,
                  concat_ws(chr(31), array_to_string(ids, ','), clock, observed, content) AS print FROM run r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)))))))
SELECT user_id, record, offer, status, reason, head, replay FROM run WHERE n > 0
"""


def stream_pacer(spark, sf_dir):
    """Events as calls of a user: three starts in six hours, a wait of three hours at most, errors pause for a day."""
    e = load(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    calls = e.select(F.col("user_id").alias("scope"), at.alias("at"), F.col("event_id").alias("turn"), F.col("event_id").alias("record"), (F.col("event_type") == "error").alias("failed"))
    out = _keyed(spark, calls, acceptance.Pacer(3, 6 * 3_600_000, 3 * 3_600_000, 86_400_000))
    return out.select(F.col("scope").alias("user_id"), F.col("record").alias("event_id"), "start", "outcome")


_PACE = """
WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS moment, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
run(user_id, n, starts, paused, event_id, start, outcome) AS (
  SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM c
  UNION ALL
  SELECT user_id, n, CASE WHEN outcome IN ('started', 'failed') THEN list_sort(list_append(own, s)) WHEN outcome = 'busy' THEN own ELSE starts END,
    CASE WHEN outcome = 'failed' THEN greatest(paused, s + 86400000) ELSE paused END, event_id, CASE WHEN outcome IN ('started', 'failed') THEN s END, outcome
  FROM (SELECT *, CASE WHEN moment < paused THEN 'paused' WHEN s - moment > 10800000 THEN 'busy' WHEN failed THEN 'failed' ELSE 'started' END AS outcome
        FROM (SELECT *, CASE WHEN len(own) < 3 THEN moment ELSE greatest(moment, own[len(own) - 2] + 21600000) END AS s
              FROM (SELECT c.*, r.starts, r.paused, list_filter(r.starts, lambda x: x > moment - 21600000) AS own FROM run r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1))))
SELECT user_id, event_id, start, outcome FROM run WHERE n > 0
"""


def stream_recheck(spark, sf_dir):
    """Users whose last event is an error count as retired, and come up again after seven days."""
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("scope"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("turn"), F.col("event_id").alias("record"), (F.col("event_type") == "error").alias("retired"))
    out = _keyed(spark, rows, acceptance.Recheck(7 * 86_400_000))
    return out.where("scope >= 0").select(F.col("scope").alias("user_id"), "due")


_RECHECK = """
WITH l AS (SELECT user_id, arg_max(event_type, (epoch_us(ts) // 1000, event_id)) AS last, max(epoch_us(ts) // 1000) AS seen FROM events GROUP BY 1)
SELECT user_id, seen + 7 * 86400000 AS due FROM l WHERE last = 'error'
"""

def stream_refresh(spark, sf_dir):
    """Parts as a publication that two batches of a stream change: its rows, and which refresh wrote the partition of each."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    root = f"{scratch_root(spark)}/refresh-{uuid.uuid4().hex[:12]}"
    part = F.floor(F.col("p_partkey") / 100) % 64
    refresh.publish_whole(p.where("p_partkey % 31 != 30"), root, "whole", part)
    k = F.col("p_partkey")
    batches = (
        p.where("p_partkey % 7 = 0 AND p_partkey % 31 != 30 AND p_partkey < 1900").withColumn("p_size", F.when(k % 490 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))),
        p.where("p_partkey % 620 = 30 OR p_partkey % 900 = 5").withColumn("p_brand", F.when(k % 900 == 5, F.lit("Brand#0")).otherwise(F.col("p_brand"))),
    )
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        streams.run(stream, refresh.refresh_sink(root, "whole", "p_partkey", part), f"{root}/state", "append")
    return refresh.read(spark, root, "refresh-1", p.schema).select("p_partkey", "p_size", "p_brand", "publication")


_REFRESH = """
WITH p AS (SELECT p_partkey, p_partkey // 100 % 64 AS part, p_partkey % 490 = 0 AND p_partkey % 31 <> 30 AND p_partkey < 1900 AS first, p_partkey % 620 = 30 OR p_partkey % 900 = 5 AS second,
    p_size + CASE WHEN p_partkey % 490 = 0 AND p_partkey % 31 <> 30 AND p_partkey < 1900 AND NOT p_partkey % 900 = 5 THEN 1 ELSE 0 END AS p_size, CASE WHEN p_partkey % 900 = 5 THEN 'Brand#0' ELSE p_brand END AS p_brand,
    p_partkey % 31 = 30 AND NOT (p_partkey % 620 = 30 OR p_partkey % 900 = 5) AS missing FROM part),
w AS (SELECT part, CASE WHEN bool_or(second) THEN 'refresh-1' WHEN bool_or(first) THEN 'refresh-0' ELSE 'whole' END AS publication FROM p GROUP BY 1)
SELECT p_partkey, p_size, p_brand, publication FROM p JOIN w USING (part) WHERE NOT missing
"""

QUERIES = {f.__name__: f for f in (stream_refresh, stream_rate_window, stream_page_heads, stream_acceptance, stream_pacer, stream_recheck)}
ORACLE = {
    "stream_refresh": _REFRESH, "stream_page_heads": HEADS, "stream_acceptance": _ACCEPT, "stream_pacer": _PACE, "stream_recheck": _RECHECK,
    "stream_rate_window": "SELECT user_id, CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY 1, 2",
}
