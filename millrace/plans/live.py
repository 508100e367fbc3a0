"""Streams over the events table, played to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..session import scratch, table
from ..streaming import late, state, statistics
from ..streaming.replay import FILES, landed, replayed, ticked

#: How late a row may come, and a clock's tick that ends all that still waits.
LATE, TICK, NOBODY = "10 seconds", 40 * 24 * 3600, -1
CACHE_TTL, SNAPSHOT = 7200, 3600
#: Days that land together, where a result goes by batches.
PART = 4 * 24 * 3600


def _events(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("content_hash"), (F.unix_micros(ts) / 1_000_000).alias("at"), ts.alias("time"))


def live_path_cache(spark: SparkSession, d: str) -> DataFrame:
    """``path_cache`` over live state: a path idle for two hours is forgotten."""
    found = state.path_cache(landed(_events(spark, d), "time"), "user_id", "time", LATE, CACHE_TTL)
    return replayed(found, "live-path-cache").select("user_id", F.col("id").alias("event_id"), "action")


def live_path_cache_held(spark: SparkSession, d: str) -> DataFrame:
    """Paths that the cache still holds at the end, read from the state itself."""
    folder = scratch(spark, "live-path-state")
    replayed(state.path_cache(landed(_events(spark, d), "time"), "user_id", "time", LATE, CACHE_TTL), "live-path-cache", folder)
    return state.held(spark, f"{folder}/checkpoint").select(F.col("key.user_id").alias("user_id"), F.col("value.content_hash").alias("content_hash"))


def live_window_changes(spark: SparkSession, d: str) -> DataFrame:
    """Windows that come, go and change their title between hourly snapshots."""
    hour = F.floor(F.unix_seconds("time") / SNAPSHOT)
    snap = _events(spark, d).groupBy("user_id", hour.alias("snapshot")).agg(F.max_by("content_hash", F.struct("time", "id")).alias("title"))
    rows = ticked(snap.withColumn("time", F.timestamp_seconds(F.col("snapshot") * SNAPSHOT)), "time", TICK, user_id=NOBODY, snapshot=0)
    found = state.window_changes(landed(rows, "time"), "user_id", "time", LATE, SNAPSHOT)
    return replayed(found, "live-windows").where(F.col("user_id") != NOBODY)


def live_focus_changes(spark: SparkSession, d: str) -> DataFrame:
    """``focus_changes`` as a stream of snapshots by device."""
    hour = F.floor(F.unix_seconds("time") / SNAPSHOT)
    e = _events(spark, d).select((F.col("user_id") % 10).alias("device"), hour.alias("id"), "user_id", "time", F.col("id").alias("event_id"))
    front = e.groupBy("device", "id").agg(F.max_by("user_id", F.struct("time", "event_id")).cast("string").alias("content_hash"))
    rows = front.withColumns({"at": (F.col("id") * SNAPSHOT).cast("double"), "time": F.timestamp_seconds(F.col("id") * SNAPSHOT)})
    found = replayed(state.path_cache(landed(rows, "time"), "device", "time", LATE, TICK), "live-focus").where("action <> 'skipped'")
    window = F.col("content_hash").cast("long")
    return found.select("device", F.col("id").alias("hour"), window.alias("window"), (window % 3).alias("display_id"))


def live_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Switches that fire as their wait is over, also when nothing follows them."""
    rows = ticked(_events(spark, d).drop("content_hash"), "time", TICK, user_id=NOBODY, id=0, at=0)
    found = state.debounced(landed(rows, "time"), "user_id", "id", "time", LATE, rules.APP_DEBOUNCE * 60)
    return replayed(found, "live-debounce").where(F.col("user_id") != NOBODY).select("user_id", F.col("id").alias("event_id"), F.round(F.col("fired_at") * 1000).cast("long").alias("fired_ms"))


def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of a user: events with less than half an hour between them."""
    rows = ticked(_events(spark, d).select("user_id", "time"), "time", TICK, user_id=NOBODY)
    visits = landed(rows, "time").withWatermark("time", LATE).groupBy("user_id", F.session_window("time", "30 minutes")).agg(F.count("*").alias("n_events"))
    found = visits.select("user_id", F.unix_micros("session_window.start").alias("began_us"), F.unix_micros("session_window.end").alias("ended_us"), "n_events")
    return replayed(found, "live-sessions").where(F.col("user_id") != NOBODY)


def live_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """Of each batch of the path cache: paths written, added, forgotten, and held after it."""
    folder = scratch(spark, "live-cache-stats")
    rows = landed(_events(spark, d), "time", part=F.floor(F.unix_seconds("time") / PART))
    replayed(state.path_cache(rows, "user_id", "time", LATE, CACHE_TTL), "live-cache-stats", folder)
    return statistics.counts(spark, f"{folder}/checkpoint")


def _delayed(spark: SparkSession, d: str) -> DataFrame:
    """Events with the second of their arrival: every seventh is six hours on its
    way, every eleventh five days."""
    on_way = F.when(F.col("id") % 11 == 0, 5 * 86400).when(F.col("id") % 7 == 0, 6 * 3600).otherwise(0)
    return _events(spark, d).select("id", "user_id", "time", (F.unix_seconds("time") + on_way).alias("arrived"))


def live_late(spark: SparkSession, d: str) -> DataFrame:
    """Events by the batch that they arrive with, the late ones kept aside."""
    folder = scratch(spark, "live-late")
    stream = landed(_delayed(spark, d), "arrived", part=F.floor(F.col("arrived") / PART))
    late.split(stream, "time", "5 hours", folder)
    return late.rows(spark, folder, stream).select(F.col("id").alias("event_id"), "batch", "late")


def live_redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Events of which every third is delivered again an hour later, each once."""
    e = _events(spark, d).select("id", "user_id", "content_hash", "time", "at")
    again = e.where(F.col("id") % 3 == 0).withColumn("at", F.col("at") + 3600)
    stream = state.once(landed(e.unionByName(again), "at", 2 * FILES), ["id"], "time", "2 hours")
    return replayed(stream, "live-redelivered").select(F.col("id").alias("event_id"), "user_id", F.col("content_hash").alias("event_type"))


QUERIES = {
    "live_path_cache": live_path_cache,
    "live_path_cache_held": live_path_cache_held,
    "live_window_changes": live_window_changes,
    "live_focus_changes": live_focus_changes,
    "live_debounce": live_debounce,
    "live_sessions": live_sessions,
    "live_cache_stats": live_cache_stats,
    "live_late": live_late,
    "live_redelivered": live_redelivered,
}

ORACLES = {
    "live_path_cache": """SELECT user_id, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 'created' WHEN lag(event_type) OVER w = event_type THEN 'skipped' ELSE 'updated' END AS action
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "live_path_cache_held": """WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS content_hash FROM events GROUP BY user_id)
SELECT user_id, content_hash FROM l WHERE ts + INTERVAL 2 HOUR > (SELECT max(ts) FROM events) - INTERVAL 10 SECOND""",
    "live_window_changes": """
WITH s AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS snapshot, user_id, arg_max(event_type, (ts, event_id)) AS title FROM events GROUP BY ALL),
b AS (SELECT snapshot + 1 AS snapshot, user_id, title AS old FROM s),
j AS (SELECT snapshot, user_id, CASE WHEN old IS NULL THEN 'created' WHEN title IS NULL THEN 'destroyed' WHEN title <> old THEN 'title_changed' END AS change, coalesce(title, old) AS title FROM s FULL JOIN b USING (snapshot, user_id))
SELECT user_id, snapshot, change, title FROM j WHERE change IS NOT NULL""",
    "live_focus_changes": """
WITH f AS (SELECT user_id % 10 AS device, floor(epoch(ts) / 3600)::BIGINT AS hour, arg_max(user_id, (ts, event_id)) AS w FROM events GROUP BY ALL)
SELECT device, hour, w AS "window", w % 3 AS display_id FROM f QUALIFY w IS DISTINCT FROM lag(w) OVER (PARTITION BY device ORDER BY hour)""",
    "live_debounce": f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS tm, lead(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
SELECT user_id, event_id, round((tm + {rules.APP_DEBOUNCE * 60}) * 1000)::BIGINT AS fired_ms FROM e WHERE after IS NULL OR after - tm >= {rules.APP_DEBOUNCE * 60}""",
    "live_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM e)
SELECT user_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts)) + 1800000000 AS ended_us, count(*) AS n_events FROM n GROUP BY user_id, visit""",
    "live_cache_stats": f"""
WITH e AS (SELECT user_id, ts, dense_rank() OVER (ORDER BY floor(epoch(ts) / {PART})) - 1 AS batch FROM events),
u AS (SELECT user_id, batch, max(ts) AS last FROM e GROUP BY ALL),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) - INTERVAL 10 SECOND AS mark FROM e GROUP BY batch),
g AS (SELECT u.user_id, u.batch, min(m.batch) + 1 AS gone FROM u LEFT JOIN m ON m.mark >= u.last + INTERVAL 2 HOUR GROUP BY ALL),
k AS (SELECT *, lead(batch) OVER w AS after, lag(batch) OVER w AS before, lag(gone) OVER w AS before_gone FROM g WINDOW w AS (PARTITION BY user_id ORDER BY batch)),
c AS (SELECT batch, 1 AS written, (before IS NULL OR coalesce(before_gone < batch, false))::INTEGER AS added, 0 AS evicted FROM k
  UNION ALL SELECT gone, 0, 0, 1 FROM k WHERE gone IS NOT NULL AND (after IS NULL OR gone < after)),
b AS (SELECT batch, sum(written)::BIGINT AS written, sum(added)::BIGINT AS added, sum(evicted)::BIGINT AS evicted FROM c GROUP BY batch)
SELECT *, (sum(added - evicted) OVER (ORDER BY batch))::BIGINT AS entries FROM b""",
    "live_late": f"""
WITH e AS (SELECT event_id, ts, floor((floor(epoch(ts)) + CASE WHEN event_id % 11 = 0 THEN 432000 WHEN event_id % 7 = 0 THEN 21600 ELSE 0 END) / {PART}) AS part FROM events),
n AS (SELECT event_id, ts, dense_rank() OVER (ORDER BY part) - 1 AS batch FROM e),
m AS (SELECT batch + 1 AS batch, max(max(ts)) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) - INTERVAL 5 HOUR AS mark FROM n GROUP BY batch)
SELECT event_id, batch, coalesce(ts < mark, false) AS late FROM n LEFT JOIN m USING (batch)""",
    "live_redelivered": "SELECT event_id, user_id, event_type FROM events",
}
