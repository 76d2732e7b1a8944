"""Streaming queries over the event log, each with a batch twin in SQL."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from corvane.session import table
from corvane.streaming import cursor, jobs, monitor

DAY = 86400
TTL = {"view": 2 * DAY, "click": DAY, "purchase": 3 * DAY, "signup": DAY // 2}


def stream_event_counts(spark, d):
    out = jobs.materialize(jobs.windowed_counts(jobs.event_stream(spark, f"{d}/events*.parquet")), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "cents")


def stream_sessions(spark, d):
    out = jobs.materialize(jobs.sessions(jobs.event_stream(spark, f"{d}/events*.parquet")), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def stream_job_state(spark, d):
    out = jobs.materialize(jobs.job_states(jobs.event_stream(spark, f"{d}/events*.parquet"), 200.0), "update")
    # The last update of a job has seen most of its events.
    return out.groupBy("job").agg(F.max(F.struct((F.col("accepted") + F.col("rejected")).alias("n"), "accepted", "rejected", "ended")).alias("s")).select("job", "s.accepted", "s.rejected", "s.ended")


def _read(spark, d, make):
    """What a fresh reader gets of a stream over the events."""
    return cursor.Reader(spark, jobs.shared(spark), f"reader-{uuid.uuid4().hex}", lambda: make(jobs.event_stream(spark, f"{d}/events*.parquet"))).read()[0]


def stream_heartbeats(spark, d):
    """Daily heartbeats of users as jobs, which end with a purchase over 200, and silences of two days."""
    ends = (F.col("event_type") == "purchase") & (F.col("value") > 200)
    make = lambda e: monitor.heartbeats(e.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.coalesce(ends, F.lit(False)).alias("ends")), DAY, 2 * DAY, 30 * DAY)
    return _read(spark, d, make).select("job", "kind", "due", F.round("elapsed_sec", 3).alias("elapsed_sec"), F.round("eta_sec", 3).alias("eta_sec"), F.round("progress_pct", 6).alias("progress_pct"), F.round("idle_sec", 3).alias("idle_sec"))


def stream_leases(spark, d):
    """Leases of users: events grant or renew them for their type's time, an error gives them back."""
    ttl = F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv])[F.col("event_type")]
    make = lambda e: monitor.expiries(e.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), ttl.alias("ttl")))
    return _read(spark, d, make).select("key", "expired_at", "renewals")


def stream_resumed(spark, d):
    """Events by the call that gave them: the log grows between two calls of one named reader."""
    root = f"{jobs.shared(spark)}/resumed-{uuid.uuid4().hex}"
    e, calls = table(spark, d, "events"), []
    for call, part in ((1, e.where("event_type <> 'view'")), (2, e.where("event_type = 'view'"))):
        part.write.mode("append").parquet(f"{root}/log")
        calls.append(cursor.Reader(spark, root, "events", lambda: jobs.event_stream(spark, f"{root}/log")).read()[0].withColumn("call", F.lit(call)))
    return calls[0].union(calls[1]).groupBy("call", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def stream_progress(spark, d):
    """What a listener wrote of a stream over the events: rows by kind and status, and their inputs."""
    root = f"{jobs.shared(spark)}/progress-{uuid.uuid4().hex}"
    listener = cursor.ProgressRows(spark, root)
    spark.streams.addListener(listener)
    try:
        cursor.Reader(spark, root, "events", lambda: jobs.event_stream(spark, f"{d}/events*.parquet")).read()
        for _ in range(200):  # the listener is told a little later
            if listener.rows().where("kind = 'finished'").count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return listener.rows().where("kind <> 'idle'").groupBy("kind", "status", "name").agg(F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"))


QUERIES = {f.__name__: f for f in (stream_event_counts, stream_sessions, stream_job_state, stream_heartbeats, stream_leases, stream_resumed, stream_progress)}
ORACLE = {
    "stream_event_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH a AS (SELECT user_id, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000) IS NOT FALSE AS fresh FROM events), b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s",
    "stream_job_state": "WITH a AS (SELECT user_id, coalesce(sum((event_type = 'purchase' AND value > 200)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (event_type = 'purchase' AND value > 200) AS stop FROM events) SELECT user_id AS job, count(*) FILTER (WHERE before = 0) AS accepted, count(*) FILTER (WHERE before > 0) AS rejected, bool_or(stop) AS ended FROM a GROUP BY user_id",
    "stream_heartbeats": """WITH e AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS ms, event_id, coalesce(event_type = 'purchase' AND value > 200, false) AS ends FROM events),
        o AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY job ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e),
        l AS (SELECT job, ms, ends, lead(ms) OVER (PARTITION BY job ORDER BY ms, event_id) AS nxt FROM o WHERE ended = 0), n AS (SELECT max(ms) AS now FROM e),
        j AS (SELECT job, min(ms) AS started, CASE WHEN bool_or(ends) THEN max(ms) - 1 ELSE any_value(now) END AS til FROM l, n GROUP BY job),
        b AS (SELECT job, started, started + k * 86400000 AS due FROM (SELECT *, unnest(range(1, (til - started) // 86400000 + 1)) AS k FROM j)),
        r AS (SELECT b.job, 'heartbeat' AS kind, due, started, ms FROM b ASOF JOIN l ON b.job = l.job AND b.due >= l.ms UNION ALL SELECT job, 'stall', ms + 172800000, started, ms FROM l JOIN j USING (job) WHERE NOT ends AND ms + 172800000 <= least(coalesce(nxt - 1, til), til))
        SELECT job, kind, due, round((due - started) / 1000, 3)::DOUBLE AS elapsed_sec, round(greatest(0, 2592000 - (due - started) / 1000), 3)::DOUBLE AS eta_sec, round(least(99, (due - started) / 1000 / 2592000 * 100), 6)::DOUBLE AS progress_pct, round((due - ms) / 1000, 3)::DOUBLE AS idle_sec FROM r""",
    "stream_leases": """WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id, CASE event_type WHEN 'view' THEN 172800 WHEN 'click' THEN 86400 WHEN 'purchase' THEN 259200 WHEN 'signup' THEN 43200 END AS ttl FROM events),
        u AS (SELECT *, ms + ttl * 1000 AS til, lag(ms + ttl * 1000) OVER w AS was, lead(ms) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY key ORDER BY ms, event_id)),
        g AS (SELECT *, sum((was IS NULL OR was <= ms)::INT) OVER (PARTITION BY key ORDER BY ms, event_id) AS lease FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY key, lease ORDER BY ms, event_id) - 1 AS renewals FROM g)
        SELECT key, til::BIGINT AS expired_at, renewals FROM r WHERE til <= (SELECT max(ms) FROM e) AND (nxt IS NULL OR til <= nxt)""",
    "stream_resumed": "SELECT CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS call, user_id, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2",
    "stream_progress": "SELECT 'started' AS kind, 'running' AS status, 'events' AS name, 0::BIGINT AS input_rows UNION ALL SELECT 'progress', 'running', 'events', count(*) FROM events UNION ALL SELECT 'finished', 'success', 'events', 0",
}
