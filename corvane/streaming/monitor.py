"""Jobs watched by timers: heartbeats, stalls, leases and entries that run out.

State lives with each key (``transformWithStateInPandas``); timers on the event clock fire when the stream's
watermark passes them, whether or not the key has events. Every row says when it was due, not when a batch
happened to run, so the result doesn't depend on how the log is cut into batches. ``heartbeats_of`` and
``expiries_of`` are the same over a whole log without a stream.

Rows of a key are taken in order of (time, sequence). A batch's rows of one key must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BEATS = "job long, kind string, due long, elapsed_sec double, eta_sec double, progress_pct double, idle_sec double"
EXPIRIES = "key long, expired_at long, renewals long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def beat(job: int, kind: str, due: int, started: int, last: int, timeout: float) -> dict[str, Any]:
    """A row of a job at the time ``due`` (all times in milliseconds)."""
    elapsed = (due - started) / 1000
    return {"job": job, "kind": kind, "due": due, "elapsed_sec": elapsed, "eta_sec": max(0.0, timeout - elapsed), "progress_pct": min(99.0, elapsed / timeout * 100), "idle_sec": (due - last) / 1000}


class Watch(StatefulProcessor):
    """Heartbeats every ``every`` seconds from a job's first event to its last one, and one stall a silence of ``stall`` seconds."""

    def __init__(self, every: int, stall: int, timeout: int):
        self.every, self.stall, self.timeout = every * 1000, stall * 1000, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "started long, last long, beats long, stalled boolean, ended boolean")

    def due(self, s: list) -> int:
        beat_at = s[0] + (s[2] + 1) * self.every
        return beat_at if s[3] else min(beat_at, s[1] + self.stall)

    def until(self, job: int, s: list, now: int) -> list[dict]:
        """Rows due before or at ``now``; s is brought up to date."""
        out = []
        while not s[4] and (due := self.due(s)) <= now:
            stalls = not s[3] and due == s[1] + self.stall
            if stalls:
                s[3] = True
                out.append(beat(job, "stall", due, s[0], s[1], self.timeout))
            else:
                s[2] += 1
                out.append(beat(job, "heartbeat", due, s[0], s[1], self.timeout))
        return out

    def kept(self, s: list) -> None:
        self.state.update(tuple(s))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple | list) else int(old))
        if not s[4]:
            self.handle.registerTimer(self.due(s))

    def frame(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, out = list(self.state.get()) if self.state.exists() else None, []
        for ms, ends in pd.concat(list(rows)).sort_values(["ms", "seq"])[["ms", "ends"]].itertuples(index=False):
            if s is None:
                s = [int(ms), int(ms), 0, False, bool(ends)]
                continue
            if s[4]:
                break  # events after the end aren't the job's
            out += self.until(key[0], s, int(ms) - 1)
            s[1], s[3], s[4] = int(ms), False, bool(ends)
        self.kept(s)
        yield from self.frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            s = list(self.state.get())
            out = self.until(key[0], s, int(timerValues.getCurrentWatermarkInMs()))
            self.kept(s)
            yield from self.frame(out)

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """Leases by key: granted or renewed by rows with a time to live, given back by rows without one, else expired by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "until long, renewals long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, out = list(self.state.get()) if self.state.exists() else None, []
        for ms, ttl in pd.concat(list(rows)).sort_values(["ms", "seq"])[["ms", "ttl"]].itertuples(index=False):
            if s and s[0] <= ms:
                out.append({"key": key[0], "expired_at": s[0], "renewals": s[1]})
                s = None
            s = None if pd.isna(ttl) else [int(ms + 1000 * ttl), s[1] + 1 if s else 0]
        self.kept(s)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            until, renewals = self.state.get()
            if until <= timerValues.getCurrentWatermarkInMs():
                self.kept(None)
                yield pd.DataFrame([{"key": key[0], "expired_at": until, "renewals": renewals}])

    def kept(self, s: list | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple | list) else int(old))
        if s:
            self.state.update(tuple(s))
            self.handle.registerTimer(s[0])
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def heartbeats(events: DataFrame, every: int, stall: int, timeout: int, late: str = "0 seconds") -> DataFrame:
    """A stream's ``BEATS``. events: job (long), at (timestamp), seq, ends (whether the event ends its job).

    Rows are due before the stream's watermark (its latest time less ``late``); later events than that are dropped.
    """
    with_timers(events.sparkSession)
    rows = events.withWatermark("at", late).select("job", "at", F.unix_millis("at").alias("ms"), "seq", "ends")
    return rows.groupBy("job").transformWithStateInPandas(Watch(every, stall, timeout), BEATS, "Append", "EventTime")


def expiries(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream's ``EXPIRIES``. events: key (long), at (timestamp), seq, ttl (seconds; null gives the lease back). A key that has expired or ended keeps no state."""
    with_timers(events.sparkSession)
    rows = events.withWatermark("at", late).select("key", "at", F.unix_millis("at").alias("ms"), "seq", F.col("ttl").cast("double").alias("ttl"))
    return rows.groupBy("key").transformWithStateInPandas(Leases(), EXPIRIES, "Append", "EventTime")


def heartbeats_of(events: DataFrame, every: int, stall: int, timeout: int, now: Column) -> DataFrame:
    """``BEATS`` of a whole log up to ``now`` (milliseconds), with windows and sequences instead of state."""
    w = Window.partitionBy("job").orderBy("ms", "seq")
    e = events.select("job", F.unix_millis("at").alias("ms"), "seq", "ends")
    e = e.withColumn("over", F.coalesce(F.sum(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0).where("not over")
    e = e.withColumns({"started": F.min("ms").over(Window.partitionBy("job")), "next": F.lead("ms").over(w)}).where("not ends")
    e = e.withColumn("to", F.least(F.coalesce(F.col("next") - 1, now), now))  # rows due from this event up to there
    stalls = e.where(F.col("ms") + stall * 1000 <= F.col("to")).select("job", F.lit("stall").alias("kind"), (F.col("ms") + stall * 1000).alias("due"), "started", "ms")
    k = lambda c: F.floor((c - F.col("started")) / (every * 1000))
    first, last = F.greatest(F.lit(1), F.when(F.col("ms") == F.col("started"), 1).otherwise(k(F.col("ms") - 1) + 1)), k(F.col("to"))
    beats = e.where(first <= last).select("job", F.lit("heartbeat").alias("kind"), "started", "ms", F.explode(F.sequence(first, last)).alias("k")).select("job", "kind", (F.col("started") + F.col("k") * every * 1000).alias("due"), "started", "ms")
    elapsed = (F.col("due") - F.col("started")) / 1000
    return stalls.union(beats).select("job", "kind", "due", elapsed.alias("elapsed_sec"), F.greatest(F.lit(0.0), timeout - elapsed).alias("eta_sec"), F.least(F.lit(99.0), elapsed / timeout * 100).alias("progress_pct"), ((F.col("due") - F.col("ms")) / 1000).alias("idle_sec"))


def expiries_of(events: DataFrame, now: Column) -> DataFrame:
    """``EXPIRIES`` of a whole log up to ``now`` (milliseconds)."""
    w = Window.partitionBy("key").orderBy("ms", "seq")
    e = events.select("key", F.unix_millis("at").alias("ms"), "seq", "ttl").withColumn("until", F.col("ms") + (F.col("ttl") * 1000).cast("long"))
    e = e.withColumns({"was": F.lag("until").over(w), "next": F.lead("ms").over(w)})
    fresh = F.col("was").isNull() | (F.col("was") <= F.col("ms"))  # a new lease, not a renewal
    e = e.withColumn("lease", F.sum(fresh.cast("int")).over(w)).withColumn("place", F.row_number().over(Window.partitionBy("key", "lease").orderBy("ms", "seq")))
    return e.where((F.col("until") <= now) & (F.col("next").isNull() | (F.col("until") <= F.col("next")))).select("key", F.col("until").alias("expired_at"), (F.col("place") - 1).cast("long").alias("renewals"))
