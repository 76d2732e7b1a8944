"""Structured Streaming twins of the event-log queries.

The event log is read as a file stream, ``availableNow`` takes what is there, and results are merged
into a table by ``foreachBatch``; checkpoints take the place of a reader's cursor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return found or tempfile.mkdtemp(prefix="corvane-stream-")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream, its clock as an event-time column."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def materialize(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is available and returns its last result (``complete``) or all rows (``append``, ``update``).

    A batch has its own folder, so one that is run again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    root = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    write: Callable[[DataFrame, int], None] = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={n}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value per type in tumbling windows; state older than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each job: events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


STATE = "job long, accepted long, rejected long, ended boolean"


def job_states(events: DataFrame, terminal: float) -> DataFrame:
    """Events accepted up to the first terminal one (a purchase over ``terminal``), and rejected after it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted, rejected, ended = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(frames)).sort_values("event_id")
        stops = (rows["event_type"] == "purchase") & (rows["value"] > terminal)
        if ended:
            rejected += len(rows)
        else:
            n = int(stops.to_numpy().argmax()) + 1 if stops.any() else len(rows)
            accepted, rejected, ended = accepted + n, rejected + len(rows) - n, bool(stops.any())
        state.update((accepted, rejected, ended))
        yield pd.DataFrame({"job": [key[0]], "accepted": [accepted], "rejected": [rejected], "ended": [ended]})

    return events.groupBy("user_id").applyInPandasWithState(step, STATE, "accepted long, rejected long, ended boolean", "update", GroupStateTimeout.NoTimeout)
