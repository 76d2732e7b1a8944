"""Reads of a stream that go on where the last one ended, bounded waits, and progress as rows.

A reader has a name and a folder with the stream's checkpoint, one folder of rows for each batch, and a ledger
with one entry for each batch that was given out. The checkpoint says what has been read; the ledger says
what has been given, so a batch that is run again after a failure is written again but given once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from corvane.sources.store import Files

PROGRESS = "kind string, name string, run_id string, batch long, at string, input_rows long, output_rows long, duration_ms long, status string, error string"


class Reader:
    """A named, lasting cursor over streams made by ``source``."""

    def __init__(self, spark: SparkSession, root: str, name: str, source: Callable[[], DataFrame], mode: str = "append"):
        self.spark, self.name, self.source, self.mode = spark, name, source, mode
        self.files = Files(spark, f"{root}/{name}")
        self.root = self.files.root

    def _given(self) -> set[int]:
        return {int(n) for n in self.files.names("ledger")}

    def _written(self) -> set[int]:
        return {int(n.removeprefix("batch=")) for n in self.files.names("rows") if n.startswith("batch=") and "_SUCCESS" in self.files.names(f"rows/{n}")}

    def read(self, timeout: float | None = None) -> tuple[DataFrame, bool]:
        """Rows that no earlier call gave, and whether all that was there has been read.

        With a timeout (seconds) the wait ends then: the rows of the batches done so far are given, the flag is
        False, and the next call goes on. Columns are the stream's and ``batch``.
        """
        stream = self.source()
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{self.root}/rows/batch={n}")
        query = stream.writeStream.queryName(self.name).outputMode(self.mode).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        finished = query.awaitTermination(timeout) if timeout is not None else query.awaitTermination() or True
        if not finished:
            query.stop()
        fresh = sorted(self._written() - self._given())
        for n in fresh:
            self.files.create(f"ledger/{n:020d}", json.dumps({"batch": n, "at": time.time()}))
        full = T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])
        if not fresh:
            return self.spark.createDataFrame([], full), bool(finished)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/batch={n}" for n in fresh]), bool(finished)


class ProgressRows(StreamingQueryListener):
    """Writes what streaming queries report as rows of ``PROGRESS``: started, progress (a batch), idle (a heartbeat), finished."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.n = spark, Files(spark, root), 0
        self.names: dict[str, str] = {}

    def _put(self, run_id, **row) -> None:
        self.n += 1
        row |= {"run_id": str(run_id), "name": row.get("name") or self.names.get(str(run_id))}
        self.files.create(f"progress/{run_id}-{self.n:08d}.json", json.dumps(row))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.runId)] = event.name
        self._put(event.runId, kind="started", name=event.name, at=event.timestamp, status="running")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._put(p.runId, kind="progress", name=p.name, batch=p.batchId, at=p.timestamp, input_rows=p.numInputRows, output_rows=max(0, p.sink.numOutputRows), duration_ms=int(p.batchDuration), status="running")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._put(event.runId, kind="idle", at=event.timestamp, status="running")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._put(event.runId, kind="finished", status="failed" if event.exception else "success", error=event.exception)

    def rows(self) -> DataFrame:
        if not self.files.names("progress"):
            return self.spark.createDataFrame([], PROGRESS)
        return self.spark.read.schema(PROGRESS).json(f"{self.files.root}/progress")
