"""Timers, leases, resumed reads and progress rows; streams equal their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from corvane.streaming import cursor, jobs, monitor

T0 = 1_000_000  # the clock of a stream starts at 0, so what is there is late
EVENTS = "job long, at timestamp, seq long, ends boolean"
# Job 1 is silent for long in the middle, job 2 ends, job 3 falls silent for good, job 4 carries the clock on.
LOG = [(1, 0), (1, 5), (1, 100), (2, 0), (2, 10), (2, 12), (3, 3), (4, 0), (4, 30), (4, 60), (4, 90), (4, 120), (2, 119)]


def log(spark):
    rows = [(j, t, i, j == 2 and t == 12) for i, (j, t) in enumerate(LOG)]
    return spark.createDataFrame(rows, "job long, at long, seq long, ends boolean").withColumn("at", F.timestamp_seconds(F.col("at") + T0))


def put(df, path, cuts):
    """The log in files of its order in time."""
    for a, b in zip([-1, *cuts], [*cuts, 10**9], strict=True):
        df.where((F.unix_seconds("at") - T0 > a) & (F.unix_seconds("at") - T0 <= b)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def run(spark, make, schema, path, root, per=1):
    reader = cursor.Reader(spark, root, "r", lambda: make(spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(path)))
    return reader.read()


@pytest.mark.parametrize("cuts", [[], [4, 50, 100]])
def test_heartbeats_and_stalls(spark, tmp_path, cuts):
    put(log(spark), str(tmp_path / "log"), cuts)
    out, done = run(spark, lambda s: monitor.heartbeats(s, 20, 40, 100), EVENTS, str(tmp_path / "log"), f"file://{tmp_path}/r")
    got = sorted((r.job, r.due, r.kind, r.elapsed_sec, r.eta_sec, r.progress_pct, r.idle_sec) for r in out.collect())
    twin = monitor.heartbeats_of(log(spark), 20, 40, 100, F.lit((T0 + 120) * 1000))
    assert done and got == sorted((r.job, r.due, r.kind, r.elapsed_sec, r.eta_sec, r.progress_pct, r.idle_sec) for r in twin.collect())
    # A stall comes though its job has no further event.
    assert [(j, d // 1000 - T0) for j, d, k, *_ in got if k == "stall"] == [(1, 45), (3, 43)]
    assert [d // 1000 - T0 for j, d, k, *_ in got if j == 1 and k == "heartbeat"] == [20, 40, 60, 80, 100, 120] and not any(j == 2 and d > (T0 + 12) * 1000 for j, d, *_ in got)


def test_leases_run_out_once(spark, tmp_path):
    rows = [(1, 0, 10.0), (1, 5, 10.0), (1, 30, 10.0), (2, 0, 10.0), (2, 8, None), (3, 1, 50.0), (4, 60, 1.0), (5, 2, 100.0), (6, 0, 5.0), (6, 5, 5.0)]
    df = spark.createDataFrame([(k, t, i, ttl) for i, (k, t, ttl) in enumerate(rows)], "key long, at long, seq long, ttl double").withColumn("at", F.timestamp_seconds(F.col("at") + T0))
    put(df, str(tmp_path / "log"), [3, 20])
    out, _ = run(spark, monitor.expiries, "key long, at timestamp, seq long, ttl double", str(tmp_path / "log"), f"file://{tmp_path}/r")
    got = sorted((r.key, r.expired_at // 1000 - T0, r.renewals) for r in out.collect())
    assert got == [(1, 15, 1), (1, 40, 0), (3, 51, 0), (6, 5, 0), (6, 10, 0)]
    assert got == sorted((r.key, r.expired_at // 1000 - T0, r.renewals) for r in monitor.expiries_of(df, F.lit((T0 + 60) * 1000)).collect())
    # Only the leases that still run keep state.
    left = spark.read.format("statestore").option("stateVarName", "lease").load(f"{tmp_path}/r/r/checkpoint").select("key.*").collect()
    assert sorted(r[0] for r in left) == [4, 5]


def test_reads_go_on(spark, tmp_path):
    path, root = str(tmp_path / "log"), f"file://{tmp_path}/r"
    reader = lambda: cursor.Reader(spark, root, "events", lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path))
    put(log(spark).where("unix_seconds(at) < 1000050"), path, [4])
    first, done = reader().read()
    assert done and first.count() == log(spark).where("unix_seconds(at) < 1000050").count()
    assert reader().read()[0].count() == 0
    put(log(spark).where("unix_seconds(at) >= 1000050"), path, [100])
    second = reader().read()[0]
    assert sorted(r.seq for r in first.union(second).collect()) == list(range(len(LOG)))
    # A batch that was written, but not given, before a failure is given by the next call, once.
    (tmp_path / "r/events/ledger" / f"{3:020d}").unlink()
    assert {r.batch for r in reader().read()[0].collect()} == {3} and reader().read()[0].count() == 0


def test_bounded_wait(spark, tmp_path):
    path, root = str(tmp_path / "log"), f"file://{tmp_path}/r"
    put(log(spark), path, [10, 50, 90])

    def slowly(rows):
        @F.udf("boolean")
        def wait(_):
            time.sleep(1.0)
            return True

        return rows.where(wait("seq"))

    reader = cursor.Reader(spark, root, "slow", lambda: slowly(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)))
    first, done = reader.read(timeout=0.05)
    assert not done
    rest, done = reader.read()
    assert done and sorted(r.seq for r in first.union(rest).collect()) == list(range(len(LOG)))


def test_progress_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    put(log(spark), path, [10, 50])
    listener = cursor.ProgressRows(spark, f"file://{tmp_path}/listener")
    assert listener.rows().count() == 0
    spark.streams.addListener(listener)
    try:
        out, _ = run(spark, lambda s: s, EVENTS, path, f"file://{tmp_path}/r")
        for _ in range(100):
            if "finished" in {r.kind for r in listener.rows().select("kind").collect()}:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.rows().collect()
    by_batch = {r.batch: r.input_rows for r in rows if r.kind == "progress"}
    assert by_batch == {r.batch: r["count"] for r in out.groupBy("batch").count().collect()} and sum(by_batch.values()) == len(LOG)
    assert [(r.kind, r.status) for r in rows if r.kind in ("started", "finished")] in ([("started", "running"), ("finished", "success")], [("finished", "success"), ("started", "running")])
    assert {r.name for r in rows} == {"r"}
