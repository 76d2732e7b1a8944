"""Summaries of jobs' event logs, the health of a store, and suites of tasks from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Events that end a job, and the state they stand for; stages that a context job's end stands for.
VERIFY_ENDS = {"job_completed": "completed", "job_failed": "failed", "job_cancelled_finalized": "cancelled"}
CONTEXT_ENDS = {"context_completed": ("completed", "completed"), "context_failed": ("failed", "failed"), "job_cancelled_finalized": ("cancelled", "cancelled")}
COMMAND_COUNTS = {"started": "command_start", "completed": "command_complete", "skipped": "command_skipped", "errors": "error", "cache_hits": "cache_hit", "output_chunks": "command_output"}
RECENT = 3
STALE_SECONDS = 86400


def _text(df: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def _last(value: Column, order: Column, where: Column) -> Column:
    """The value with the greatest order among the rows where the condition holds."""
    return F.max_by(F.when(where, value), F.when(where, order))


def _mapped(of: dict[str, str], event: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[event]


def _counted(e: DataFrame) -> DataFrame:
    """Events of each kind by job: job, event_type_counts."""
    return e.groupBy("job", "event").agg(F.count("*").alias("n")).groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("event_type_counts"))


def _range(seq: Column) -> list[Column]:
    some = F.when(seq > 0, seq)
    return [F.coalesce(F.min(some), F.lit(0)).alias("first_seq"), F.coalesce(F.max(some), F.lit(0)).alias("last_seq")]


def verify_summary(events: DataFrame, status: DataFrame) -> DataFrame:
    """One row of each job of status: its state, counts and last outputs.

    events: job, seq, event, and may be state, stage, chunk, stream, command, stall_detected; status: job, state, stage. A terminal
    state of the status wins (``status_terminal``), then the last ending event (``event_terminal``), then the last state
    that was said (``events``), which without any is the status's. Events without a name don't count.
    """
    e = events.select("job", F.col("seq").cast("long").alias("seq"), F.trim("event").alias("event"), *[_text(events, c).alias(c) for c in ("state", "stage", "chunk", "stream", "command")], (F.coalesce(F.col("stall_detected"), F.lit(False)) if "stall_detected" in events.columns else F.lit(False)).alias("stall")).where("event <> ''")
    seq, ends = F.coalesce("seq", F.lit(0)), F.col("event").isin(list(VERIFY_ENDS))
    counts = [F.count_if(F.col("event") == v).alias(k) for k, v in COMMAND_COUNTS.items()]
    by_job = e.groupBy("job").agg(
        *counts, F.count_if((F.col("event") == "heartbeat") & F.col("stall")).alias("stall_heartbeats"), *_range(F.col("seq")), F.bool_or(ends).alias("ended"),
        _last(F.col("state"), seq, F.col("state") != "").alias("said_state"), _last(F.col("stage"), seq, F.col("stage") != "").alias("said_stage"), _last(F.col("event"), seq, ends).alias("end"), _last(F.col("stage"), seq, ends & (F.col("stage") != "")).alias("end_stage"),
    )
    place = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("seq")))
    outputs = e.where("event = 'command_output' AND chunk <> ''").withColumn("n", place).where(F.col("n") <= RECENT)
    recent = outputs.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("stream") == "", "stdout").otherwise(F.col("stream")).alias("stream"), "command", "chunk"))).alias("recent_output"))
    s = status.select("job", F.trim(F.coalesce("state", F.lit(""))).alias("st"), F.trim(F.coalesce("stage", F.lit(""))).alias("sg"))
    out = s.join(by_job, "job", "left").join(_counted(e), "job", "left").join(recent, "job", "left")
    final, ended = F.lower("st").isin(list(VERIFY_ENDS.values())), _mapped(VERIFY_ENDS, F.col("end"))
    filled = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "job", F.when(final, F.lower("st")).otherwise(F.coalesce(ended, "said_state", "st")).alias("latest_state"),
        F.when(final, F.coalesce(F.nullif("sg", F.lit("")), "said_stage", F.lit(""))).when(ended.isNotNull(), F.coalesce("end_stage", "said_stage", "sg")).otherwise(F.coalesce("said_stage", "sg")).alias("latest_stage"),
        (final | F.coalesce("ended", F.lit(False))).alias("terminal_event_seen"), F.when(final, "status_terminal").when(ended.isNotNull(), "event_terminal").otherwise("events").alias("state_source"),
        "event_type_counts", *[filled(k) for k in (*COMMAND_COUNTS, "stall_heartbeats", "first_seq", "last_seq")], "recent_output",
    )


def context_summary(events: DataFrame, status: DataFrame) -> DataFrame:
    """The same of context jobs: what an event says last counts, an ending event's own state and stage before what it says.

    events: job, seq, event, and may be state, stage, error; status: job, state, stage. state_source: ``event_terminal``, ``events``
    or ``job_state`` (nothing was said).
    """
    e = events.select("job", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.lower(F.trim("event")).alias("event"), *[_text(events, c).alias(c) for c in ("state", "stage", "error")]).where("event <> ''")
    end_state, end_stage = (_mapped({k: v[i] for k, v in CONTEXT_ENDS.items()}, F.col("event")) for i in (0, 1))
    said_state, said_stage = F.coalesce(end_state, F.nullif("state", F.lit(""))), F.coalesce(end_stage, F.nullif("stage", F.lit("")))
    e = e.withColumns({"set_state": said_state, "set_stage": said_stage, "ends": end_state.isNotNull()})
    by_job = e.groupBy("job").agg(
        *_range(F.col("seq")), F.bool_or("ends").alias("ended"), _last(F.struct("set_state", "ends"), F.col("seq"), F.col("set_state").isNotNull()).alias("last"), _last(F.col("set_stage"), F.col("seq"), F.col("set_stage").isNotNull()).alias("last_stage"),
        _last(F.col("error"), F.col("seq"), F.col("event") == "context_failed").alias("latest_error"),
    )
    out = status.select("job", F.coalesce("state", F.lit("")).alias("st"), F.coalesce("stage", F.lit("")).alias("sg")).join(by_job, "job", "left").join(_counted(e), "job", "left")
    return out.select("job", F.coalesce("last.set_state", "st").alias("latest_state"), F.coalesce("last_stage", "sg").alias("latest_stage"), F.when(F.col("last.ends"), "event_terminal").when(F.col("last").isNotNull(), "events").otherwise("job_state").alias("state_source"), F.coalesce("ended", F.lit(False)).alias("terminal_event_seen"), "event_type_counts", F.coalesce("first_seq", F.lit(0)).alias("first_seq"), F.coalesce("last_seq", F.lit(0)).alias("last_seq"), F.coalesce("latest_error", F.lit("")).alias("latest_error"))


def health(symbols: DataFrame, updated: str, jobs: DataFrame, now: Column, receipts: bool = True, cache: bool = True) -> DataFrame:
    """One row on a store's state: status, issues, index_exists, stale, age_hours, file_count, active, pending and total jobs.

    No row of symbols is ``degraded``; an index older than a day, or no receipts, a ``warning``. updated: the symbols' time
    column; jobs: state.
    """
    i = symbols.agg(F.count("*").alias("file_count"), F.max(updated).alias("at"))
    j = jobs.agg(F.count_if(F.col("state") == "running").alias("active"), F.count_if(F.col("state") == "pending").alias("pending"), F.count("*").alias("total"))
    one = i.crossJoin(F.broadcast(j))  # one row each
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    exists, stale = F.col("file_count") > 0, F.coalesce(age > STALE_SECONDS * 1_000_000, F.lit(False))
    issues = F.array_compact(F.array(F.when(~exists, "Symbol index not found").when(stale, "Index may be stale (>24h old)"), F.lit(None if receipts else "Receipt store not found").cast("string")))
    status = F.when(~exists, "degraded").when(stale | F.lit(not receipts), "warning").otherwise("healthy")
    return one.select(status.alias("status"), issues.alias("issues"), exists.alias("index_exists"), stale.alias("stale"), F.round(age / 3_600_000_000, 2).alias("age_hours"), "file_count", F.lit(cache).alias("cache_ok"), F.lit(receipts).alias("receipts_ok"), "active", "pending", "total")


CASE = "id string, task string, changed_files array<string>, expected_files array<string>, expected_symbols array<string>, hints array<string>"


def _items(v: Column, key: str, slashes: bool = False) -> Column:
    """Non-blank texts of a case's list; none if it isn't one."""
    raw = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    said = F.transform(raw, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    tidy = F.transform(said, lambda x: F.trim(F.replace(x, F.lit("\\"), F.lit("/"))) if slashes else x)
    return F.filter(tidy, lambda x: F.trim(x) != "")


def _cases(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.cases", "array<variant>"))
    checked = F.when(listed.isNull(), F.raise_error(F.lit("a suite must be an object with cases[] or a list of cases"))).otherwise(listed)
    return doc.select(F.posexplode(checked).alias("n", "c"))


def load_suite(spark: SparkSession, path: str, start: int = 1) -> DataFrame:
    """Cases of a benchmark suite (a JSON list, or an object with ``cases``): ``CASE``. A blank id is ``case_001`` by its place; a case without a task fails."""
    c = F.col("c")
    text = lambda k: F.trim(F.coalesce(F.try_variant_get(c, f"$.{k}", "string"), F.lit("")))
    name = F.when(text("id") == "", F.concat(F.lit("case_"), F.lpad((F.col("n") + start).cast("string"), 3, "0"))).otherwise(text("id"))
    task = F.when(text("task") == "", F.raise_error(F.concat(name, F.lit(": task is required"))).cast("string")).otherwise(text("task"))
    return _cases(spark, path).select(name.alias("id"), task.alias("task"), *[_items(c, k).alias(k) for k in ("changed_files", "expected_files", "expected_symbols", "hints")])


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON list: id, task, changed_files, hints, expected_top_files; those without id or task are left out."""
    c = F.col("c")
    text = lambda k: F.trim(F.coalesce(F.try_variant_get(c, f"$.{k}", "string"), F.lit(""))).alias(k)
    out = _cases(spark, path).select(text("id"), text("task"), _items(c, "changed_files", True).alias("changed_files"), F.transform(_items(c, "hints"), lambda x: F.trim(x)).alias("hints"), _items(c, "expected_top_files", True).alias("expected_top_files"))
    return out.where("id <> '' AND task <> ''")
