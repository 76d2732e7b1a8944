"""State stores and event logs: merge-on-read, pruning, caches, leases, receipts, summaries and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import jaccard


def merge_on_read(base: DataFrame, ops: DataFrame, key: str, seq: str, op: str = "op") -> DataFrame:
    """base with the op log applied: the last op per key wins; ``set`` replaces the key's whole group,
    ``delete`` removes it. ops: the base's columns, op and seq; all rows of one ``set`` share its seq.
    """
    last = ops.withColumn("last", F.max(seq).over(Window.partitionBy(key))).where(F.col(seq) == F.col("last"))
    untouched = base.join(ops.select(key).distinct(), key, "left_anti")
    return untouched.select(base.columns).unionByName(last.where(F.col(op) == "set").select(base.columns))


def needs_compaction(pending: int, every: int = 200) -> bool:
    return pending >= every


def diff_state(before: DataFrame, now: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """added, changed, removed or same for every key, by the compared columns."""
    b, n = before.alias("b"), now.alias("n")
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"b.{c}").eqNullSafe(F.col(f"n.{c}"))
    state = F.when(F.col(f"n.{compare[0]}").isNull() & F.col("n.here").isNull(), "removed").when(F.col("b.here").isNull(), "added").when(differs, "changed").otherwise("same")
    return b.withColumn("here", F.lit(1)).alias("b").join(n.withColumn("here", F.lit(1)).alias("n"), key, "full").select(key, state.alias("state"))


def prune(rows: DataFrame, created: str, key: str, ttl_seconds: int, now: Column, keep: int) -> DataFrame:
    """Rows that haven't expired, the newest ``keep`` of them."""
    return rows.where(F.unix_seconds(F.col(created)) + ttl_seconds > F.unix_seconds(now)).orderBy(F.desc(created), F.desc(key)).limit(keep)


def similar_entry(queries: DataFrame, cache: DataFrame, threshold: float = 0.86, candidates: int = 80) -> DataFrame:
    """Best cache entry for each query among the newest ``candidates``: query, entry, score, hit.

    queries: query, q_tokens, q_changed; cache: entry, created, tokens, changed (arrays). Token sets count
    .7 and changed files .3; without changed files on both sides .9 and a flat .1. The newest of equals wins. Hint
    tokens (q_hints, hints), where both sides have them, count as tokens.
    """
    newest = cache.orderBy(F.desc("created"), F.desc("entry")).limit(candidates)
    both = queries.crossJoin(F.broadcast(newest))  # at most ``candidates`` rows
    hinted = "q_hints" in queries.columns and "hints" in cache.columns
    task = jaccard(F.array_union("q_tokens", "q_hints"), F.array_union("tokens", "hints"), 1.0) if hinted else jaccard("q_tokens", "tokens", 1.0)
    blank = (F.size("q_changed") == 0) & (F.size("changed") == 0)
    score = F.when(blank, 0.9 * task + 0.1).otherwise(0.7 * task + 0.3 * jaccard("q_changed", "changed", 1.0))
    best = both.withColumn("score", F.round(score, 9)).groupBy("query").agg(F.max(F.struct("score", "created", "entry")).alias("b"))
    return best.select("query", F.col("b.entry").alias("entry"), F.col("b.score").alias("score"), (F.col("b.score") >= threshold).alias("hit"))


def recover_leases(receipts: DataFrame, sessions: DataFrame, open_states: list[str], now: Column, ended: str = "failed") -> DataFrame:
    """Open receipts of sessions whose lease has run out, with their new status."""
    hit = receipts.where(F.col("status").isin(open_states)).join(sessions.where(F.col("lease_until") < now), "session_id")
    return hit.withColumns({"old_status": F.col("status"), "status": F.lit(ended)})


# States of receipts that are recovered, and what is said of them.
OPEN_RECEIPTS = ["queued", "running"]
EXPIRED_CODE, EXPIRED_MESSAGE = "E_SESSION_EXPIRED", "session lease expired while receipt remained running"


def recover_expired(receipts: DataFrame, sessions: DataFrame, now: Column, ended: str = "failed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receipts, sessions and new events after open receipts of run-out sessions have been ended.

    receipts: job_id, session_id, status, ts, error_code, error_message and more; sessions: session_id, status, lease_until
    (null: no lease), updated_at and more. Only sessions with such a receipt become ``expired``. events: job_id,
    session_id, from_status, to_status, ts, error_code, error_message.
    """
    if ended not in ("failed", "canceled"):
        raise ValueError("ended must be failed or canceled")
    out = sessions.where(F.col("lease_until") < now).select("session_id").distinct().withColumn("_out", F.lit(True))
    r = receipts.join(out, "session_id", "left").withColumn("_hit", F.coalesce("_out", F.lit(False)) & F.col("status").isin(OPEN_RECEIPTS))
    new = {"status": F.lit(ended), "ts": now, "error_code": F.lit(EXPIRED_CODE), "error_message": F.lit(EXPIRED_MESSAGE)}
    after = r.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in receipts.columns])
    hit = r.where("_hit")
    events = hit.select("job_id", "session_id", F.col("status").alias("from_status"), F.lit(ended).alias("to_status"), now.alias("ts"), F.lit(EXPIRED_CODE).alias("error_code"), F.lit(EXPIRED_MESSAGE).alias("error_message"))
    s = sessions.join(hit.select("session_id").distinct().withColumn("_hit", F.lit(True)), "session_id", "left")
    changed = {"status": F.lit("expired"), "updated_at": now}
    return after, s.select(*[F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in sessions.columns]), events


def transitions(log: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Rows whose status differs from the one before (``none`` at first), with that one as ``was``."""
    was = F.lag(status, 1, "none").over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("was", was).where(F.col("was") != F.col(status))


def tail(log: DataFrame, job: str, seq: str, since: int, n: int) -> DataFrame:
    """The last n events of each job after ``since``."""
    rn = F.row_number().over(Window.partitionBy(job).orderBy(F.desc(seq)))
    return log.where(F.col(seq) > since).withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")


def until_first(log: DataFrame, job: str, order: list[str], stop: Column) -> DataFrame:
    """Rows up to and including the first that stops the job, by column ``ran``; the others are skipped."""
    w = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("ran", F.coalesce(F.sum(stop.cast("int")).over(w), F.lit(0)) == 0)


def within_budget(log: DataFrame, job: str, order: list[str], spent: str, limit: float) -> DataFrame:
    """Column ``remaining`` before each row and ``finished``: whether at least 1 of it was left."""
    w = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("remaining", limit - F.coalesce(F.sum(spent).over(w), F.lit(0))).withColumn("finished", F.col("remaining") >= 1)


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: key columns, rule. A rule whose condition is null is broken."""
    marks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(marks).alias("rule"))


def repaired(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with nulls of the named columns replaced, and the number of repairs."""
    n = sum((F.col(c).isNull().cast("int") for c in defaults), F.lit(0))
    return rows.withColumn("repairs", n).withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})


def stable_hash(*columns: str | Column) -> Column:
    """SHA-256 of the columns as one JSON document."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def status_of(raw: Column) -> Column:
    """Receipt status in its canonical form; what isn't known is ``failed``."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin("success", "ok", "completed", "succeeded"), "succeeded").when(s.isin("cancelled", "cancelling", "canceled"), "canceled").when(s.isin("queued", "running", "partial", "degraded"), s).otherwise("failed")


def fold_status(partial: Column, failed: Column, degraded: Column) -> Column:
    """Status of a run by what any of its commands was (aggregates over the run)."""
    return F.when(F.bool_or(partial), "partial").when(F.bool_or(failed), "failed").when(F.bool_or(degraded), "degraded").otherwise("success")
