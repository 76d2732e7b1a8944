"""Jobs, command results, sessions, caches and change sets as tables: what is decided from their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of a failed executor in a command's error output, and reasons of its cancellation.
EXECUTOR_MARKS = ["process error:", "threadpool future error:", "threadpool timeout", "futures unfinished"]
EXECUTOR_REASONS = ["external_cancel", "stall_timeout"]
# Bounds of a session's time to live in seconds.
TTL_BOUNDS = (30, 86400)
DEFAULT_TTL = 1800
# What a session may be after its close.
FINAL_STATUSES = ["closed", "canceled", "failed", "succeeded"]
# Sources of a change set in their order, and the confidence in the whole set if they add to it.
CHANGE_CONFIDENCE = {"status": 0.98, "staged": 0.96, "worktree": 0.96, "head": 0.9, "upstream": 0.99}


def _any(column: Column, marks: list[str]) -> Column:
    return reduce(lambda a, m: a | F.contains(column, F.lit(m)), marks, F.lit(False))


def normalized_status(jobs: DataFrame) -> DataFrame:
    """jobs (state, completed, total, progress) with ``progress`` and ``consistency`` repaired.

    Progress follows the commands when it is off by more than half a percent. An open job with all commands
    done is ``finalizing`` and stays below 100; a cancelled one too; an ended one with all done has 100.
    """
    state, done, total = F.lower(F.trim("state")), F.greatest(F.lit(0), F.coalesce("completed", F.lit(0))), F.greatest(F.lit(0), F.coalesce("total", F.lit(0)))
    said, derived = F.coalesce("progress", F.lit(0.0)), done / F.nullif(total, F.lit(0)) * 100
    p = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when((total > 0) & (F.abs(said - derived) > 0.5), derived).otherwise(said)))
    whole = (total > 0) & (done >= total)
    finalizing, cancelled = state.isin("pending", "running", "cancelling") & whole, state == "cancelled"
    out = F.when(finalizing | cancelled, F.least(p, F.lit(99.9))).when(state.isin("completed", "failed") & whole, 100.0).otherwise(p)
    return jobs.withColumns({"progress": F.round(out, 2), "consistency": F.when(finalizing, "finalizing").when(cancelled, "cancelled").otherwise("normal")})


def executor_failed(marks: list[str] = EXECUTOR_MARKS) -> Column:
    """Whether a failed command's row (timed_out, cancelled, stalled, cancel_reason, stderr) is its executor's fault."""
    flags = F.coalesce("timed_out", F.lit(False)) | F.coalesce("cancelled", F.lit(False)) | F.coalesce("stalled", F.lit(False))
    return flags | F.coalesce(F.lower(F.trim("cancel_reason")).isin(EXECUTOR_REASONS), F.lit(False)) | F.coalesce(_any(F.lower("stderr"), marks), F.lit(False))


def classify_failures(results: DataFrame, job: str = "job", order: str = "place") -> DataFrame:
    """Per job: kind (none, executor, project, mixed), and the failed commands of each class, each once in order.

    results: job, place, command, exit_code and the columns of ``executor_failed``. Commands are reduced to one row
    each before their lists are made.
    """
    failed = results.where(F.coalesce("exit_code", F.lit(1)) != 0).withColumn("by_executor", executor_failed())
    once = failed.groupBy(job, "command", "by_executor").agg(F.min(order).alias("p"))
    mine = lambda ex: F.transform(F.array_sort(F.collect_list(F.when(F.col("by_executor") == F.lit(ex), F.struct("p", "command")))), lambda x: x["command"])
    per = once.groupBy(job).agg(mine(True).alias("executor_failed"), mine(False).alias("project_failed"))
    out = results.select(job).distinct().join(per, job, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"executor_failed": F.coalesce("executor_failed", none), "project_failed": F.coalesce("project_failed", none)})
    ex, pr = F.size("executor_failed") > 0, F.size("project_failed") > 0
    return out.withColumn("kind", F.when(ex & pr, "mixed").when(ex, "executor").when(pr, "project").otherwise("none"))


def usable_results(cache: DataFrame, keys: DataFrame, now: Column, ttl: int = 900, failed_ttl: int = 120, keep: int = 400, allow_failed: bool = False) -> DataFrame:
    """Cached command results for the keys: those not expired, among the newest ``keep``; failed ones only if allowed.

    cache: key, created, exit_code, timed_out; keys: key. A failed result lives ``failed_ttl`` seconds.
    """
    failed = (F.coalesce("exit_code", F.lit(0)) != 0) | F.coalesce("timed_out", F.lit(False))
    alive = cache.withColumn("failed", failed).where(F.unix_seconds("created") + F.when(F.col("failed"), failed_ttl).otherwise(ttl) > F.unix_seconds(now))
    newest = alive.orderBy(F.desc("created"), "key").limit(keep)
    return newest.where(F.lit(allow_failed) | ~F.col("failed")).join(keys.select("key").distinct(), "key", "left_semi")


def list_receipts(receipts: DataFrame, session: str | None = None, run: str | None = None, tool: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """Receipts that fit what is given, the newest first: at most 500. receipts: session_id, run_id, tool, status, ts, job_id."""
    for column, value in (("session_id", session), ("run_id", run), ("tool", tool), ("status", status)):
        receipts = receipts.where(F.col(column) == value) if value else receipts
    return receipts.orderBy(F.desc("ts"), F.desc("job_id")).limit(min(500, max(1, limit)))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table with the rows put in: of equal keys among them the last by ``order`` stays, instead of the table's."""
    last = rows.withColumn("up_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("up_rank = 1").drop("up_rank")
    return table.join(last.select(key), key, "left_anti").select(table.columns).unionByName(last.select(table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(table.columns)


def put_cache(cache: DataFrame, entries: DataFrame, now: Column, ttl: int, keep: int) -> DataFrame:
    """The cache (key, created, ...) after entries are put in: same keys are replaced, expired rows go, the newest ``keep`` stay."""
    merged = upsert(cache, entries, "key", "created")
    return merged.where(F.unix_seconds("created") + ttl > F.unix_seconds(now)).orderBy(F.desc("created"), F.desc("key")).limit(keep)


def get_cache(cache: DataFrame, queries: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Every query (key, task_signature, config_hash, fingerprint) with its exact entry or why there is none: key, hit, reason.

    The newest entry of the same task tells the reason: not_found, expired, config_mismatch, fingerprint_mismatch, key_mismatch.
    """
    newest = cache.groupBy("task_signature").agg(F.max(F.struct("created", "key", "config_hash", "fingerprint")).alias("n"))
    exact = cache.where(F.unix_seconds("created") + ttl > F.unix_seconds(now)).select("key", F.lit(True).alias("exact")).distinct()
    q = queries.join(exact, "key", "left").join(newest, "task_signature", "left")
    reason = F.when(F.col("exact"), "hit").when(F.col("n").isNull(), "not_found").when(F.unix_seconds("n.created") + ttl <= F.unix_seconds(now), "expired").when(F.col("n.config_hash") != F.col("config_hash"), "config_mismatch").when(F.col("n.fingerprint") != F.col("fingerprint"), "fingerprint_mismatch").otherwise("key_mismatch")
    return q.select("key", F.coalesce("exact", F.lit(False)).alias("hit"), reason.alias("reason"))


def replay_sessions(log: DataFrame) -> DataFrame:
    """Sessions after their log: status, run_id, owner, lease_owner, lease_id, lease_until (epoch seconds; null: none), ttl, errors.

    log: session_id, seq, at, op, run_id, actor, lease_id, ttl_seconds, readonly, final_status. A refused
    operation adds its code to errors; a session that never opened keeps its errors with a null status.

    * open needs a run_id (else E_INVALID_STATE) and the session's own, if there is one (else E_SESSION_CONFLICT);
      it gives the lease to the actor, whatever held it before, and sets the time to live (``TTL_BOUNDS``).
    * attach needs a session (else E_SESSION_NOT_FOUND), its run_id (else E_SESSION_CONFLICT) and a lease that
      hasn't run out (else status ``expired`` and E_SESSION_EXPIRED). Read-only, which is the default, changes
      nothing; otherwise a lease that another actor holds is kept from it (E_SESSION_CONFLICT), else it takes
      the lease for the session's time to live, status ``active``.
    * heartbeat needs a lease_id (else E_INVALID_STATE), the session's own (else E_SESSION_CONFLICT) and a lease
      that hasn't run out (as for attach); it prolongs the lease, status ``active``.
    * close takes the lease away; status is one of ``FINAL_STATUSES``, ``closed`` if none is given, else E_INVALID_STATE.

    Each session's log is folded in order in its own row: it must fit into a task.
    """
    low, high = TTL_BOUNDS
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    ttl = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce("ttl_seconds", F.lit(DEFAULT_TTL)))).cast("long")
    final = F.lower(clean("final_status"))
    final = F.when(final == "", "closed").when(final == "cancelled", "canceled").otherwise(final)
    actor = F.when(clean("actor") != "", clean("actor")).when(F.col("op") == "open", "codex").otherwise("policy")
    step = F.struct("seq", F.unix_seconds("at").alias("at"), "op", clean("run_id").alias("run_id"), actor.alias("actor"), clean("lease_id").alias("lease_id"), ttl.alias("ttl"), F.coalesce("readonly", F.lit(True)).alias("readonly"), final.alias("final"))
    logs = log.groupBy("session_id").agg(F.array_sort(F.collect_list(step)).alias("log"))
    none = F.lit(None).cast("string")
    names = {"status": none, "run_id": none, "owner": none, "lease_owner": F.lit(""), "lease_id": F.lit(""), "lease_until": F.lit(None).cast("long"), "ttl": F.lit(None).cast("long"), "errors": F.array().cast("array<string>")}
    start = F.struct(*[c.alias(n) for n, c in names.items()])

    def after(s: Column, x: Column) -> Column:
        to = lambda **new: F.struct(*[new.get(n, s[n]).alias(n) for n in names])
        refused = lambda code, **new: to(errors=F.array_append(s["errors"], F.lit(code)), **new)
        known, until = s["status"].isNotNull(), x["at"] + F.coalesce(s["ttl"], F.lit(DEFAULT_TTL))
        ran_out = s["lease_until"].isNotNull() & (s["lease_until"] <= x["at"])
        held = (s["lease_owner"] != "") & (s["lease_owner"] != x["actor"]) & (s["lease_id"] != "") & (s["lease_until"] > x["at"])
        opens, attaches, beats, closes = (x["op"] == o for o in ("open", "attach", "heartbeat", "close"))
        return (
            F.when((opens | attaches) & (x["run_id"] == ""), refused("E_INVALID_STATE"))
            .when(beats & (x["lease_id"] == ""), refused("E_INVALID_STATE"))
            .when(closes & ~x["final"].isin(FINAL_STATUSES), refused("E_INVALID_STATE"))
            .when(opens & known & (s["run_id"] != x["run_id"]), refused("E_SESSION_CONFLICT"))
            .when(opens, to(status=F.lit("open"), run_id=x["run_id"], owner=x["actor"], lease_owner=x["actor"], lease_id=x["lease_id"], lease_until=x["at"] + x["ttl"], ttl=x["ttl"]))
            .when((attaches | beats | closes) & ~known, refused("E_SESSION_NOT_FOUND"))
            .when(closes, to(status=x["final"], lease_owner=F.lit(""), lease_id=F.lit(""), lease_until=F.lit(None).cast("long")))
            .when(attaches & (s["run_id"] != x["run_id"]), refused("E_SESSION_CONFLICT"))
            .when(beats & (s["lease_id"] != x["lease_id"]), refused("E_SESSION_CONFLICT"))
            .when((attaches | beats) & ran_out, refused("E_SESSION_EXPIRED", status=F.lit("expired")))
            .when(attaches & x["readonly"], s)
            .when(attaches & F.coalesce(held, F.lit(False)), refused("E_SESSION_CONFLICT"))
            .when(attaches, to(status=F.lit("active"), lease_owner=x["actor"], lease_id=x["lease_id"], lease_until=until))
            .when(beats, to(status=F.lit("active"), lease_until=until))
            .otherwise(refused("E_INVALID_STATE"))
        )

    return logs.select("session_id", F.aggregate("log", start, after).alias("s")).select("session_id", "s.*")


def upsert_receipts(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A receipt log (job_id, seq, args_hash, status): the last row of each job, the jobs whose arguments changed (rejected), and status changes."""
    w = Window.partitionBy("job_id").orderBy("seq")
    first = log.withColumn("first_hash", F.first("args_hash").over(w))
    good = first.where(F.col("args_hash").eqNullSafe(F.col("first_hash"))).drop("first_hash")
    last = good.withColumn("rn", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where("rn = 1").drop("rn")
    bad = first.where(~F.col("args_hash").eqNullSafe(F.col("first_hash"))).select("job_id", "seq", F.lit("E_ARGS_MISMATCH").alias("error"))
    moves = good.withColumn("was", F.lag("status", 1, "none").over(w)).where("was <> status").select("job_id", "seq", "was", "status")
    return last, bad, moves


def selection_evidence(baseline: DataFrame, final: DataFrame) -> DataFrame:
    """Commands by layer: safety_baseline, and incremental_acceleration for those not in the baseline: layer, command, place. Both: command, place."""
    more = final.join(baseline.select("command"), "command", "left_anti")
    return baseline.select(F.lit("safety_baseline").alias("layer"), "command", "place").union(more.select(F.lit("incremental_acceleration"), "command", "place"))


def preflight(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Commands whose target file isn't there are skipped: command, missing (targets in order). targets: command, target; files: path."""
    gone = targets.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")
    return gone.groupBy("command").agg(F.array_sort(F.collect_set("target")).alias("missing"))


def ordered_union(parts: list[DataFrame], key: str, names: list[str], limit: int | None = None) -> DataFrame:
    """Rows of several sources one after the other, each key by the first that has it: key, source, place. parts: key, place."""
    rows = reduce(DataFrame.unionByName, [p.select(key, "place", F.lit(i).alias("ord")) for i, p in enumerate(parts)])
    first = rows.groupBy(key).agg(F.min(F.struct("ord", "place")).alias("f"))
    out = first.select(key, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f.ord") + 1).alias("source"), F.col("f.place").alias("place"), F.col("f.ord").alias("ord"))
    out = out.orderBy("ord", "place", key)
    return (out.limit(limit) if limit else out).drop("ord")


def change_set(parts: dict[str, DataFrame], limit: int = 200) -> DataFrame:
    """Changed paths of the sources of ``CHANGE_CONFIDENCE`` that are given, in its order: path, source, place, confidence.

    A path counts for the first source that has it. All rows have one confidence, the highest of the sources that add a path.
    """
    names = [n for n in CHANGE_CONFIDENCE if n in parts]
    conf = F.create_map(*[F.lit(x) for kv in CHANGE_CONFIDENCE.items() for x in kv])
    out = ordered_union([parts[n] for n in names], "path", names, limit)
    return out.withColumn("confidence", F.max(conf[F.col("source")]).over(Window.partitionBy()))  # ``limit`` rows


def status_path(line: str | Column) -> Column:
    """The path of a line of a version control's status: behind its two marks, of a rename the new name; empty without one."""
    c = F.rtrim(F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit("")))
    rest = F.trim(F.substring(c, 4, 1 << 30))
    renamed = F.trim(F.substring(rest, F.lit(1) + F.locate(" -> ", rest) + 3, F.lit(1 << 30)))
    return F.replace(F.when(F.char_length(c) < 4, "").when(F.contains(rest, F.lit(" -> ")), renamed).otherwise(rest), F.lit("\\"), F.lit("/"))


def missing_python_modules(results: DataFrame) -> DataFrame:
    """Modules that commands' error texts say aren't there: module, results (how many say so), in order. results: stderr."""
    found = F.regexp_extract_all("stderr", F.lit(r"""ModuleNotFoundError:\s+No module named ['"]([^'"]+)['"]"""), F.lit(1))
    rows = results.select(F.explode(F.array_distinct(F.transform(found, lambda m: F.trim(m)))).alias("module")).where("module <> ''")
    return rows.groupBy("module").agg(F.count("*").alias("results")).orderBy("module")


def change_fallback(manifest: DataFrame, recent: DataFrame, tokens: list[str], limit: int = 24) -> DataFrame:
    """Likely changes without version control: path, place, source and one confidence for all rows.

    Recently changed paths that the manifest has, in the order they came, each once (0.92); else the paths with
    most of the tokens (task and hints), the confidence by the best path's share of them; else the manifest's
    first eight (0.2). manifest: path; recent: path, place. The first step that finds anything is taken.
    """
    limit, tokens = max(1, limit), list(dict.fromkeys(tokens))
    first = recent.groupBy("path").agg(F.min("place").alias("place")).join(manifest.select("path"), "path", "left_semi")
    a = first.orderBy("place", "path").limit(limit).select("path", F.col("place").cast("long").alias("place"), F.lit("manifest_recent").alias("source"), F.lit(0.92).alias("confidence"), F.lit(0).alias("step"))
    hits = reduce(lambda x, t: x + F.contains(F.lower("path"), F.lit(t)).cast("int"), tokens, F.lit(0))
    scored = manifest.select("path", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "path").limit(limit)
    best = F.max("hits").over(Window.partitionBy())  # at most ``limit`` rows
    b = scored.select("path", (-F.col("hits")).cast("long"), F.lit("planner_fallback"), F.greatest(F.lit(0.35), F.least(F.lit(0.88), 0.35 + 0.5 * best / max(1, len(tokens)))), F.lit(1))
    c = manifest.orderBy("path").limit(min(8, limit)).select("path", F.lit(0).cast("long"), F.lit("index_head_fallback"), F.lit(0.2), F.lit(2))
    every = a.union(b).union(c)
    w = Window.orderBy("place", "path")
    return every.withColumn("first", F.min("step").over(Window.partitionBy())).where("step = first").select("path", F.row_number().over(w).alias("place"), "source", "confidence")  # at most 2 x limit + 8 rows


def changed_state(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Changed paths as (path, exists, size, mtime), and one fingerprint over them in order of path. changed: path; files: path, size, mtime."""
    j = changed.select("path").distinct().join(files, "path", "left").select("path", F.col("size").isNotNull().alias("exists"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime", F.lit(0)).alias("mtime"))
    return j.withColumn("row_hash", F.sha2(F.to_json(F.struct("path", "exists", "size", "mtime")), 256))


def fingerprint_of(rows: DataFrame, hash_col: str = "row_hash") -> DataFrame:
    """One fingerprint of a set of rows that doesn't depend on their order and needs no list of them: n, fingerprint.

    Halves of the rows' hashes are combined by exclusive or, so it is the same on any number of partitions. It is not
    the hash of the sorted list of rows, which one task would have to hold.
    """
    half = lambda a: F.expr(f"bit_xor(cast(conv(substring({hash_col}, {a}, 15), 16, 10) as bigint))")
    return rows.agg(F.count("*").alias("n"), half(1).alias("x"), half(16).alias("y")).select("n", F.sha2(F.concat_ws(",", "n", "x", "y"), 256).alias("fingerprint"))


def verify_groups(changed: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Verification groups of changed paths by their ending: group. changed: path."""
    ending = F.regexp_extract(F.lower(F.trim("path")), r"(\.[^./]+)$", 1)
    return changed.select(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[ending].alias("group")).where("`group` is not null").distinct()


def workspaces(files: DataFrame, markers: list[str], max_depth: int = 4, skip: list[str] = ("node_modules", "dist", "build", ".venv", "venv", "__pycache__")) -> DataFrame:
    """Folders that hold a marker file, the root first, then by depth and name: rel, depth. files: path."""
    parts = F.split("path", "/")
    f = files.select(F.slice(parts, 1, F.size(parts) - 1).alias("dirs"), F.element_at(parts, -1).alias("name"))
    f = f.where(F.col("name").isin(markers) & ~F.arrays_overlap("dirs", F.array(*[F.lit(s) for s in skip])) & (F.size("dirs") <= max_depth))
    rel = F.when(F.size("dirs") == 0, ".").otherwise(F.array_join("dirs", "/"))
    return f.select(rel.alias("rel"), F.size("dirs").alias("depth")).distinct().orderBy("depth", "rel")


def route(changed: DataFrame, spaces: DataFrame) -> DataFrame:
    """The workspace of each change set: the one with most of its files below it, of equals the first by depth and name; without any, the root, else the first.

    changed: set_id, path; spaces: rel, depth. Paths meet workspaces on their own prefixes, so it is an equi-join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hit = changed.where(F.contains("path", F.lit("/"))).select("set_id", F.explode(prefixes).alias("rel")).join(spaces.where("rel <> '.'"), "rel").groupBy("set_id", "rel", "depth").agg(F.count("*").alias("n"))
    best = hit.groupBy("set_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "depth", "rel")).alias("b"))
    default = spaces.agg(F.coalesce(F.max(F.when(F.col("rel") == ".", ".")), F.min(F.struct("depth", "rel"))["rel"]).alias("default"))
    return changed.select("set_id").distinct().join(best, "set_id", "left").crossJoin(F.broadcast(default)).select("set_id", F.coalesce("b.rel", "default").alias("rel"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("files"))  # one row


def command_parts(command: str = "command") -> dict[str, Column]:
    """What a shell command runs: its last ``&&`` part, working folder, module (``-m``), npm script and test targets."""
    last = F.trim(F.element_at(F.split(command, "&&"), -1))
    words = F.filter(F.split(last, r"\s+"), lambda w: F.regexp_like(w, F.lit(r"(\.py(::.*)?|/)$|\.py::")))
    pick = lambda c, rx, n=1: F.nullif(F.regexp_extract(c, rx, n), F.lit(""))
    return {"last": last, "folder": pick(F.col(command), r"""(?:^|&&)\s*cd\s+["']?([^"'&\s]+)"""), "module": pick(last, r"\s-m\s+([A-Za-z0-9_.]+)"), "script": pick(last, r"npm\s+(?:run\s+)?([A-Za-z0-9:_-]+)"), "targets": F.transform(words, lambda w: F.split_part(w, F.lit("::"), F.lit(1)))}


def pytest_command(targets: Column, prefix: str = "python -m pytest -q") -> Column:
    """One command for a list of test files; those with a blank are quoted."""
    return F.concat_ws(" ", F.lit(prefix), F.array_join(F.transform(targets, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " "))


def verify_preset(preset: Column, evidence_run: Column, fast_loop: Column) -> Column:
    """fast or full by the preset; else full for an evidence run, fast for a fast loop, default without either."""
    p = F.lower(F.trim(F.coalesce(preset, F.lit(""))))
    return F.when(p.isin("fast", "full"), p).when(F.coalesce(evidence_run, F.lit(False)), "full").when(F.coalesce(fast_loop, F.lit(False)), "fast").otherwise("default")


def coerced(raw: str | Column) -> dict[str, Column]:
    """A text parameter read as boolean, whole number, number and list (of commas or JSON); null where it isn't one."""
    c = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    low = F.lower(c)
    boolean = F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False)
    items = F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return {"boolean": boolean, "integer": c.try_cast("bigint"), "number": c.try_cast("double"), "items": F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))}


def bench_summary(runs: DataFrame) -> DataFrame:
    """Means, medians and pass rate of benchmark runs: seconds, context_tokens, full_tokens, expected, top (arrays), passed.

    Recall is the share of a run's expected files among its top ones, null without any expected.
    """
    recall = F.when(F.size("expected") > 0, F.size(F.array_intersect("expected", "top")) / F.size(F.array_distinct("expected")))
    r = runs.withColumns({"recall": recall, "reduction": F.when(F.col("full_tokens") > 0, F.least(F.lit(1.0), 1 - F.col("context_tokens") / F.col("full_tokens")))})
    return r.agg(F.count("*").alias("runs"), F.avg("seconds").alias("seconds_avg"), F.median("seconds").alias("seconds_p50"), F.avg("context_tokens").alias("tokens_avg"), F.avg("reduction").alias("reduction_avg"), F.avg("recall").alias("recall_avg"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def symbol_hit_rate(expected: DataFrame, snippets: DataFrame) -> DataFrame:
    """Share of a case's expected symbols that a snippet's symbol or signature equals, in any case: case_id, rate. expected: case_id, symbol; snippets: case_id, symbol, signature."""
    seen = snippets.select("case_id", F.explode(F.array_compact(F.array("symbol", "signature"))).alias("s")).select("case_id", F.lower(F.trim("s")).alias("s")).where("s <> ''").distinct()
    want = expected.select("case_id", F.lower(F.trim("symbol")).alias("s")).where("s <> ''").distinct()
    hit = want.join(seen.withColumn("hit", F.lit(1)), ["case_id", "s"], "left")
    return hit.groupBy("case_id").agg((F.count("hit") / F.count("*")).alias("rate"))


def event_counts(events: DataFrame, job: str = "job") -> DataFrame:
    """Per job: counts by event, first seq, the last seen seq (by arrival), and the latest progress event: events: job, seq, arrived, event, stage."""
    by = events.groupBy(job, "event").agg(F.count("*").alias("n"))
    counts = by.groupBy(job).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("counts"))
    span = events.groupBy(job).agg(F.min("seq").alias("first_seq"), F.max_by("seq", "arrived").alias("last_seq"), F.max(F.when(F.col("event").contains("progress"), F.col("seq"))).alias("progress_seq"), F.max_by("stage", "seq").alias("stage"))
    return counts.join(span, job)


def source_size(files: DataFrame, sample: int = 200) -> DataFrame:
    """Files of an index and their bytes: files, bytes; and the estimate from the first ``sample`` of them, as a plan needs it before all are read."""
    total = files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    head = files.orderBy("path").limit(sample).agg(F.avg("size").alias("mean"))
    return total.crossJoin(F.broadcast(head)).select("files", "bytes", F.round(F.col("mean") * F.col("files")).cast("long").alias("estimate"))  # one row each


def changed_chars(changed: DataFrame, texts: DataFrame, max_files: int = 200, max_chars: int = 2_000_000) -> DataFrame:
    """Characters of the first ``max_files`` changed files, each once, at most ``max_chars``: chars. changed: path, place; texts: path, text."""
    head = changed.groupBy("path").agg(F.min("place").alias("place")).orderBy("place", "path").limit(max_files)
    return texts.join(F.broadcast(head), "path").agg(F.least(F.lit(max_chars), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).cast("long").alias("chars"))


def near_misses(ranked: DataFrame, n: int, more: int = 5) -> DataFrame:
    """The first n of each task and the next ones with their distance to the last one taken: task_id, path, score, rank, selected, gap.

    ranked: task_id, path, score. Only n + more rows of a task are kept.
    """
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "path")
    head = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n + more)
    least = F.min(F.when(F.col("rank") <= n, F.col("score"))).over(Window.partitionBy("task_id"))
    return head.withColumns({"selected": F.col("rank") <= n, "gap": F.when(F.col("rank") > n, F.round(least - F.col("score"), 6))})
