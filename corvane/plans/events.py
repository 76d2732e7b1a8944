"""State, cache, receipt and event-log queries over the driver's tables.

Events are a job log (user_id is the job, event_id its sequence); orders are receipts, customers
sessions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import jobs, state
from corvane.plans.snippets import _IDS, STOPS
from corvane.session import table

NOW = "2024-01-31 00:00:00"
TYPES = ["click", "error", "purchase", "signup", "view"]


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def delta_merge(spark, d):
    """Users' events of the first half are the base; later ones are ops: an error deletes the user, others set it to the event."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    base = e.where(F.col("ts") < half).select("user_id", "event_id")
    ops = e.where(F.col("ts") >= half).select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.col("event_id").alias("seq"))
    return state.merge_on_read(base, ops, "user_id", "seq")


def ttl_prune(spark, d):
    return state.prune(_events(spark, d), "ts", "event_id", 7 * 86400, F.lit(NOW).cast("timestamp"), 400).select("event_id", "user_id")


def cache_similarity(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("query"), T.task_tokens("text").alias("q_tokens"), F.array().cast("array<string>").alias("q_changed"))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.col("doc_id").alias("created"), T.task_tokens("text").alias("tokens"), F.array().cast("array<string>").alias("changed"))
    return state.similar_entry(q, c).select("query", "entry", F.round("score", 6).alias("score"), "hit")


def cache_hybrid(spark, d):
    """The same with hint tokens and changed files on both sides."""
    changed = lambda c: F.array(F.concat(F.lit("f"), c % 5), F.lit("g"))
    q = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("query"), T.task_tokens("text").alias("q_tokens"), F.array(F.lit("license"), F.lit("thread")).alias("q_hints"), changed(F.col("turn")).alias("q_changed"))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.col("doc_id").alias("created"), T.task_tokens("text").alias("tokens"), F.array(F.lower("source"), F.lit("thread")).alias("hints"), changed(F.col("n_chars")).alias("changed"))
    return state.similar_entry(q, c, 0.3).select("query", "entry", F.round("score", 6).alias("score"), "hit")


def cache_miss_reason(spark, d):
    """Why each customer's look-up (a user's newest event is the entry) misses."""
    newest = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    old = F.col("n.ts") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    reason = F.when(F.col("n").isNull(), "not_found").when(old, "expired").when(F.col("n.event_type") == "error", "config_mismatch").when(F.col("n.value") < 10, "fingerprint_mismatch").otherwise("hit")
    return c.join(newest, "key", "left").select("key", reason.alias("reason"))


def lease_recovery(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.expr("timestampadd(DAY, cast(c_nationkey * 60 as int), timestamp_ntz'1998-01-01 00:00:00')").alias("lease_until"))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    return state.recover_leases(r, s, ["O", "P"], F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")).select("session_id", "job_id", "old_status", "status")


def receipt_transitions(spark, d):
    o = table(spark, d, "orders")
    return state.transitions(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "was", F.col("o_orderstatus").alias("now"))


def receipt_list(spark, d):
    o = table(spark, d, "orders").select(F.lit("s").alias("session_id"), F.lit("r").alias("run_id"), F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("job_id"), "o_custkey")
    return jobs.list_receipts(o, tool="2-HIGH", status="F", limit=50).select(F.col("job_id").alias("o_orderkey"), "o_custkey")


def event_summary(spark, d):
    e = table(spark, d, "events")
    last = F.max_by("event_type", "event_id")
    return e.groupBy("user_id").agg(
        F.count("*").alias("events"),
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES],
        F.min("event_id").alias("first_seq"),
        F.max("event_id").alias("last_seq"),
        last.alias("last_event"),
        F.max_by(F.when(F.col("event_type") == "error", F.col("value")), F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error_value"),
    )


def event_tail(spark, d):
    return state.tail(table(spark, d, "events"), "user_id", "event_id", 1000, 30).select("user_id", "event_id", "event_type")


def stall_gaps(spark, d):
    e = table(spark, d, "events")
    was = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.expr("timestampdiff(SECOND, was, ts)")
    return e.withColumn("was", was).withColumn("gap", gap).where("gap >= 86400").select("user_id", "event_id", "gap")


def eta_progress(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type").isin("purchase", "view")).alias("completed"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("elapsed"))
    return e.select("user_id", "total", "completed", F.when(F.col("completed") > 0, F.round(F.col("elapsed") / F.col("completed") * (F.col("total") - F.col("completed")), 3)).alias("eta"))


def failure_kinds(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    failed = F.col("event_type") == "error"
    ex, pr = failed & (F.col("value") > 100), failed & (F.col("value") <= 100)
    kind = F.when(F.bool_or(ex) & F.bool_or(pr), "mixed").when(F.bool_or(ex), "executor").when(F.bool_or(pr), "project").otherwise("none")
    return e.agg(kind.alias("kind"), state.fold_status(F.col("value") > 300, failed, F.col("event_type") == "signup").alias("status"), F.count_if(failed).alias("failures"))


def fail_fast_prefix(spark, d):
    return state.until_first(table(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") == "error").select("user_id", "event_id", "ran")


def wall_time_budget(spark, d):
    e = table(spark, d, "events").withColumn("ms", F.round(F.col("value") * 1000).cast("long"))
    return state.within_budget(e, "user_id", ["event_id"], "ms", 500_000).select("user_id", "event_id", F.col("remaining").cast("long").alias("remaining"), "finished")


def status_tail(spark, d):
    t = state.tail(table(spark, d, "events"), "user_id", "event_id", -1, 40)
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.coalesce(F.bool_or(F.col("value") > 300), F.lit(False)).alias("stalled"), F.max("value").alias("max_value"), F.concat_ws(",", F.expr("slice(array_sort(collect_list(CASE WHEN event_type = 'view' THEN event_id END)), greatest(1, count_if(event_type = 'view') - 4), 5)").cast("array<string>")).alias("last_views"))


def health_status(spark, d):
    e = table(spark, d, "events").agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("ts").alias("newest"))
    docs = table(spark, d, "documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    one = e.crossJoin(docs)  # one row each
    status = F.when(F.col("files") == 0, "degraded").when((F.expr("timestampdiff(SECOND, newest, timestamp_ntz'2024-02-02 00:00:00')") > 86400) | (F.col("failed") * 2 > F.col("jobs")), "warning").otherwise("healthy")
    return one.select("jobs", "failed", "files", "chars", status.alias("status"))


def contract_violations(spark, d):
    e = table(spark, d, "events")
    rules = {"value.minimum": F.col("value") >= 1, "event_type.enum": F.col("event_type").isin("click", "purchase", "view", "signup"), "props.required": F.get_json_object("props", "$.k").isNotNull(), "props.k.minimum": F.get_json_object("props", "$.k").cast("int") >= 5, "ts.required": F.col("ts").isNotNull()}
    return state.violations(e, ["event_id"], rules)


def fingerprints(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 256).alias("fingerprint"), state.status_of(F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "Running ").otherwise("odd")).alias("status"))


QUERIES = {f.__name__: f for f in (delta_merge, ttl_prune, cache_similarity, cache_hybrid, cache_miss_reason, lease_recovery, receipt_transitions, receipt_list, event_summary, event_tail, stall_gaps, eta_progress, failure_kinds, fail_fast_prefix, wall_time_budget, status_tail, health_status, contract_violations, fingerprints)}
_TOK = lambda x: f"(SELECT list(t ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest(z) AS t, generate_subscripts(z, 1) AS p FROM (SELECT {_IDS.format(x)} AS z)) WHERE NOT list_contains({STOPS}, t) GROUP BY t ORDER BY min(p)))"
ORACLE = {
    "delta_merge": "WITH o AS (SELECT user_id, event_id, event_type, max(event_id) OVER (PARTITION BY user_id) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-16') SELECT user_id, event_id FROM events WHERE ts < TIMESTAMP '2024-01-16' AND user_id NOT IN (SELECT user_id FROM o) UNION ALL SELECT user_id, event_id FROM o WHERE event_id = m AND event_type <> 'error'",
    "ttl_prune": "SELECT event_id, user_id FROM events WHERE floor(epoch(ts)) + 604800 > epoch(TIMESTAMP '2024-01-31') ORDER BY ts DESC, event_id DESC LIMIT 400",
    "cache_similarity": f"""WITH q AS (SELECT conv_id || '/' || turn AS query, coalesce({_TOK('conversations.text')}, []) AS a FROM conversations WHERE role = 'user'), c AS (SELECT doc_id AS entry, coalesce({_TOK('d.text')}, []) AS b FROM (SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 80) d),
        s AS (SELECT query, entry, round(0.9 * CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END + 0.1, 9) AS score FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry DESC) AS rn FROM s)
        SELECT query, entry, round(score, 6)::DOUBLE AS score, score >= 0.86 AS hit FROM r WHERE rn = 1""",
    "cache_hybrid": f"""WITH q AS (SELECT conv_id || '/' || turn AS query, list_distinct(list_concat(coalesce({_TOK('conversations.text')}, []), ['license', 'thread'])) AS a, turn % 5 AS x FROM conversations WHERE role = 'user'), c AS (SELECT doc_id AS entry, list_distinct(list_concat(coalesce({_TOK('d.text')}, []), [lower(source), 'thread'])) AS b, n_chars % 5 AS y FROM (SELECT doc_id, text, source, n_chars FROM documents ORDER BY doc_id DESC LIMIT 80) d),
        s AS (SELECT query, entry, round(0.7::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) + 0.3::DOUBLE * CASE WHEN x = y THEN 1 ELSE 1 / 3.0::DOUBLE END, 9) AS score FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry DESC) AS rn FROM s)
        SELECT query, entry, round(score, 6)::DOUBLE AS score, score >= 0.3 AS hit FROM r WHERE rn = 1""",
    "cache_miss_reason": "WITH n AS (SELECT user_id AS key, arg_max({'ts': ts, 'event_type': event_type, 'value': value}, (ts, event_id)) AS n FROM events GROUP BY user_id) SELECT c_custkey AS key, CASE WHEN n IS NULL THEN 'not_found' WHEN n.ts < TIMESTAMP '2024-01-30' THEN 'expired' WHEN n.event_type = 'error' THEN 'config_mismatch' WHEN n.value < 10 THEN 'fingerprint_mismatch' ELSE 'hit' END AS reason FROM customer LEFT JOIN n ON key = c_custkey",
    "lease_recovery": "SELECT o_custkey AS session_id, o_orderkey AS job_id, o_orderstatus AS old_status, 'failed' AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P') AND TIMESTAMP '1998-01-01' + to_days(c_nationkey * 60) < TIMESTAMP '1999-06-01'",
    "receipt_transitions": "SELECT o_custkey, o_orderkey, was, o_orderstatus AS now FROM (SELECT *, lag(o_orderstatus, 1, 'none') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) WHERE was <> o_orderstatus",
    "receipt_list": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "event_summary": "SELECT user_id, count(*) AS events, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in TYPES) + ", min(event_id) AS first_seq, max(event_id) AS last_seq, arg_max(event_type, event_id) AS last_event, arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS last_error_value FROM events GROUP BY user_id",
    "event_tail": "SELECT user_id, event_id, event_type FROM events WHERE event_id > 1000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30",
    "stall_gaps": "SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS gap FROM events) WHERE gap >= 86400",
    "eta_progress": "WITH e AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS completed, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS elapsed FROM events GROUP BY user_id) SELECT user_id, total, completed, CASE WHEN completed > 0 THEN round(elapsed::DOUBLE / completed * (total - completed), 3) END AS eta FROM e",
    "failure_kinds": "SELECT user_id, ts::DATE AS day, CASE WHEN bool_or(event_type = 'error' AND value > 100) AND bool_or(event_type = 'error' AND value <= 100) THEN 'mixed' WHEN bool_or(event_type = 'error' AND value > 100) THEN 'executor' WHEN bool_or(event_type = 'error' AND value <= 100) THEN 'project' ELSE 'none' END AS kind, CASE WHEN bool_or(value > 300) THEN 'partial' WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'signup') THEN 'degraded' ELSE 'success' END AS status, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY ALL",
    "fail_fast_prefix": "SELECT user_id, event_id, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM events",
    "wall_time_budget": "WITH r AS (SELECT user_id, event_id, (500000 - coalesce(sum(round(value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remaining FROM events) SELECT *, remaining >= 1 AS finished FROM r",
    "status_tail": "WITH t AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 40) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, bool_or(value > 300) AS stalled, max(value) AS max_value, coalesce(array_to_string((list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'view'))[-5:], ','), '') AS last_views FROM t GROUP BY user_id",
    "health_status": "SELECT jobs, failed, files, chars, CASE WHEN files = 0 THEN 'degraded' WHEN epoch(TIMESTAMP '2024-02-02') - epoch(newest) > 86400 OR failed * 2 > jobs THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT count(*) AS jobs, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) AS newest FROM events), (SELECT count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents)",
    "contract_violations": "WITH k AS (SELECT *, (props::JSON ->> '$.k')::INT AS k FROM events) SELECT event_id, 'value.minimum' AS rule FROM k WHERE NOT coalesce(value >= 1, false) UNION ALL SELECT event_id, 'event_type.enum' FROM k WHERE event_type = 'error' UNION ALL SELECT event_id, 'props.required' FROM k WHERE k IS NULL UNION ALL SELECT event_id, 'props.k.minimum' FROM k WHERE NOT coalesce(k >= 5, false) UNION ALL SELECT event_id, 'ts.required' FROM k WHERE ts IS NULL",
    "fingerprints": "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS fingerprint, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'failed' END AS status FROM orders",
}
