"""Job, result, session, cache and change-set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import jobs
from corvane.session import table

NOW = "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def job_status(spark, d):
    """Every user is a job with its events as commands; its state is its last event's type."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("last"), F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("completed"), F.round(F.avg("value"), 3).alias("progress"))
    state = F.create_map(*[F.lit(x) for kv in {"click": "running", "error": "cancelled", "purchase": "completed", "signup": "pending", "view": "failed"}.items() for x in kv])
    return jobs.normalized_status(e.withColumn("state", state[F.col("last")])).select("job", "state", "progress", "consistency")


def _results(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("place"), F.concat_ws(" ", "event_type", F.floor(F.col("value") / 50).cast("string")).alias("command"), F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("exit_code"), (F.col("value") > 200).alias("timed_out"), F.lit(None).cast("boolean").alias("cancelled"), F.lit(False).alias("stalled"), F.when(F.col("event_type") == "view", "none").alias("cancel_reason"), F.when(F.col("value") < 5, "Threadpool TIMEOUT after 5 s").alias("stderr"))


def failure_commands(spark, d):
    out = jobs.classify_failures(_results(spark, d))
    return out.select("job", "kind", F.concat_ws(";", "executor_failed").alias("executor_failed"), F.concat_ws(";", "project_failed").alias("project_failed"))


def usable_results(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("created"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), F.lit(False).alias("timed_out"), "user_id").where(F.col("created") <= _now())
    keys = table(spark, d, "events").where("value > 20").select(F.col("event_id").alias("key"))
    return jobs.usable_results(e, keys, _now(), ttl=10 * 86400, failed_ttl=86400, keep=1000).select("key", "user_id")


def cache_put(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("created"), "event_id").where("created <= timestamp'2024-01-20 00:00:00'")
    old = e.where("created < timestamp'2024-01-10 00:00:00'")
    last = old.groupBy("key").agg(F.max(F.struct("created", "event_id")).alias("m")).select("key", "m.created", "m.event_id")
    return jobs.put_cache(last, e.where("created >= timestamp'2024-01-10 00:00:00'"), _now(), 12 * 86400, 500).select("key", "event_id")


def cache_get(spark, d):
    """Orders of a customer look for an entry of the same priority; entries are the orders of the last years."""
    o = table(spark, d, "orders").select(F.concat_ws("/", "o_custkey", "o_orderpriority", "o_orderstatus").alias("key"), F.concat_ws("/", "o_custkey", "o_orderpriority").alias("task_signature"), F.col("o_orderstatus").alias("config_hash"), F.year("o_orderdate").cast("string").alias("fingerprint"), F.col("o_orderdate").cast("timestamp").alias("created"), "o_orderkey")
    cache = o.where("created >= timestamp'1996-01-01 00:00:00'")
    q = o.where("created < timestamp'1996-01-01 00:00:00'").select("key", "task_signature", "config_hash", "fingerprint").distinct()
    return jobs.get_cache(cache, q, F.lit("1998-08-01 00:00:00").cast("timestamp"), 700 * 86400).groupBy("hit", "reason").agg(F.count("*").alias("n"))


def receipt_upserts(spark, d):
    """Orders of a customer are the log of one receipt; its priority stands for its arguments."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("args_hash"), F.col("o_orderstatus").alias("status"))
    last, bad, moves = jobs.upsert_receipts(o)
    return last.join(bad.groupBy("job_id").agg(F.count("*").alias("rejected")), "job_id", "left").join(moves.groupBy("job_id").agg(F.count("*").alias("moves")), "job_id", "left").select("job_id", "seq", "status", F.coalesce("rejected", F.lit(0)).alias("rejected"), "moves")


def session_replay(spark, d):
    """Events of a user are the log of a session: what it is at the end, and how often and why it was refused."""
    op = F.create_map(*[F.lit(x) for kv in {"signup": "open", "view": "heartbeat", "click": "heartbeat", "purchase": "attach", "error": "close"}.items() for x in kv])
    v = F.floor(F.col("value")).cast("long")
    e = table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), op[F.col("event_type")].alias("op"),
        F.when(v % 11 == 0, "r2").when(v % 13 == 0, " ").otherwise("r1").alias("run_id"), F.when(v % 2 == 0, "a").when(v % 5 == 0, "").otherwise("b").alias("actor"), F.when(v % 7 == 0, "M").when(v % 17 == 0, "").otherwise("L").alias("lease_id"),
        F.lit(10**6).alias("ttl_seconds"), (v % 3 == 0).alias("readonly"), F.when(v % 4 == 0, "Cancelled").when(v % 19 == 0, "odd").otherwise("").alias("final_status"),
    )
    return jobs.replay_sessions(e).select("session_id", "status", "run_id", "owner", "lease_owner", "lease_id", "lease_until", F.concat_ws(",", "errors").alias("errors"))


def selection_evidence(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("command"), "p_partkey", "p_size")
    side = lambda rows: rows.groupBy("command").agg(F.min("p_partkey").alias("place"))
    return jobs.selection_evidence(side(p.where("p_size = 1")), side(p.where("p_size = 2")))


def preflight_missing(spark, d):
    t = table(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_suppkey").alias("command"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    f = table(spark, d, "part").where("p_size > 3").select(F.concat(F.lit("p"), "p_partkey").alias("path"))
    return jobs.preflight(t, f).select("command", F.concat_ws(",", "missing").alias("missing"))


def change_set(spark, d):
    o = table(spark, d, "orders")
    side = lambda cond: o.where(cond).groupBy(F.concat(F.lit("c"), "o_custkey").alias("path")).agg(F.min("o_orderkey").alias("place"))
    out = jobs.change_set({"status": side("o_orderstatus = 'P'"), "head": side("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"), "upstream": side("o_orderstatus = 'O'")}, limit=200)
    return out.select("path", "source", "confidence")


def change_fallback(spark, d):
    m = table(spark, d, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("path")).distinct()
    return jobs.change_fallback(m, m.select("path", F.lit(0).alias("place")).where("path = 'none'"), ["red", "ring", "bolt", "red"]).select("path", F.col("place").cast("long").alias("place"), "source", "confidence")


def change_recent(spark, d):
    """The parts that were ordered first are the recent changes; names that aren't parts don't count."""
    name = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("/")))
    p = table(spark, d, "part")
    recent = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(name("p_name"), F.when(F.col("l_linenumber") == 1, "/gone").otherwise("")).alias("path"), F.col("l_orderkey").alias("place"))
    return jobs.change_fallback(p.select(name("p_name").alias("path")).distinct(), recent, ["red"]).select("path", F.col("place").cast("long").alias("place"), "source", "confidence")


def changed_state(spark, d):
    """Changed customers as files, with the fingerprint of all."""
    files = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_nationkey").cast("long").alias("size"), F.col("c_custkey").cast("long").alias("mtime"))
    changed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("c"), "o_custkey").alias("path"))
    return jobs.fingerprint_of(jobs.changed_state(changed, files))


def verify_groups(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.element_at(F.array(F.lit(".PY"), F.lit(".tsx"), F.lit(".md")), (F.col("p_size") % 3 + 1).cast("int"))).alias("path"))
    return jobs.verify_groups(p, {".py": "python", ".ts": "node", ".tsx": "node"})


def workspace_choice(spark, d):
    """Pages with a script are workspaces at their path; the pages of every host choose one."""
    p = table(spark, d, "pages").select("page_id", F.contains("html", F.lit("<script")).alias("marked"), F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "").alias("path")).where("path <> ''")
    files = p.select(F.concat("path", F.lit("/package.json")).alias("path"), "marked").where("marked").drop("marked")
    return jobs.route(p.select(F.substring_index("path", "/", 1).alias("set_id"), F.concat("path", F.lit("/x")).alias("path")), jobs.workspaces(files, ["package.json"], 3))


def command_fields(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.concat(F.lit("cd pkg"), "p_size", F.lit(" && python -m pytest -q tests/t"), "p_partkey", F.lit(".py::case")).alias("command"))
    return c.select("p_partkey", *[v.alias(k) if k != "targets" else F.concat_ws(",", v).alias(k) for k, v in jobs.command_parts().items()])


def coerced_values(spark, d):
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit(" Yes ")).when(F.col("event_type") == "view", F.concat_ws(", ", "user_id", "event_id", "user_id")).otherwise(F.col("value").cast("string")).alias("raw"))
    c = jobs.coerced("raw")
    return raw.select("event_id", c["boolean"].alias("boolean"), c["integer"].alias("integer"), F.round(c["number"], 4).alias("number"), F.size(c["items"]).cast("long").alias("n_items"))


def bench_runs(spark, d):
    """Customers are runs: their orders' parts are expected, the parts with most lines the top ones."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    runs = li.groupBy("o_custkey").agg(F.round(F.sum("l_quantity"), 2).alias("seconds"), F.count("*").alias("context_tokens"), F.sum("l_linenumber").alias("full_tokens"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("expected"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("top"), F.bool_and(F.col("o_orderstatus") != "P").alias("passed"))
    out = jobs.bench_summary(runs)
    return out.select("runs", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


def symbol_hits(spark, d):
    want = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.concat(F.lit("P"), "l_partkey").alias("symbol"))
    seen = table(spark, d, "part").where("p_size = 5").select((F.col("p_partkey") % 50).cast("long").alias("case_id"), F.concat(F.lit("p"), "p_partkey").alias("symbol"), F.lit(None).cast("string").alias("signature"))
    return jobs.symbol_hit_rate(want, seen).select("case_id", F.round("rate", 6).alias("rate"))


def index_event_counts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("ts").alias("arrived"), F.when(F.col("event_type") == "view", "index_progress").otherwise(F.col("event_type")).alias("event"), F.col("event_type").alias("stage"))
    return jobs.event_counts(e).select("job", F.coalesce(F.col("counts")["index_progress"], F.lit(0)).alias("n_progress"), "first_seq", "last_seq", "progress_seq", "stage")


def source_size(spark, d):
    return jobs.source_size(table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length("text").cast("long").alias("size")))


def changed_chars(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), "text")
    changed = table(spark, d, "orders").select(F.concat(F.lit("doc_"), "o_custkey").alias("path"), F.col("o_orderkey").alias("place"))
    return jobs.changed_chars(changed, docs)


def near_misses(spark, d):
    """Parts ranked for each supplier by quantity: the first ten and five near misses."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("task_id"), F.concat(F.lit("p"), "l_partkey").alias("path")).agg((F.sum("l_quantity").cast("long") / 1000).alias("score"))
    return jobs.near_misses(r, 10).select("task_id", "path", F.col("rank").cast("long").alias("rank"), "selected", "gap")


QUERIES = {f.__name__: f for f in (job_status, failure_commands, usable_results, cache_put, cache_get, receipt_upserts, session_replay, selection_evidence, preflight_missing, change_set, change_fallback, change_recent, changed_state, verify_groups, workspace_choice, command_fields, coerced_values, bench_runs, symbol_hits, index_event_counts, source_size, changed_chars, near_misses)}
_FIRST = lambda ex: f"(SELECT string_agg(command, ';' ORDER BY p) FROM o WHERE o.job = j.job AND ex = {ex})"
ORACLE = {
    "job_status": """WITH e AS (SELECT user_id AS job, arg_max(event_type, event_id) AS l, count(*) AS t, count(*) FILTER (WHERE event_type <> 'error') AS c, round(avg(value), 3) AS p FROM events GROUP BY 1),
        s AS (SELECT job, CASE l WHEN 'click' THEN 'running' WHEN 'error' THEN 'cancelled' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' ELSE 'failed' END AS state, t, c, least(100, greatest(0, CASE WHEN abs(p - c * 100.0::DOUBLE / t) > 0.5 THEN c * 100.0::DOUBLE / t ELSE p END)) AS p FROM e)
        SELECT job, state, round(CASE WHEN state IN ('running', 'pending') AND c >= t OR state = 'cancelled' THEN least(p, 99.9) WHEN state IN ('completed', 'failed') AND c >= t THEN 100 ELSE p END, 2)::DOUBLE AS progress, CASE WHEN state IN ('running', 'pending') AND c >= t THEN 'finalizing' WHEN state = 'cancelled' THEN 'cancelled' ELSE 'normal' END AS consistency FROM s""",
    "failure_commands": f"""WITH r AS (SELECT user_id AS job, event_id AS place, event_type || ' ' || floor(value / 50)::BIGINT AS command, value > 200 OR value < 5 AS ex FROM events WHERE event_type IN ('error', 'view')),
        o AS (SELECT job, command, ex, min(place) AS p FROM r GROUP BY ALL), j AS (SELECT DISTINCT user_id AS job FROM events), z AS (SELECT job, coalesce({_FIRST('true')}, '') AS executor_failed, coalesce({_FIRST('false')}, '') AS project_failed FROM j)
        SELECT *, CASE WHEN executor_failed <> '' AND project_failed <> '' THEN 'mixed' WHEN executor_failed <> '' THEN 'executor' WHEN project_failed <> '' THEN 'project' ELSE 'none' END AS kind FROM z""",
    "usable_results": f"WITH a AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{NOW}' AND floor(epoch(ts)) + CASE WHEN event_type = 'error' THEN 86400 ELSE 864000 END > epoch(TIMESTAMP '{NOW}') ORDER BY ts DESC, event_id LIMIT 1000) SELECT event_id AS key, user_id FROM a WHERE event_type <> 'error' AND value > 20",
    "cache_put": f"WITH n AS (SELECT user_id AS key, max(ts) AS created, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1) SELECT key, event_id FROM n WHERE floor(epoch(created)) + {12 * 86400} > epoch(TIMESTAMP '{NOW}') ORDER BY created DESC, key DESC LIMIT 500",
    "cache_get": """WITH o AS (SELECT concat_ws('/', o_custkey, o_orderpriority, o_orderstatus) AS key, concat_ws('/', o_custkey, o_orderpriority) AS t, o_orderstatus AS c, year(o_orderdate)::VARCHAR AS f, o_orderdate AS d FROM orders), k AS (SELECT * FROM o WHERE d >= TIMESTAMP '1996-01-01'), q AS (SELECT DISTINCT key, t, c, f FROM o WHERE d < TIMESTAMP '1996-01-01'),
        n AS (SELECT t, max({'d': d, 'key': key, 'c': c, 'f': f}) AS n FROM k GROUP BY t), x AS (SELECT DISTINCT key FROM k WHERE epoch(d) + 700 * 86400 > epoch(TIMESTAMP '1998-08-01')), r AS (SELECT q.key, x.key IS NOT NULL AS hit, CASE WHEN x.key IS NOT NULL THEN 'hit' WHEN n IS NULL THEN 'not_found' WHEN epoch(n.n.d) + 700 * 86400 <= epoch(TIMESTAMP '1998-08-01') THEN 'expired' WHEN n.n.c <> q.c THEN 'config_mismatch' WHEN n.n.f <> q.f THEN 'fingerprint_mismatch' ELSE 'key_mismatch' END AS reason FROM q LEFT JOIN x ON x.key = q.key LEFT JOIN n ON n.t = q.t)
        SELECT hit, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "receipt_upserts": """WITH a AS (SELECT o_custkey AS job_id, o_orderkey AS seq, o_orderstatus AS status, o_orderpriority = first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ok FROM orders), g AS (SELECT *, lag(status, 1, 'none') OVER (PARTITION BY job_id ORDER BY seq) AS was FROM a WHERE ok)
        SELECT g.job_id, max(seq) AS seq, arg_max(status, seq) AS status, (SELECT count(*) FROM a WHERE a.job_id = g.job_id AND NOT ok) AS rejected, count(*) FILTER (WHERE was <> status) AS moves FROM g GROUP BY g.job_id""",
    "session_replay": """WITH RECURSIVE a AS (SELECT user_id AS sid, event_id, floor(epoch(ts))::BIGINT AS tm, event_type AS t, floor(value)::BIGINT AS v FROM events),
        l AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY event_id) AS n, tm, CASE t WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'attach' WHEN 'error' THEN 'close' ELSE 'beat' END AS op, CASE WHEN v % 11 = 0 THEN 'r2' WHEN v % 13 = 0 THEN '' ELSE 'r1' END AS run, CASE WHEN v % 2 = 0 THEN 'a' WHEN v % 5 <> 0 THEN 'b' WHEN t = 'signup' THEN 'codex' ELSE 'policy' END AS who,
            CASE WHEN v % 7 = 0 THEN 'M' WHEN v % 17 = 0 THEN '' ELSE 'L' END AS lease, v % 3 = 0 AS ro, CASE WHEN v % 4 = 0 THEN 'canceled' WHEN v % 19 = 0 THEN 'odd' ELSE 'closed' END AS fin FROM a),
        s AS (SELECT DISTINCT sid, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::VARCHAR AS run, NULL::VARCHAR AS owner, '' AS lo, '' AS lid, NULL::BIGINT AS until, ''::VARCHAR AS errs, ''::VARCHAR AS done FROM l
            UNION ALL SELECT sid, n, CASE done WHEN 'open' THEN 'open' WHEN 'close' THEN fin WHEN 'take' THEN 'active' WHEN 'beat' THEN 'active' WHEN 'E_SESSION_EXPIRED' THEN 'expired' ELSE status END, CASE done WHEN 'open' THEN xrun ELSE run END, CASE done WHEN 'open' THEN who ELSE owner END, CASE WHEN done IN ('open', 'take') THEN who WHEN done = 'close' THEN '' ELSE lo END,
                CASE WHEN done IN ('open', 'take') THEN lease WHEN done = 'close' THEN '' ELSE lid END, CASE WHEN done IN ('open', 'take', 'beat') THEN tm + 86400 WHEN done = 'close' THEN NULL ELSE until END, CASE WHEN done LIKE 'E_%' THEN errs || CASE WHEN errs = '' THEN '' ELSE ',' END || done ELSE errs END, ''
            FROM (SELECT s.sid, l.n, s.status, s.run, s.owner, s.lo, s.lid, s.until, s.errs, l.tm, l.run AS xrun, l.who, l.lease, l.fin,
                CASE l.op WHEN 'open' THEN CASE WHEN l.run = '' THEN 'E_INVALID_STATE' WHEN s.run <> l.run THEN 'E_SESSION_CONFLICT' ELSE 'open' END
                    WHEN 'close' THEN CASE WHEN l.fin = 'odd' THEN 'E_INVALID_STATE' WHEN s.status IS NULL THEN 'E_SESSION_NOT_FOUND' ELSE 'close' END
                    WHEN 'beat' THEN CASE WHEN l.lease = '' THEN 'E_INVALID_STATE' WHEN s.status IS NULL THEN 'E_SESSION_NOT_FOUND' WHEN s.lid <> l.lease THEN 'E_SESSION_CONFLICT' WHEN s.until <= l.tm THEN 'E_SESSION_EXPIRED' ELSE 'beat' END
                    ELSE CASE WHEN l.run = '' THEN 'E_INVALID_STATE' WHEN s.status IS NULL THEN 'E_SESSION_NOT_FOUND' WHEN s.run <> l.run THEN 'E_SESSION_CONFLICT' WHEN s.until <= l.tm THEN 'E_SESSION_EXPIRED' WHEN l.ro THEN 'same' WHEN s.lo <> '' AND s.lo <> l.who AND s.lid <> '' AND s.until > l.tm THEN 'E_SESSION_CONFLICT' ELSE 'take' END END AS done
                FROM s JOIN l ON l.sid = s.sid AND l.n = s.n + 1))
        SELECT sid AS session_id, status, run AS run_id, owner, lo AS lease_owner, lid AS lease_id, until AS lease_until, errs AS errors FROM s QUALIFY n = max(n) OVER (PARTITION BY sid)""",
    "selection_evidence": "WITH a AS (SELECT p_name AS command, min(p_partkey) AS place FROM part WHERE p_size = 1 GROUP BY 1), b AS (SELECT p_name AS command, min(p_partkey) AS place FROM part WHERE p_size = 2 GROUP BY 1) SELECT 'safety_baseline' AS layer, * FROM a UNION ALL SELECT 'incremental_acceleration', * FROM b WHERE command NOT IN (SELECT command FROM a)",
    "preflight_missing": "SELECT 'c' || l_suppkey AS command, array_to_string(list_sort(list(DISTINCT 'p' || l_partkey)), ',') AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) GROUP BY 1",
    "change_set": "WITH u AS (SELECT 'c' || o_custkey AS path, 0 AS o, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT 'c' || o_custkey, 1, min(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT 'c' || o_custkey, 2, min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT path, min(o) AS o, arg_min(p, o) AS p FROM u GROUP BY path ORDER BY o, p, path LIMIT 200) SELECT path, ['status', 'head', 'upstream'][o + 1] AS source, (max([0.98, 0.9, 0.99][o + 1]) OVER ())::DOUBLE AS confidence FROM f",
    "change_fallback": "WITH m AS (SELECT DISTINCT replace(lower(p_name), ' ', '/') AS path FROM part), h AS (SELECT path, contains(path, 'red')::INT + contains(path, 'ring')::INT + contains(path, 'bolt')::INT AS hits FROM m) SELECT path, row_number() OVER (ORDER BY hits DESC, path) AS place, 'planner_fallback' AS source, greatest(0.35, least(0.88, 0.35 + 0.5 * (SELECT max(hits) FROM h) / 3.0))::DOUBLE AS confidence FROM h WHERE hits > 0 ORDER BY hits DESC, path LIMIT 24",
    "change_recent": "WITH r AS (SELECT replace(lower(p_name), ' ', '/') AS path, min(l_orderkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 1 GROUP BY 1) SELECT path, row_number() OVER (ORDER BY k, path) AS place, 'manifest_recent' AS source, 0.92::DOUBLE AS confidence FROM r ORDER BY k, path LIMIT 24",
    "changed_state": """WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT * FROM customer WHERE c_acctbal > 0),
        h AS (SELECT sha256('{"path":"c' || k || '","exists":' || (c_custkey IS NOT NULL) || ',"size":' || coalesce(c_nationkey, 0) || ',"mtime":' || coalesce(c_custkey, 0) || '}') AS h FROM c LEFT JOIN f ON c_custkey = k),
        x AS (SELECT count(*) AS n, bit_xor(('0x' || h[1:15])::BIGINT) AS x, bit_xor(('0x' || h[16:30])::BIGINT) AS y FROM h) SELECT n, sha256(n || ',' || x || ',' || y) AS fingerprint FROM x""",
    "verify_groups": "SELECT DISTINCT ['python', 'node'][p_size % 3 + 1] AS \"group\" FROM part WHERE p_size % 3 < 2",
    "workspace_choice": """WITH p AS (SELECT page_id, contains(html, '<script') AS marked, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM pages), q AS (SELECT page_id, marked, path, split_part(path, '/', 1) AS set_id, string_split(path, '/') AS ps FROM p WHERE path <> ''),
        s AS (SELECT DISTINCT path AS rel, len(ps) AS depth FROM q WHERE marked AND len(ps) <= 3 AND NOT list_has_any(ps, ['node_modules', 'dist', 'build', '.venv', 'venv', '__pycache__'])),
        h AS (SELECT set_id, rel, depth, count(*) AS n FROM (SELECT set_id, array_to_string(ps[:k], '/') AS pre FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM q)) JOIN s ON rel = pre GROUP BY ALL), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY n DESC, depth, rel) = 1)
        SELECT x.set_id, coalesce(rel, (SELECT rel FROM s ORDER BY depth, rel LIMIT 1)) AS rel, coalesce(n, 0) AS files FROM (SELECT DISTINCT set_id FROM q) x LEFT JOIN b ON b.set_id = x.set_id""",
    "command_fields": "SELECT p_partkey, 'python -m pytest -q tests/t' || p_partkey || '.py::case' AS last, 'pkg' || p_size AS folder, 'pytest' AS module, NULL AS script, 'tests/t' || p_partkey || '.py' AS targets FROM part",
    "coerced_values": """SELECT event_id, CASE WHEN event_type = 'error' THEN true END AS boolean, NULL::BIGINT AS integer, CASE WHEN event_type NOT IN ('error', 'view') THEN round(value, 4) END AS number, CASE WHEN event_type = 'view' AND user_id <> event_id THEN 2 ELSE 1 END::BIGINT AS n_items FROM events""",
    "bench_runs": """WITH r AS (SELECT o_custkey, round(sum(l_quantity), 2)::DOUBLE AS s, count(*) AS c, sum(l_linenumber) AS f, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag = 'R')) AS e, list_distinct(list(l_partkey) FILTER (WHERE l_linenumber = 1)) AS t, bool_and(o_orderstatus <> 'P') AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT count(*) AS runs, round(avg(s), 5) AS seconds_avg, round(median(s), 5) AS seconds_p50, round(avg(c), 5) AS tokens_avg, round(avg(least(1.0, 1 - c::DOUBLE / f)), 5) AS reduction_avg, round(avg(CASE WHEN len(e) > 0 THEN len(list_intersect(e, coalesce(t, [])))::DOUBLE / len(e) END), 5) AS recall_avg, round(avg(p::INT), 5) AS pass_rate FROM r""",
    "symbol_hits": "WITH w AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS p FROM lineitem), s AS (SELECT p_partkey % 50 AS c, p_partkey AS p FROM part WHERE p_size = 5) SELECT case_id, round(count(s.p)::DOUBLE / count(*), 6) AS rate FROM w LEFT JOIN s ON s.c = case_id AND s.p = w.p GROUP BY case_id",
    "index_event_counts": "SELECT user_id AS job, count(*) FILTER (WHERE event_type = 'view') AS n_progress, min(event_id) AS first_seq, arg_max(event_id, ts) AS last_seq, max(event_id) FILTER (WHERE event_type = 'view') AS progress_seq, arg_max(event_type, event_id) AS stage FROM events GROUP BY 1",
    "source_size": "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, round((SELECT avg(n) FROM (SELECT strlen(text) AS n FROM documents ORDER BY doc_id LIMIT 200)) * count(*))::BIGINT AS estimate FROM documents",
    "changed_chars": "WITH c AS (SELECT o_custkey AS k, min(o_orderkey) AS p FROM orders GROUP BY 1 ORDER BY p, 'doc_' || k LIMIT 200) SELECT least(2000000, coalesce(sum(length(text)), 0))::BIGINT AS chars FROM documents JOIN c ON k = doc_id",
    "near_misses": "WITH g AS (SELECT l_suppkey AS task_id, 'p' || l_partkey AS path, sum(l_quantity)::BIGINT / 1000.0::DOUBLE AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY s DESC, path) AS rank FROM g QUALIFY rank <= 15) SELECT task_id, path, rank, rank <= 10 AS selected, CASE WHEN rank > 10 THEN round(min(s) FILTER (WHERE rank <= 10) OVER (PARTITION BY task_id) - s, 6) END AS gap FROM r",
}
