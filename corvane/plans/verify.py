"""Verify plans, injected files, callers, event summaries, health and suites over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import commands, summary, verify
from corvane.session import table
from corvane.streaming.jobs import shared

CHECKS = [("python", 1, "pytest -q"), ("python", 2, "ruff check"), ("node", 3, "npm test"), ("node", 4, " ruff check "), ("go", 5, "go test"), ("off", 6, "never")]
GROUPS = {".py": "python", ".ts": "node", ".tsx": "Node", ".go": "go"}
ENABLED = ["python", "Node", "go"]
NOW = "2024-02-02 00:00:00"


def verify_plans(spark, d):
    """A pack for each supplier: its parts are the files, parts own tests by their type, returned parts of some types are changed."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    top = li.select(F.col("l_suppkey").alias("pack_id"), F.concat(F.lit("p"), "l_partkey").alias("path"))
    owned = p.select(F.concat(F.lit("t_"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("test_file"), F.concat(F.lit("p"), "p_partkey").alias("owns_file"), F.col("p_partkey").alias("place"))
    ending = F.create_map(*[F.lit(x) for x in ("PROMO", ".PY", "ECONOMY", ".tsx", "SMALL", ".md", "LARGE", ".go")])[F.col("p_type")]
    changed = li.where("l_returnflag = 'R' AND l_quantity > 49 AND l_linenumber > 4").join(p, F.col("l_partkey") == F.col("p_partkey")).where(ending.isNotNull()).select(F.col("l_suppkey").alias("pack_id"), F.concat(F.lit("a/p"), "l_partkey", ending).alias("path"))
    packs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pack_id"))
    out = verify.verify_plan(packs, top, owned, changed, GROUPS, spark.createDataFrame(CHECKS, "group string, place int, command string"), ENABLED)
    return out.select("pack_id", "run_all", F.concat_ws(",", "changed_groups").alias("changed_groups"), F.concat_ws(",", "target_tests").alias("target_tests"), F.concat_ws(",", "target_checks").alias("target_checks"), "reason")


def _empty_packs(spark, d):
    """Customers as packs with their open orders as files; their documents by key and by nation are changed."""
    c, docs = table(spark, d, "customer"), table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), "text")
    top = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("pack_id"))
    changed = c.select(F.col("c_custkey").alias("pack_id"), F.inline(F.array(F.struct(F.lit(2).alias("place"), F.concat(F.lit("./doc_"), "c_nationkey").alias("path")), F.struct(F.lit(1).alias("place"), F.concat(F.lit("doc_"), "c_custkey").alias("path")), F.struct(F.lit(3).alias("place"), F.lit("gone").alias("path")))))
    return verify.inject_changed(c.select(F.col("c_custkey").alias("pack_id")), top, top.limit(0), changed, docs, 8, 1, 300)


def injected_files(spark, d):
    return _empty_packs(spark, d)[0].select("pack_id", F.col("rank").cast("long").alias("rank"), "path", "score")


def injected_snippets(spark, d):
    return _empty_packs(spark, d)[1].select("pack_id", "path", F.col("line_end").cast("long").alias("line_end"), F.sha1("content").alias("content_sha1"))


def symbol_callers(spark, d):
    """Lines of orders call parts by name, in capitals; those of a first line only point to the part's file."""
    p = table(spark, d, "part")
    syms = p.select(F.col("p_name").alias("symbol"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.concat(F.lit("src/"), "p_brand").alias("file"))
    li = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    named = F.col("l_linenumber") > 1
    refs = li.select(F.when(named, F.upper("p_name")).otherwise("none").alias("target_symbol"), F.when(~named, F.concat(F.lit("SRC/"), "p_brand")).alias("edge_to"), F.concat(F.lit("s"), "l_suppkey").alias("source_symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return verify.callers(syms, refs, 5).select("symbol", "file", "n_callers", F.concat_ws(",", "called_by").alias("called_by"))


def _log(spark, d, kinds):
    e, v = table(spark, d, "events"), F.floor("value").cast("long")
    name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    rows = e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), name.alias("event"), F.when(v % 3 == 0, "running").otherwise(" ").alias("state"), F.when(v % 4 == 0, F.concat(F.lit("s"), v % 5)).otherwise("").alias("stage"), F.when(v % 2 == 0, F.concat(F.lit("c"), v)).alias("chunk"), F.when(v % 2 == 0, "stderr").alias("stream"), (v > 20).alias("stall_detected"), F.concat(F.lit("e"), v).alias("error"))
    status = table(spark, d, "customer").select(F.col("c_custkey").alias("job"), F.when(F.col("c_mktsegment") == "BUILDING", "Completed").when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("pending").alias("state"), F.when(F.col("c_nationkey") % 2 == 0, "done").alias("stage"))
    return rows, status


VERIFY_KINDS = {"view": "command_output", "click": "command_complete", "signup": "heartbeat", "error": "error", "purchase": "job_failed"}
CONTEXT_KINDS = {"view": "Progress", "click": "context_completed", "signup": "", "error": "context_failed", "purchase": "queued"}


def verify_events(spark, d):
    out = summary.verify_summary(*_log(spark, d, VERIFY_KINDS))
    return out.select("job", "latest_state", "latest_stage", "terminal_event_seen", "state_source", "completed", "errors", "output_chunks", "stall_heartbeats", "first_seq", "last_seq", F.coalesce(F.size("event_type_counts"), F.lit(0)).cast("long").alias("kinds"), F.concat_ws(",", F.transform("recent_output", lambda x: F.concat(x["chunk"], F.lit("/"), x["stream"]))).alias("recent"))


def context_events(spark, d):
    return summary.context_summary(*_log(spark, d, CONTEXT_KINDS)).select("job", "latest_state", "latest_stage", "state_source", "terminal_event_seen", "first_seq", "last_seq", "latest_error", F.coalesce(F.element_at("event_type_counts", "progress"), F.lit(0)).alias("progress"))


def health_report(spark, d):
    """Orders are the index, users' last events the jobs."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
    jobs = last.select(F.when(F.col("t") == "view", "running").when(F.col("t") == "click", "pending").otherwise("completed").alias("state"))
    out = summary.health(table(spark, d, "orders"), "o_orderdate", jobs, F.lit("1998-08-03 06:00:00").cast("timestamp"), receipts=False)
    return out.withColumn("issues", F.concat_ws(";", "issues"))


def suite_cases(spark, d):
    """Benchmark items written as one suite and loaded again."""
    path = f"{shared(spark)}/suite-{uuid.uuid4().hex}"
    b = table(spark, d, "benchmark").orderBy("item_id").select(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" i"), "item_id")).alias("id"), F.concat(F.lit(" "), F.substring("text", 1, 1000)).alias("task"), F.array(F.concat(F.lit("f"), "item_id"), F.lit(" ")).alias("expected_files"))
    one = b.agg(F.to_json(F.struct(F.lit("s").alias("name"), F.collect_list(F.struct("*")).alias("cases"))).alias("value"))  # a suite is one document
    one.coalesce(1).write.text(path)
    return summary.load_suite(spark, f"{path}/part-*").select(F.when(F.startswith("id", F.lit("case_")), "case").otherwise(F.col("id")).alias("id"), F.sha1("task").alias("task_sha1"), F.concat_ws(",", "expected_files").alias("expected_files"), F.size("hints").cast("long").alias("hints"))


def gated_plans(spark, d):
    """A pack for each order: its lines are files and snippets, its customer's tests the plan."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")))
    pack, rank, path = F.col("l_orderkey").alias("pack_id"), F.col("n").alias("rank"), F.when(F.col("l_quantity") > 45, " ").otherwise(F.concat(F.lit(" f"), "l_partkey"))
    top = li.select(pack, rank, path.alias("path"), (F.col("l_quantity") / 64).alias("score"), F.array("l_returnflag", F.lit(" "), "l_linestatus").alias("reasons"))
    shown = li.select(pack, rank, path.alias("path"), (F.col("n") - 2).alias("line_start"), (F.col("l_quantity") - 20).cast("int").alias("line_end"), F.col("p_brand").alias("symbol"), F.when(F.col("l_quantity") < 5, "\n ").otherwise(F.col("p_name")).alias("content"))
    plans = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("pack_id"), F.array(F.concat(F.lit("t"), "o_custkey"), F.lit(" ")).alias("target_tests"), F.array(F.lit("ruff"), "o_orderpriority").alias("target_checks"), F.lit("run").alias("reason"))
    out = verify.plan_and_gate(o.select(F.col("o_orderkey").alias("pack_id")), top, shown, plans, 3, 4)
    file = lambda f: F.concat_ws(":", f["rank"], f["path"], (f["score"] * 64).cast("long"), F.concat_ws("+", f["reasons"]))
    text = lambda x: F.concat_ws(":", x["path"], x["line_start"], x["line_end"], x["symbol"], x["content"], (x["relevance_score"] * 64).cast("long"))
    return out.select("pack_id", F.array_join(F.transform("affected_files", file), ";").alias("affected_files"), F.array_join(F.transform("minimal_snippets", text), ";").alias("minimal_snippets"), F.array_join("target_tests", ",").alias("target_tests"), F.array_join("target_checks", ",").alias("target_checks"), "selected_tests_count", "selected_checks_count", "selection_reason", F.array_join("scope_files_hint", ",").alias("scope_files_hint"))


def routed_commands(spark, d):
    """A test command for each line of an order: its part's test by a case with a blank, and the tests' folder of a size that may not exist."""
    p = table(spark, d, "part")
    files = p.select(F.concat(F.lit("pkg"), "p_size", F.lit("/tests/t"), "p_partkey", F.lit(".py")).alias("path"))
    li = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    command = F.concat(F.lit('python -m pytest -q "./pkg'), "p_size", F.lit("/tests/t"), "l_partkey", F.lit('.py::case one" pkg'), F.col("l_quantity").cast("int") + F.col("l_linenumber") % 2 * 100, F.lit("/tests/ none.py"))
    c = li.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("command_id"), command.alias("command"), F.when(F.col("l_linenumber") == 4, " ").otherwise(F.concat(F.lit("pkg"), "p_size")).alias("workspace"))
    return commands.route_commands(c, files)


QUERIES = {f.__name__: f for f in (verify_plans, injected_files, injected_snippets, symbol_callers, verify_events, context_events, health_report, suite_cases, gated_plans, routed_commands)}
_LOG = lambda kinds: f"""e AS (SELECT user_id AS job, event_id AS seq, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items())} END AS ev, floor(value)::BIGINT AS v FROM events),
        l AS (SELECT *, CASE WHEN v % 3 = 0 THEN 'running' END AS st, CASE WHEN v % 4 = 0 THEN 's' || v % 5 END AS sg FROM e WHERE ev <> ''),
        s AS (SELECT c_custkey AS job, CASE c_mktsegment WHEN 'BUILDING' THEN 'Completed' WHEN 'MACHINERY' THEN '' ELSE 'pending' END AS st0, CASE WHEN c_nationkey % 2 = 0 THEN 'done' ELSE '' END AS sg0 FROM customer)"""  # noqa: E731
ORACLE = {
    "verify_plans": """WITH o AS (SELECT 't_' || lower(replace(p_name, ' ', '_')) AS t, p_partkey AS k, p_type FROM part), h AS (SELECT l_suppkey AS s, t, min(k) AS k FROM lineitem JOIN o ON l_partkey = k GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY min(k), t) <= 20),
        tt AS (SELECT s, string_agg(t, ',' ORDER BY k, t) AS tests FROM h GROUP BY s), c AS (SELECT DISTINCT l_suppkey AS s, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_linenumber > 4 AND p_type IN ('PROMO', 'ECONOMY', 'SMALL', 'LARGE')),
        g AS (SELECT s, bool_or(p_type = 'PROMO') AS py, bool_or(p_type = 'ECONOMY') AS nd, bool_or(p_type = 'LARGE') AS go FROM c GROUP BY s)
        SELECT s_suppkey AS pack_id, g.s IS NULL AS run_all, coalesce(concat_ws(',', CASE WHEN go THEN 'go' END, CASE WHEN nd THEN 'node' END, CASE WHEN py THEN 'python' END), '') AS changed_groups, coalesce(tests, '') AS target_tests,
        CASE WHEN g.s IS NULL THEN 'pytest -q,ruff check,npm test,go test' WHEN py THEN concat_ws(',', 'pytest -q', 'ruff check', CASE WHEN nd THEN 'npm test' END, CASE WHEN go THEN 'go test' END) ELSE concat_ws(',', CASE WHEN nd THEN 'npm test' END, CASE WHEN nd THEN 'ruff check' END, CASE WHEN go THEN 'go test' END) END AS target_checks,
        CASE WHEN g.s IS NULL THEN 'run_all' ELSE 'changed_verify_groups_match' END AS reason FROM supplier LEFT JOIN tt ON tt.s = s_suppkey LEFT JOIN g ON g.s = s_suppkey""",
    "injected_files": """WITH x AS (SELECT c_custkey AS k, unnest([c_custkey, c_nationkey]) AS doc, unnest([1, 2]) AS place FROM customer), y AS (SELECT k, doc, min(place) AS place FROM x JOIN documents ON doc_id = doc GROUP BY 1, 2)
        SELECT k AS pack_id, row_number() OVER (PARTITION BY k ORDER BY place) AS rank, 'doc_' || doc AS path, 1.0::DOUBLE AS score FROM y WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    "injected_snippets": """WITH x AS (SELECT c_custkey AS k, unnest([c_custkey, c_nationkey]) AS doc, unnest([1, 2]) AS place FROM customer), y AS (SELECT k, doc_id, left(coalesce(text, ''), 300) AS c FROM x JOIN documents ON doc_id = doc QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) = 1), z AS (SELECT k, doc_id, CASE WHEN c = '' THEN '[empty file]' ELSE c END AS c FROM y)
        SELECT k AS pack_id, 'doc_' || doc_id AS path, length(c) - length(replace(c, chr(10), '')) + 1 AS line_end, sha1(c) AS content_sha1 FROM z""",
    "symbol_callers": """WITH r AS (SELECT p_name AS n, p_brand AS b, l_linenumber > 1 AS named, 's' || l_suppkey AS c, l_orderkey * 10 + l_linenumber AS place FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT DISTINCT p_name, p_brand FROM part),
        k AS (SELECT p_name, p_brand, c, min(place) AS place FROM (SELECT p_name, p_brand, c, place FROM s JOIN r ON n = p_name AND named UNION ALL SELECT p_name, p_brand, c, place FROM s JOIN r ON b = p_brand AND NOT named) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY place, c) AS rn FROM k)
        SELECT p_name AS symbol, 'src/' || p_brand AS file, count(*) AS n_callers, string_agg(c, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS called_by FROM o GROUP BY 1, 2""",
    "verify_events": f"""WITH {_LOG(VERIFY_KINDS)}, b AS (SELECT job, count(*) FILTER (WHERE ev = 'command_complete') AS completed, count(*) FILTER (WHERE ev = 'error') AS errors, count(*) FILTER (WHERE ev = 'command_output') AS output_chunks, count(*) FILTER (WHERE ev = 'heartbeat' AND v > 20) AS stall_heartbeats, min(seq) FILTER (WHERE seq > 0) AS first_seq, max(seq) AS last_seq, count(DISTINCT ev) AS kinds,
            bool_or(ev = 'job_failed') AS ended, arg_max(st, seq) FILTER (WHERE st IS NOT NULL) AS st1, arg_max(sg, seq) FILTER (WHERE sg IS NOT NULL) AS sg1, arg_max(sg, seq) FILTER (WHERE ev = 'job_failed' AND sg IS NOT NULL) AS sg2 FROM l GROUP BY job),
        w AS (SELECT job, string_agg('c' || v || '/stderr', ',' ORDER BY seq) AS recent FROM (SELECT * FROM l WHERE ev = 'command_output' AND v % 2 = 0 QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq DESC) <= 3) GROUP BY job)
        SELECT s.job, CASE WHEN st0 = 'Completed' THEN 'completed' WHEN ended THEN 'failed' ELSE coalesce(st1, st0) END AS latest_state, CASE WHEN st0 = 'Completed' THEN coalesce(nullif(sg0, ''), sg1, '') WHEN ended THEN coalesce(sg2, sg1, sg0) ELSE coalesce(sg1, sg0) END AS latest_stage, st0 = 'Completed' OR coalesce(ended, false) AS terminal_event_seen,
        CASE WHEN st0 = 'Completed' THEN 'status_terminal' WHEN ended THEN 'event_terminal' ELSE 'events' END AS state_source, coalesce(completed, 0) AS completed, coalesce(errors, 0) AS errors, coalesce(output_chunks, 0) AS output_chunks, coalesce(stall_heartbeats, 0) AS stall_heartbeats, coalesce(first_seq, 0) AS first_seq, coalesce(last_seq, 0) AS last_seq, coalesce(kinds, 0) AS kinds, coalesce(recent, '') AS recent
        FROM s LEFT JOIN b USING (job) LEFT JOIN w USING (job)""",
    "context_events": f"""WITH {_LOG(CONTEXT_KINDS)}, m AS (SELECT *, CASE ev WHEN 'context_completed' THEN 'completed' WHEN 'context_failed' THEN 'failed' END AS x FROM l),
        b AS (SELECT job, arg_max(coalesce(x, st), seq) FILTER (WHERE coalesce(x, st) IS NOT NULL) AS st1, arg_max(x IS NOT NULL, seq) FILTER (WHERE coalesce(x, st) IS NOT NULL) AS ends, arg_max(coalesce(x, sg), seq) FILTER (WHERE coalesce(x, sg) IS NOT NULL) AS sg1, bool_or(x IS NOT NULL) AS seen, min(seq) FILTER (WHERE seq > 0) AS first_seq, max(seq) AS last_seq, arg_max('e' || v, seq) FILTER (WHERE ev = 'context_failed') AS err, count(*) FILTER (WHERE ev = 'Progress') AS progress FROM m GROUP BY job)
        SELECT s.job, coalesce(st1, st0) AS latest_state, coalesce(sg1, sg0) AS latest_stage, CASE WHEN ends THEN 'event_terminal' WHEN st1 IS NOT NULL THEN 'events' ELSE 'job_state' END AS state_source, coalesce(seen, false) AS terminal_event_seen, coalesce(first_seq, 0) AS first_seq, coalesce(last_seq, 0) AS last_seq, coalesce(err, '') AS latest_error, coalesce(progress, 0) AS progress FROM s LEFT JOIN b USING (job)""",
    "health_report": """WITH i AS (SELECT count(*) AS n, (epoch(TIMESTAMP '1998-08-03 06:00:00') - epoch(max(o_orderdate)))::DOUBLE AS age FROM orders), j AS (SELECT count(*) FILTER (WHERE t = 'view') AS active, count(*) FILTER (WHERE t = 'click') AS pending, count(*) AS total FROM (SELECT arg_max(event_type, event_id) AS t FROM events GROUP BY user_id))
        SELECT 'warning' AS status, CASE WHEN age > 86400 THEN 'Index may be stale (>24h old);' ELSE '' END || 'Receipt store not found' AS issues, true AS index_exists, age > 86400 AS stale, round(age / 3600, 2)::DOUBLE AS age_hours, n AS file_count, true AS cache_ok, false AS receipts_ok, active, pending, total FROM i, j""",
    "gated_plans": """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus) AS n, CASE WHEN l_quantity <= 45 THEN 'f' || l_partkey END AS path, l_quantity::BIGINT AS q, l_returnflag || '+' || l_linestatus AS why, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
        s AS (SELECT k, path, arg_max(q, n) AS q1 FROM l WHERE path IS NOT NULL GROUP BY 1, 2), m AS (SELECT * FROM l JOIN s USING (k, path)),
        a AS (SELECT k, string_agg(n || ':' || path || ':' || q1 || ':' || why, ';' ORDER BY n) FILTER (WHERE n <= 3) AS files, string_agg(path, ',' ORDER BY n) FILTER (WHERE n <= 3) AS hint,
        string_agg(path || ':' || greatest(1, n - 2) || ':' || greatest(1, n - 2, q - 20) || ':' || p_brand || ':' || p_name || ':' || q1, ';' ORDER BY n) FILTER (WHERE n <= 4 AND q >= 5) AS texts FROM m GROUP BY k)
        SELECT o_orderkey AS pack_id, coalesce(files, '') AS affected_files, coalesce(texts, '') AS minimal_snippets, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 't' || o_custkey END AS target_tests, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'ruff,' || o_orderpriority END AS target_checks,
        CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END::BIGINT AS selected_tests_count, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END::BIGINT AS selected_checks_count, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'run' END AS selection_reason, coalesce(hint, '') AS scope_files_hint FROM orders LEFT JOIN a ON k = o_orderkey""",
    "routed_commands": """WITH l AS (SELECT l_orderkey || '.' || l_linenumber AS command_id, p_size AS s, l_partkey AS p, l_quantity::INT + l_linenumber % 2 * 100 AS q, l_linenumber = 4 AS root FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT *, q IN (SELECT p_size FROM part) AS there FROM l), m AS (SELECT *, root OR (there AND q <> s) AS stays FROM t)
        SELECT command_id, CASE WHEN stays THEN 'python -m pytest -q "./pkg' || s || '/tests/t' || p || '.py::case one" pkg' || q || '/tests/ none.py' ELSE 'cd "pkg' || s || '" && python -m pytest -q ''tests/t' || p || '.py::case one'' ' || CASE WHEN q = s THEN 'tests' ELSE 'pkg' || q || '/tests/' END || ' none.py' END AS command,
        CASE WHEN stays THEN '.' ELSE 'pkg' || s END AS workspace, CASE WHEN stays THEN 0 WHEN q = s THEN 2 ELSE 1 END::BIGINT AS rebased FROM m""",
    "suite_cases": "SELECT CASE WHEN item_id % 2 = 0 THEN 'i' || item_id ELSE 'case' END AS id, sha1(trim(left(text, 1000))) AS task_sha1, 'f' || item_id AS expected_files, 0::BIGINT AS hints FROM benchmark",
}
