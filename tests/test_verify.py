"""Suites, summaries and plans on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import commands, summary, verify


def put(tmp_path, value):
    path = tmp_path / "suite.json"
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    return str(path)


def test_suites(spark, tmp_path):
    cases = [{"id": " a ", "task": " do it ", "changed_files": ["x.py", "", 3], "hints": "no list"}, {"task": "b", "expected_files": ["y"], "expected_symbols": ["s", " "]}]
    for value in (cases, {"name": "n", "cases": cases}):
        got = [tuple(r) for r in summary.load_suite(spark, put(tmp_path, value)).collect()]
        assert got == [("a", "do it", ["x.py", "3"], [], [], []), ("case_002", "b", [], ["y"], ["s"], [])]
    with pytest.raises(Exception, match="case_001: task is required"):
        summary.load_suite(spark, put(tmp_path, [{"task": " "}])).collect()
    for bad in ({"cases": 3}, "{", "3"):
        with pytest.raises(Exception, match="a suite must be"):
            summary.load_suite(spark, put(tmp_path, bad)).collect()
    tasks = [{"id": "t", "task": "x", "changed_files": [" a\\b.py "], "hints": [" h "]}, {"id": "", "task": "x"}, {"id": "u"}, 7]
    assert [tuple(r) for r in summary.load_tasks(spark, put(tmp_path, tasks)).collect()] == [("t", "x", ["a/b.py"], ["h"], [])]


def test_summaries(spark):
    rows = [(1, 1, "command_output", "running", "a", " out "), (1, 2, "job_completed", "", "b", None), (1, 3, " ", "odd", "odd", None), (1, 4, "command_output", "late", "", "x"), (2, 0, "heartbeat", None, None, None)]
    events = spark.createDataFrame(rows, "job int, seq long, event string, state string, stage string, chunk string")
    status = spark.createDataFrame([(1, "running", "s"), (2, None, None), (3, "FAILED", "end")], "job int, state string, stage string")
    got = {r.job: r for r in summary.verify_summary(events, status).collect()}
    assert (got[1].latest_state, got[1].latest_stage, got[1].state_source, got[1].first_seq, got[1].last_seq) == ("completed", "b", "event_terminal", 1, 4)
    assert [(x.seq, x.stream, x.chunk) for x in got[1].recent_output] == [(1, "stdout", "out"), (4, "stdout", "x")] and got[1].event_type_counts == {"command_output": 2, "job_completed": 1}
    assert (got[2].latest_state, got[2].first_seq, got[2].terminal_event_seen) == ("", 0, False)
    assert (got[3].latest_state, got[3].latest_stage, got[3].state_source, got[3].output_chunks) == ("failed", "end", "status_terminal", 0)
    context = {r.job: r for r in summary.context_summary(events.replace("job_completed", "CONTEXT_failed", "event"), status).collect()}
    assert (context[1].latest_state, context[1].state_source, context[1].terminal_event_seen) == ("late", "events", True) and context[3].state_source == "job_state"


def test_health_ladder(spark):
    files = spark.createDataFrame([("a", 0)], "f string, at long").withColumn("at", F.timestamp_seconds("at"))
    jobs = spark.createDataFrame([("running",), ("pending",), ("completed",)], "state string")
    say = lambda f, now, **k: tuple(summary.health(f, "at", jobs, F.timestamp_seconds(F.lit(now)), **k).select("status", "issues", "active", "total").first())
    assert say(files, 86400) == ("healthy", [], 1, 3) and say(files, 86401) == ("warning", ["Index may be stale (>24h old)"], 1, 3)
    assert say(files.limit(0), 5, receipts=False) == ("degraded", ["Symbol index not found", "Receipt store not found"], 1, 3) and say(files, 5, receipts=False)[0] == "warning"


def test_plan_of_packs(spark):
    make = spark.createDataFrame
    packs, top = make([(1,), (2,), (3,)], "pack_id int"), make([(1, "a.py"), (1, "a.py"), (2, "b.py")], "pack_id int, path string")
    owned = make([("t2", "a.py", 2), ("t1", "a.py", 5), ("t1", "b.py", 1), ("", "a.py", 0)], "test_file string, owns_file string, place int")
    changed = make([(1, "X/y.PY"), (2, "README")], "pack_id int, path string")
    checks = make([("Python", 2, "b"), ("python", 1, "a"), ("node", 3, "a"), ("node", 4, "c")], "group string, place int, command string")
    got = {r.pack_id: r for r in verify.verify_plan(packs, top, owned, changed, {".py": "python"}, checks, most=1).collect()}
    assert (got[1].run_all, got[1].target_tests, got[1].target_checks, got[1].changed_groups) == (False, ["t2"], ["a", "b"], ["python"])
    assert (got[2].run_all, got[2].target_tests, got[2].target_checks) == (False, ["t1"], []) and (got[3].run_all, got[3].target_tests, got[3].target_checks, got[3].reason) == (True, [], ["a", "b", "c"], "run_all")


def test_injection(spark):
    make = spark.createDataFrame
    changed = make([(1, "./a.py", 2), (1, "b\\c.py", 1), (1, "gone.py", 0), (2, "a.py", 1), (9, "a.py", 1)], "pack_id int, path string, place int")
    texts = make([("a.py", None), ("b/c.py", "x\ny\n" + "z" * 300)], "path string, text string")
    files, snippets = verify.inject_changed(make([(1,), (2,)], "pack_id int"), make([(2, "z")], "pack_id int, path string"), make([], "pack_id int"), changed, texts, 1, 5, 10)
    assert [(r.pack_id, r.path, r.score) for r in files.collect()] == [(1, "b/c.py", 1.0)]
    got = sorted((r.pack_id, r.rank, r.path, r.line_end, r.content) for r in snippets.collect())
    assert got == [(1, 1, "b/c.py", 3, "x\ny\n" + "z" * 196), (1, 2, "a.py", 1, "[empty file]"), (2, 1, "a.py", 1, "[empty file]")]


def test_commands_in_their_workspaces(spark):
    """Each rule of routing, by one command; null, blank and odd commands too."""
    files = spark.createDataFrame([("pkg/tests/test_a.py",), ("pkg/tests/it's b.py",), ("other/test_c.py",), ("top.py",)], "path string")
    asked = {
        ("pytest -q pkg/tests/test_a.py::T::case ./pkg", "pkg"): ('cd "pkg" && pytest -q tests/test_a.py::T::case .', "pkg", 2),
        ("python3 -O -m pytest .\\pkg\\tests/ -k 'a and b'", "pkg"): ("cd \"pkg\" && python3 -O -m pytest tests -k 'a and b'", "pkg", 1),
        ("pytest \"pkg/tests/it's b.py\"", "pkg"): ("cd \"pkg\" && pytest 'tests/it'\"'\"'s b.py'", "pkg", 1),
        ("pytest pkg/tests/test_a.py other/test_c.py", "pkg"): ("pytest pkg/tests/test_a.py other/test_c.py", ".", 0),
        ("pytest pkg", "pkg"): ('cd "pkg" && pytest pkg', "pkg", 0),
        ("pytest top.py", "pkg"): ("pytest top.py", ".", 0),
        ("pytest pkg/tests/none.py ../x.py word", "pkg"): ('cd "pkg" && pytest pkg/tests/none.py ../x.py word', "pkg", 0),
        ("python -m mypy pkg/tests/test_a.py", "pkg"): ('cd "pkg" && python -m mypy pkg/tests/test_a.py', "pkg", 0),
        ("cd pkg && pytest", "pkg"): ("cd pkg && pytest", "pkg", 0),
        ("pytest pkg/tests/test_a.py", " "): ("pytest pkg/tests/test_a.py", ".", 0),
        ("pytest pkg/tests/test_a.py", None): ("pytest pkg/tests/test_a.py", ".", 0),
        ("", "pkg"): ("", "pkg", 0),
        (None, "pkg"): (None, "pkg", 0),
    }
    rows = [(i, *k) for i, k in enumerate(asked)] + [(0, *next(iter(asked)))]
    c = spark.createDataFrame(rows, "command_id long, command string, workspace string")
    got = [(r.command_id, (r.command, r.workspace, r.rebased)) for r in commands.route_commands(c, files).collect()]
    assert sorted(got, key=str) == sorted(((i, asked[(x, y)]) for i, x, y in rows), key=str)
    assert commands.route_commands(c.limit(0), files).count() == 0 and commands.route_commands(c, files.limit(0)).count() == len(rows)


def test_commands_are_cut_once(spark):
    """Where words are cut in the plan: for the targets and for the commands that change, not again in filters and lambdas."""
    c = spark.createDataFrame([("1", 'pytest "./a/b c.py::x" a/', "a"), ("2", 'pytest "./a/b c.py::x" a/', "a"), ("3", "pytest .\\a\\t.py ././a//", "a")], "command_id string, command string, workspace string")
    out = commands.route_commands(c, spark.createDataFrame([("a/b c.py",), ("a/t.py",)], "path string"))
    assert {r.command_id: (r.command, r.rebased) for r in out.collect()} == {"1": ("cd \"a\" && pytest 'b c.py::x' .", 2), "2": ("cd \"a\" && pytest 'b c.py::x' .", 2), "3": ('cd "a" && pytest t.py .', 2)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_words_as_a_shell_cuts_them(spark):
    import shlex

    said = ["pytest -k 'a b' c", 'python "x y"/z\'w\'  q', "one", "  two   three ", "a'b c'd"]
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", commands.words(F.col("s")).alias("w"))
    assert {r.s: r.w for r in df.collect()} == {s: shlex.split(s) for s in said}
    odd = ["plain", "it's", "a b", "$x", "é", "a@b:c,d=e%f+g/h.i-j_k"]
    df = spark.createDataFrame([(s,) for s in odd], "s string").select("s", commands.quoted(F.col("s")).alias("q"))
    assert {r.s: r.q for r in df.collect()} == {s: shlex.quote(s) for s in odd}


def test_gate_of_packs(spark):
    """Ranks cut before blanks go, scores of all files, bounds, and packs without anything."""
    top = spark.createDataFrame([(1, 1, " a ", 0.12345678, ["r", " "] * 10), (1, 2, " ", 9.0, None), (1, 3, "b", None, None), (1, 4, "a", 0.5, []), (1, 5, "late", 0.25, [])], "pack_id long, rank int, path string, score double, reasons array<string>")
    shown = spark.createDataFrame([(1, 1, "late", 0, -3, " s ", "x"), (1, 2, "a", 4, 2, None, " \n\t"), (1, 3, "none", None, None, None, "y"), (1, 4, "a", 1, 1, "", "cut")], "pack_id long, rank int, path string, line_start int, line_end int, symbol string, content string")
    plans = spark.createDataFrame([(1, ["t", " "], None, "why")], "pack_id long, target_tests array<string>, target_checks array<string>, reason string")
    packs = spark.createDataFrame([(1,), (2,), (2,)], "pack_id long")
    a, b = verify.plan_and_gate(packs, top, shown, plans, 4, 3).orderBy("pack_id").collect()
    assert [tuple(f) for f in a.affected_files] == [(1, "a", 0.5, ["r"] * 8), (3, "b", 0.0, []), (4, "a", 0.5, [])] and a.scope_files_hint == ["a", "b", "a"]
    assert [tuple(s) for s in a.minimal_snippets] == [("late", 1, 1, "s", "x", 0.25), ("none", 1, 1, "", "y", 0.0)]
    assert (a.target_tests, a.target_checks, a.selected_tests_count, a.selected_checks_count, a.selection_reason) == (["t"], [], 1, 0, "why")
    assert (b.affected_files, b.minimal_snippets, b.target_tests, b.scope_files_hint, b.selection_reason) == ([], [], [], [], "")
    least = verify.plan_and_gate(packs, top, shown, plans, 0, -5).orderBy("pack_id").first()
    assert len(least.affected_files) == len(least.minimal_snippets) == 1
