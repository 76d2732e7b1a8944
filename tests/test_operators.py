"""Fixtures with exact expected values for the reference's operators."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import budget, extract, graph, jobs, rank, relations, snippets, state, symbols

SYM = "symbol string, qualified_name string, kind string, file string, line_start int, line_end int"


def test_match_tiers(spark):
    rows = [("Foo", "a.Foo"), ("x", "foo"), ("foobar", "q"), ("z", "foo.q"), ("afoo", "q"), ("z", "q.foo.r"), ("z", "q")]
    df = spark.createDataFrame(rows, "s string, q string").select(symbols.match_score(" FOO ", "s", "q"))
    assert [r[0] for r in df.collect()] == [1.0, 0.9, 0.7, 0.5, 0.3, 0.2, 0.0]


def test_search_and_callers(spark):
    rows = [("compile_context_pack", "cc.compile_context_pack", "function", "cc.py", 100, 150), ("build_candidate_files", "planner.build_candidate_files", "function", "planner.py", 50, 80), ("compileTemplate", "utils.compileTemplate", "function", "t.ts", 10, 25), ("Store", "s.Store", "class", "s.py", 20, 100)]
    df = spark.createDataFrame(rows, SYM)
    got = symbols.search(df, "compile", ["nonsense"], ["function", "class"]).collect()
    assert [r.symbol for r in got] == ["compile_context_pack", "compileTemplate"] and got[0].score == 0.7
    assert symbols.search(df, "s", ["class"], ["function", "class"]).count() == 1
    refs = spark.createDataFrame([("tool", "compile_context_pack"), ("main", "cc.compile_context_pack"), ("tool", "compile_context_pack")], "source_symbol string, target_symbol string")
    r = symbols.called_by(df, refs).first()
    assert (r.symbol, r.n_callers, r.callers) == ("compile_context_pack", 2, ["main", "tool"])


def test_score_of_a_file(spark):
    """Nine signals: 0.816111 for the fixture."""
    t = ["payment", "processor", "retry"]
    files = spark.createDataFrame([("p.py",), ("other.py",)], "file string")
    rows = [("PaymentProcessor", "core.PaymentProcessor", "class PaymentProcessor extends BaseProcessor", ["BaseProcessor", "RetryPolicy"], "class", "p.py", 10, 80), ("run_retry", "core.PaymentProcessor.run_retry", "def run_retry(payment_id: str) -> bool", None, "method", "p.py", 90, 110)]
    sy = spark.createDataFrame(rows, "symbol string, qualified_name string, signature string, relation_targets array<string>, kind string, file string, line_start int, line_end int")
    refs = spark.createDataFrame([("p.py", "run_retry", "retry"), ("p.py", "run_retry", "processor")], "file string, source_symbol string, target_symbol string")
    deps = spark.createDataFrame([("p.py", "payment.models")], "edge_from string, edge_to string")
    tests = spark.createDataFrame([("t.py", "p.py")], "test_file string, owns_file string")
    got = {r.file: r for r in rank.score_files(files, sy, refs, deps, tests, t, ["p.py"]).collect()}
    r = got["p.py"]
    assert r.score == 0.816111 and r.s_structural == pytest.approx(2 / 3.6) and r.s_syntax_unit == 0.5
    assert r.reasons == ["symbol_match", "signature_match", "reference_proximity", "dependency_impact", "structural_match", "syntax_unit_coverage", "test_relevance", "changed_file"]
    assert got["other.py"].score == 0 and got["other.py"].reasons == ["baseline"]
    near = spark.createDataFrame([("other.py", 0.7)], "file string, proximity double")
    assert {r.file: r.score for r in rank.score_files(files, sy, refs, deps, tests, t, [], near).collect()} == {"p.py": 0.696111, "other.py": 0.07}


def test_relation_graph_and_proximity(spark):
    e = spark.createDataFrame([("c", "a", 1.0), ("c", "a", 0.8), ("c", "b", 0.9), ("a", "a", 5.0)], "src string, dst string, weight double")
    g = graph.relation_graph(e)
    assert {(r.src, r.dst): r.weight for r in g.collect()} == {("c", "a"): 1.0, ("c", "b"): 0.5}
    back = graph.proximity(spark.createDataFrame([("s", "x", 0.7)], "src string, dst string, weight double"), spark.createDataFrame([("s",)], "node string"))
    assert back.first().proximity == pytest.approx(0.21)


def test_reach_and_levels_with_a_cycle(spark):
    g = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src int, dst int")
    s = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.level) for r in graph.reachable(g, s).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {(r.node, r.level) for r in graph.levels(g, s, 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_inheritance_and_dependencies(spark):
    rows = [("BaseModel", "BaseModel", []), ("UserModel", "m.UserModel", ["BaseModel"]), ("AdminModel", "m.AdminModel", ["m.UserModel"]), ("IRepository", "IRepository", ["Protocol"]), ("UserRepository", "UserRepository", ["IRepository"])]
    links, roots = graph.inheritance(spark.createDataFrame(rows, "symbol string, qualified_name string, bases array<string>"))
    assert {r.symbol for r in roots.collect()} == {"BaseModel", "IRepository"} and links.count() == 3
    e = spark.createDataFrame([("repo.py", "i.py"), ("repo.py", "user.py"), ("main.py", "repo.py"), ("repo.py", "user.py")], "src string, dst string")
    got = {r.file: (r.imports, r.imported_by) for r in graph.dependencies_both(e).collect()}
    assert got["repo.py"] == (["i.py", "user.py"], ["main.py"]) and got["i.py"] == ([], ["repo.py"])


def test_resolved_dependencies(spark):
    paths = ["src/a.py", "src/auth.py", "src/auth/login.py", "src/pkg/__init__.py", "src/pkg/b.py", "web/x.ts", "web/lib/y.ts", "web/lib/index.ts", "src/frontend/src/app/z.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = [("src/a.py", "src.pkg.b.thing", {"src/pkg/b.py", "src/pkg/__init__.py"}), ("src/a.py", "src.auth.login", {"src/auth/login.py", "src/auth.py"}), ("web/x.ts", "./lib/y", {"web/lib/y.ts"}), ("web/x.ts", "./lib", {"web/lib/index.ts"}), ("web/lib/y.ts", "../x", {"web/x.ts"}), ("src/pkg/b.py", "..auth", {"src/auth.py"}), ("src/pkg/b.py", ".", {"src/pkg/__init__.py"}), ("src/pkg/b.py", "src/a.py", {"src/a.py"}), ("web/x.ts", "@/app/z", {"src/frontend/src/app/z.ts"}), ("src/a.py", "nowhere", set())]
    for source, to, want in rows:
        e = spark.createDataFrame([(source, to)], "edge_from string, edge_to string")
        assert {r.target for r in graph.resolve_dependencies(e, files).collect()} == want, to


def test_relation_links(spark):
    sym = spark.createDataFrame([("Service", "svc.Service", ["Base"], "svc.py"), ("Base", "core.Base", [], "core.py"), ("run", "main.run", None, "main.py")], "symbol string, qualified_name string, relation_targets array<string>, file string")
    refs = spark.createDataFrame([("main.py", "Service"), ("main.py", "Service"), ("core.py", "Base")], "file string, target_symbol string")
    deps = spark.createDataFrame([("main.py", "svc"), ("svc.py", ".core")], "edge_from string, edge_to string")
    files = spark.createDataFrame([("svc.py",), ("core.py",), ("main.py",)], "path string")
    got = {(r.src, r.dst): r.w for r in relations.relation_links(sym, refs, deps, files).groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("w")).collect()}
    assert got == {("main.py", "svc.py"): 2.8, ("svc.py", "core.py"): 1.5, ("core.py", "svc.py"): 1.0}
    g = graph.relation_graph(relations.relation_links(sym, refs, deps, files))
    nodes, links = relations.call_graph(g, spark.createDataFrame([("main.py",)], "node string"), 1, "down", sym)
    assert {(r.node, r.level, r.symbol_count) for r in nodes.collect()} == {("main.py", 0, 1), ("svc.py", 1, 1), ("core.py", 2, 1)} and links.count() == 2
    c = relations.candidate_files(sym, refs, deps, spark.createDataFrame([], "test_file string, owns_file string"), ["svc.py"])
    assert [(r.path, r.changed) for r in c.collect()] == [("svc.py", True), ("core.py", False), ("main.py", False)]
    seeds = relations.seed_files(c, ["svc.py"], ["cor"])
    assert {r.node for r in seeds.collect()} == {"svc.py", "core.py"}
    placed = c.withColumn("place", F.col("path"))
    assert [r.path for r in relations.expand_candidates(placed, g, spark.createDataFrame([("svc.py",)], "node string")).collect()] == ["svc.py", "core.py", "main.py"]


def test_inheritance_tree_with_a_cycle(spark):
    rows = [("Root", "m.Root", []), ("A", "m.A", ["Root", "C"]), ("B", "m.B", ["m.A"]), ("C", "m.C", ["b"]), ("IRepo", "IRepo", ["Protocol"])]
    tree = relations.inheritance_tree(spark.createDataFrame(rows, "symbol string, qualified_name string, bases array<string>")).collect()
    assert {(r.root, r.node, r.depth, r.circular) for r in tree} == {("m.Root", "m.Root", 0, False), ("m.Root", "m.A", 1, False), ("m.Root", "m.B", 2, False), ("m.Root", "m.C", 3, False), ("m.Root", "m.A", 4, True), ("IRepo", "IRepo", 0, False)}


def test_symbol_context_and_tests(spark):
    text = "\n".join(f"line {i}" for i in range(1, 31))
    sym = spark.createDataFrame([("pay", "core.pay", "core.py", 10, 12), ("main", "app.main", "app.py", 2, 3), ("check", "u.check", "u.py", 1, 1), ("test_pay", "t.test_pay", "tests/test_core.py", 5, 6)], "symbol string, qualified_name string, file string, line_start int, line_end int")
    refs = spark.createDataFrame([("main", "pay"), ("pay", "check")], "source_symbol string, target_symbol string")
    texts = spark.createDataFrame([(f, text) for f in ("core.py", "app.py", "u.py", "tests/test_core.py")], "file string, text string")
    got = [(r.type, r.name, r.file, r.line_start, r.line_end) for r in relations.symbol_context(sym, refs, texts, "pay").collect()]
    assert got == [("definition", "pay", "core.py", 5, 17), ("usage", "main", "app.py", 1, 6), ("callee", "check", "u.py", 1, 4), ("test", "test_pay", "tests/test_core.py", 2, 9)]


def test_impact(spark):
    texts = spark.createDataFrame([("a.py", "x"), ("b.py", "import A_mod.a"), ("c.py", "nothing here")], "path string, text string")
    none = spark.createDataFrame([], "edge_from string, target string")
    assert {r.node for r in relations.impacted_files(none, ["a_mod/a.py"], texts).collect()} == {"a_mod/a.py", "b.py"} | {"c.py", "a.py"} - {"a.py", "c.py"} | set()
    chain = spark.createDataFrame([(f"f{i + 1}", f"f{i}") for i in range(12)], "edge_from string, target string")
    assert relations.impacted_files(chain, ["f0"]).count() == 13
    with pytest.raises(RuntimeError):
        graph.reachable(chain.select(F.col("target").alias("src"), F.col("edge_from").alias("dst")), spark.createDataFrame([("f0",)], "node string"), max_rounds=5)


def test_patterns(spark):
    schema = "symbol string, qualified_name string, kind string, file string, line_start int, scope string, attributes array<string>, parameters array<string>, decorators array<string>, return_type string"
    rows = [("ConfigManager", "ConfigManager", "class", "c.py", 1, "", ["_instance"], [], [], ""), ("get_instance", "ConfigManager.get_instance", "method", "c.py", 2, "ConfigManager", [], [], [], ""), ("QueryBuilder", "QueryBuilder", "class", "q.py", 1, "", [], [], [], ""), ("build", "QueryBuilder.build", "method", "q.py", 3, "QueryBuilder", [], [], [], ""), ("with_a", "QueryBuilder.with_a", "method", "q.py", 4, "QueryBuilder", [], [], [], ""), ("log_calls", "log_calls", "function", "d.py", 1, "", [], ["func"], ["functools.wraps(func)"], ""), ("create_user", "create_user", "function", "f.py", 1, "", [], [], [], "User"), ("UserFactory", "UserFactory", "class", "f.py", 9, "", [], [], [], ""), ("EventEmitter", "EventEmitter", "class", "e.py", 1, "", [], [], [], ""), ("subscribe", "EventEmitter.subscribe", "method", "e.py", 2, "EventEmitter", [], [], [], ""), ("notify", "EventEmitter.notify", "method", "e.py", 3, "EventEmitter", [], [], [], ""), ("DataProcessor", "DataProcessor", "class", "p.py", 1, "", [], [], [], "")]
    df = spark.createDataFrame(rows, schema)
    got = [(r.pattern, r.symbol, r.confidence) for r in symbols.patterns(df).collect()]
    assert got == [("builder", "QueryBuilder", 1.0), ("decorator", "log_calls", 0.9), ("singleton", "ConfigManager", 0.8), ("factory", "UserFactory", 0.8), ("factory", "create_user", 0.8), ("observer", "EventEmitter", 0.7)] or {*got} == {("builder", "QueryBuilder", 1.0), ("decorator", "log_calls", 0.9), ("singleton", "ConfigManager", 0.8), ("factory", "UserFactory", 0.8), ("factory", "create_user", 0.8), ("observer", "EventEmitter", 0.7)}
    assert {r.pattern for r in symbols.patterns(df, ["nothing"]).collect()} == {r[0] for r in got}
    assert {r.pattern for r in symbols.patterns(df, ["factory"]).collect()} == {"factory"}


def test_ownership_and_shards(spark):
    files = spark.createDataFrame([("src/auth.py",), ("src/other.py",), ("tests/test_auth.py",), ("src/tests/deep.py",)], "path string")
    deps = spark.createDataFrame([("tests/test_auth.py", " OTHER.py ")], "edge_from string, edge_to string")
    got = {(r.test_file, r.owns_file, r.source) for r in symbols.ownership(files, deps).collect()}
    assert got == {("tests/test_auth.py", "src/auth.py", "naming"), ("tests/test_auth.py", "src/other.py", "import")}
    items = spark.createDataFrame([("g", i) for i in range(5)], "g string, i int")
    assert [(r.shard, r.shards) for r in symbols.shards(items, "g", "i", 2, 9).orderBy("i").collect()] == [(0, 3), (1, 3), (2, 3), (0, 3), (1, 3)]


def test_merge_on_read(spark):
    base = spark.createDataFrame([("a.py", "func1"), ("b.py", "func2")], "file string, symbol string")
    op = lambda rows: spark.createDataFrame(rows, "file string, symbol string, op string, seq int")
    read = lambda ops: {(r.file, r.symbol) for r in state.merge_on_read(base, ops, "file", "seq").collect()}
    assert read(op([("a.py", None, "delete", 1)])) == {("b.py", "func2")}
    assert read(op([("a.py", None, "delete", 1), ("a.py", "x", "set", 2), ("a.py", "y", "set", 2)])) == {("b.py", "func2"), ("a.py", "x"), ("a.py", "y")}
    diff = state.diff_state(base, spark.createDataFrame([("b.py", "new"), ("c.py", "z")], "file string, symbol string"), "file", ["symbol"])
    assert {(r.file, r.state) for r in diff.collect()} == {("a.py", "removed"), ("b.py", "changed"), ("c.py", "added")}


def test_budget(spark):
    """Refactor task, 5 tokens, 4 changed files, spread 0.8."""
    df = spark.range(1).select(budget.intent(F.lit("Refactor the thing")).alias("i"), budget.complexity(F.lit(5), F.lit(4), F.lit(0.8)).alias("c"))
    r = df.select("i", F.round("c", 4).alias("c"), *[v.alias(k) for k, v in budget.budget(F.col("i"), F.col("c")).items()]).first()
    assert (r.i, r.c, r.max_chars, r.max_snippets, r.top_n_files, r.snippet_radius) == ("refactor", 0.3471, 28001, 67, 14, 46)


def test_text(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\r\nb\rc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.lines("t")).collect()] == [["a", "b"], ["a", "b", "c"], [], None]
    got = spark.range(1).select(T.task_tokens(F.lit("Fix the PAYMENT retry_2, payment")), T.fingerprint(F.lit(" A\t b ")) == T.fingerprint(F.lit("a B")), T.structural_signature(F.lit("Foo = 12 + bar3")), T.jaccard(F.array(), F.array(), 1.0)).first()
    assert list(got) == [["payment", "retry_2"], True, "id = num + id", 1.0]
    d = spark.createDataFrame([(1, "l1\nl2\nl3\nneedle\nl5")], "k int, t string")
    r = snippets.snippet_window(d, "k", "t", ["needle"], 1).first()
    assert (r.line_start, r.line_end, r.content) == (3, 5, "l3\nneedle\nl5")
    long = spark.createDataFrame([("x" * 500,)], "c string").select(snippets.truncate("c", 120)).first()[0]
    assert len(long) == 120 and "\n...\n" in long


def test_extraction(spark):
    src = "import os\nfrom ..x import y\nVALUE: int = 3\n@dec\nclass Worker(BaseWorker):\n    a = 1\n    @wraps\n    async def run(self, n: int) -> str:\n        inner = go(n)\n        return inner\n"
    rows = extract.extract_python(spark.createDataFrame([("w.py", src), ("bad.py", "def ("), ("none.py", None)], "file string, text string")).collect()
    s = {r.qualified_name: r for r in rows if r.relation == "symbol"}
    assert set(s) == {"VALUE", "Worker", "Worker.a", "Worker.run"} and s["Worker.run"].kind == "method" and s["Worker.run"].signature == "async def run(self, n) -> str" and s["Worker.run"].decorators == ["wraps"] and s["Worker"].bases == ["BaseWorker"]
    assert {(r.target, r.edge_type) for r in rows if r.relation == "dependency"} == {("os", "import"), ("..x", "from_import")} and [r.target for r in rows if r.relation == "reference"] == ["go"]
    ts = "export class Service<T> extends Base implements Runner {\ninterface Runner extends Job {\nconst a = require('m'); if (x) f(1)\nimport { z } from './z'\n"
    t = spark.createDataFrame([(1, ts)], "k int, t string")
    got = {r.symbol: (r.kind, r.relation_targets, r.type_parameters) for r in extract.ts_symbols(t, "k", "t").collect()}
    assert got == {"Service": ("class", ["Base", "Runner"], ["T"]), "Runner": ("type", ["Job"], []), "a": ("variable", [], [])}
    assert {(r.target, r.line) for r in extract.ts_calls(t, "k", "t").collect()} == {("require", 3), ("f", 3)}
    assert {(r.target, r.edge_type) for r in extract.ts_dependencies(t, "k", "t").collect()} == {("./z", "import"), ("m", "require")}


def test_extraction_of_each_kind_alone(spark):
    """Files with imports only, symbols only, calls only, and blocks of every kind."""
    one = lambda src: extract.extract_python(spark.createDataFrame([("f.py", src)], "file string, text string")).collect()
    assert [(r.relation, r.target) for r in one("import os\n")] == [("dependency", "os")]
    assert [(r.symbol, r.kind) for r in one("a, (b, *c) = 1, (2, 3)\n")] == [("a", "variable"), ("b", "variable"), ("c", "variable")]
    assert [r.target for r in one("go(1)\n")] == ["go"]
    src = "def f():\n    class K:\n        a = 1\n        @dec\n        def m(self): pass\nmatch x:\n    case 1:\n        y = 2\n    case _:\n        def g(): pass\ntry:\n    pass\nexcept* ValueError:\n    z = 3\nasync def h():\n    async with q:\n        class W: pass\n"
    got = {r.qualified_name: (r.kind, r.attributes) for r in one(src) if r.relation == "symbol"}
    assert got == {"f": ("function", []), "f.K": ("class", []), "f.K.m": ("method", ["decorated", "bound_to_class"]), "y": ("variable", None), "g": ("function", []), "z": ("variable", None), "h": ("function", ["async"]), "h.W": ("class", [])}
    big = extract.extract_python(spark.createDataFrame([("f.py", "x" * 200)], "file string, text string"), max_mb=0.0001).collect()
    assert [(r.relation, r.symbol) for r in big] == [("error", "file_too_large")]
    ts = extract.ts_symbols(spark.createDataFrame([(1, "export type Pair<A, B> = [A, B]")], "k int, t string"), "k", "t").first()
    assert (ts.symbol, ts.kind, ts.type_parameters) == ("Pair", "type", ["A", "B"])


def test_sessions(spark):
    """Each rule of a session's log: conflicts, leases that run out, read-only attaches, closes."""
    made = {
        # a lease that has run out isn't prolonged, whoever asks; opening again gives a new one
        "late": [("open", 0, "r", "x", "l1", 60, None, None), ("heartbeat", 59, None, None, "l1", None, None, None), ("heartbeat", 1000, None, None, "l1", None, None, None), ("attach", 1001, "r", "y", "l2", None, False, None), ("open", 1002, "r", "y", "l3", 5, None, None)],
        # a live lease is kept from others, not from its owner; another run never gets in
        "live": [("open", 0, "r", "x", "l1", 600, None, None), ("attach", 1, "r", "y", "l2", None, False, None), ("attach", 2, "q", "x", "l2", None, False, None), ("open", 2, "q", "x", "l9", 60, None, None), ("attach", 3, "r", "x", "l2", None, False, None), ("heartbeat", 4, None, None, "l1", None, None, None)],
        # without saying so an attach is read-only; no session, no run, no lease
        "odd": [("attach", 0, "r", "x", "l", None, None, None), ("heartbeat", 0, None, None, "l", None, None, None), ("close", 0, None, None, None, None, None, None), ("open", 0, " ", "x", "l", None, None, None), ("open", 1, "r", None, "l", 10**9, None, None), ("attach", 2, "r", "y", "m", None, None, None), ("heartbeat", 2, None, None, "", None, None, None)],
        # after a close the lease is free
        "shut": [("open", 0, "r", "x", "l", 60, None, None), ("close", 1, None, None, None, None, None, "strange"), ("close", 2, None, None, None, None, None, " Cancelled"), ("heartbeat", 3, None, None, "l", None, None, None), ("attach", 4, "r", "y", "m", None, False, None)],
    }
    rows = [(k, i, *x) for k, log in made.items() for i, x in enumerate(log)]
    log = spark.createDataFrame(rows, "session_id string, seq int, op string, at long, run_id string, actor string, lease_id string, ttl_seconds long, readonly boolean, final_status string").withColumn("at", F.timestamp_seconds("at"))
    got = {r.session_id: (r.status, r.owner, r.lease_owner, r.lease_id, r.lease_until, r.ttl, r.errors) for r in jobs.replay_sessions(log).collect()}
    assert got == {
        "late": ("open", "y", "y", "l3", 1032, 30, ["E_SESSION_EXPIRED", "E_SESSION_EXPIRED"]),
        "live": ("active", "x", "x", "l2", 603, 600, ["E_SESSION_CONFLICT"] * 4),
        "odd": ("open", "codex", "codex", "l", 86401, 86400, ["E_SESSION_NOT_FOUND"] * 3 + ["E_INVALID_STATE"] * 2),
        "shut": ("active", "x", "y", "m", 64, 60, ["E_INVALID_STATE", "E_SESSION_CONFLICT"]),
    }


def test_small_job_operators(spark):
    files = spark.createDataFrame([("package.json",), ("web/app/package.json",), ("web/node_modules/z/package.json",), ("a/b/c/d/e/package.json",)], "path string")
    spaces = jobs.workspaces(files, ["package.json"])
    assert [(r.rel, r.depth) for r in spaces.collect()] == [(".", 0), ("web/app", 2)]
    changed = spark.createDataFrame([(1, "web/app/x.ts"), (1, "web/y.ts"), (2, "lib/z.py")], "set_id int, path string")
    assert {(r.set_id, r.rel, r.files) for r in jobs.route(changed, spaces).collect()} == {(1, "web/app", 1), (2, ".", 0)}
    c = spark.createDataFrame([("cd web && npm run test:unit",)], "command string").select(*[v.alias(k) for k, v in jobs.command_parts().items()]).first()
    assert (c.last, c.folder, c.module, c.script, c.targets) == ("npm run test:unit", "web", None, "test:unit", [])
    one = spark.range(1)
    assert one.select(jobs.pytest_command(F.array(F.lit("t/a.py"), F.lit("t/b c.py")))).first()[0] == 'python -m pytest -q t/a.py "t/b c.py"'
    presets = one.select(*[jobs.verify_preset(F.lit(p), F.lit(e), F.lit(f)).alias(str(i)) for i, (p, e, f) in enumerate([("FAST", True, False), ("x", True, True), (None, False, True), ("", None, None)])]).first()
    assert list(presets) == ["fast", "full", "fast", "default"]
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    up = jobs.upsert(base, spark.createDataFrame([("b", 3, "new"), ("b", 2, "old"), ("c", 1, "z")], "k string, at int, v string"), "k", "at")
    assert {(r.k, r.v) for r in up.collect()} == {("a", "x"), ("b", "new"), ("c", "z")}
    assert {r.k for r in jobs.delete(up, spark.createDataFrame([("b",)], "k string"), "k").collect()} == {"a", "c"}
    r = spark.createDataFrame([("s", "r", "t", "ok", 1, 7), ("s", "q", "t", "ok", 2, 8)], "session_id string, run_id string, tool string, status string, ts int, job_id int")
    assert [x.job_id for x in jobs.list_receipts(r, session="s", limit=0).collect()] == [8] and [x.job_id for x in jobs.list_receipts(r, run="r").collect()] == [7]


def slow_compress(content, max_chars, tokens, symbol):
    """The five rules line by line."""
    n = {"i": 0, "c": 0, "b": 0}
    if not symbol and tokens and len(content) > 1200 and not any(t in content.lower() for t in tokens):
        return "", (0, 0, 0, 1, 0)
    kept, run, was, hit, full = [], 0, "", 0, 0
    for line in (x.rstrip(" ") for x in content.splitlines()):
        s = line.strip(" ")
        full += s != ""
        hit += s != "" and any(t in line.lower() for t in tokens)
        kind = "b" if not s else "i" if s.startswith(("import ", "from ")) and "(" not in s and ")" not in s else "c" if s.startswith(("#", "//", "/*", "*", '"""', "'''")) else "o"
        run = run + 1 if kind == was else 1
        was = kind
        if kind != "o" and run > {"i": 12, "c": 8, "b": 1}[kind]:
            n[kind] += 1
        else:
            kept.append(line)
    kept += [f"# ... [omitted {n[k]} {w} lines]" for k, w in (("i", "import"), ("c", "comment")) if n[k]]
    out, cut = "\n".join(kept).strip("\n"), 0
    if not symbol and not hit and len(out) > 1200:
        return "", (n["i"], n["c"], n["b"], 1, 0)
    if len(out) > max_chars:
        out, cut = out[: max(0, max_chars - 16)].rstrip(" ") + "\n... [truncated]", 1
    return out or content[:max_chars], (n["i"], n["c"], n["b"], 0, cut)


def test_five_rules_of_compression(spark):
    import random

    rng, rows = random.Random(3), []
    piece = {"i": "import a.b", "I": "from x import (y)", "c": "  # say", "b": "   ", "o": "value = 1  ", "t": "the Token here"}
    for i in range(150):
        ls = [piece[k] for _ in range(rng.randrange(8)) for k in rng.choice("iIcbot") * rng.randrange(1, 20)]
        rows.append((i, "\n".join(ls) + "\n" * rng.randrange(3), rng.random() < 0.4, ["token"] if rng.random() < 0.6 else [], rng.choice([10, 200, 5000])))
    rows += [(200, "", False, [], 50), (201, "\n\n\n", False, ["x"], 50), (202, None, True, None, 5), (203, "x" * 1300, False, ["y"], 5000), (204, "x" * 1300, False, [], 5000), (205, "x" * 1300, True, ["y"], 900)]
    df = spark.createDataFrame(rows, "k int, content string, symbol boolean, tokens array<string>, most int")
    names = ["trim_import_block", "trim_comment_block", "collapse_blank_runs", "drop_low_signal", "truncate_max_chars"]
    got = {r.k: (r.compressed, tuple(r[c] for c in names), r.dropped) for r in snippets.compress(df, "content", F.col("tokens"), F.col("most"), F.col("symbol")).collect()}
    for k, content, symbol, tokens, most in rows:
        want, counts = slow_compress(content or "", most, tokens or [], symbol)
        assert got[k] == (want, counts, counts[3] == 1), rows[k] if k < 150 else k


def test_budget_overrides(spark):
    said = ["", None, " XL ", "balanced", '{"max_chars": 7, "x": 1, "top_n_files": 2}', "max_chars=5; Top_N_Files = 3", "tiny"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, said string").select("i", budget.override(F.col("said")).alias("o")).select("i", "o.*")
    got = {r.i: (r.max_chars, r.max_snippets, r.top_n_files, r.snippet_radius) for r in df.collect()}
    assert got == {0: (None,) * 4, 1: (None,) * 4, 2: (50000, 120, 20, 50), 3: (24000, 60, 12, 30), 4: (7, None, 2, None), 5: (5, None, 3, None), 6: (6000, 16, 6, 20)}
    with pytest.raises(Exception, match="unsupported budget preset"):
        spark.createDataFrame([("odd",)], "said string").select(budget.override(F.col("said"))).collect()
    one = spark.range(1).select(budget.override(F.lit("max_chars=0")).alias("o"))
    assert list(one.select(*budget.with_override({k: F.lit(9) for k in budget.BASE}, F.col("o")).values()).first()) == [1, 9, 9, 9]


def test_recovered_leases(spark):
    make = spark.createDataFrame
    r = make([(1, "s", "running", 0, "", "", "k"), (2, "s", "failed", 0, "", "", "k"), (3, "t", "queued", 0, "", "", "k"), (4, "u", "queued", 0, "", "", "k"), (5, None, "queued", 0, "", "", "k")], "job_id int, session_id string, status string, ts int, error_code string, error_message string, more string")
    s = make([("s", "active", 5, 0), ("t", "active", 10, 0), ("u", "closed", None, 0), ("v", "active", 1, 0)], "session_id string, status string, lease_until int, updated_at int")
    after, sessions, events = state.recover_expired(r, s, F.lit(10))
    assert after.columns == r.columns and {x.job_id: (x.status, x.ts, x.error_code) for x in after.collect()} == {1: ("failed", 10, "E_SESSION_EXPIRED"), 2: ("failed", 0, ""), 3: ("queued", 0, ""), 4: ("queued", 0, ""), 5: ("queued", 0, "")}
    assert {(x.session_id, x.status, x.updated_at) for x in sessions.collect()} == {("s", "expired", 10), ("t", "active", 0), ("u", "closed", 0), ("v", "active", 0)}
    assert [(x.job_id, x.from_status, x.to_status) for x in events.collect()] == [(1, "running", "failed")]
    with pytest.raises(ValueError):
        state.recover_expired(r, s, F.lit(10), "odd")


def test_paths_of_a_status(spark):
    rows = spark.createDataFrame([(" M a\\b.py ",), ("R  old -> new name",), ("??",), (None,), ("A  x",)], "l string")
    assert [r[0] for r in rows.select(jobs.status_path("l")).collect()] == ["a/b.py", "new name", "", "", "x"]
