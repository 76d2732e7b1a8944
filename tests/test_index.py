"""Incremental index: two scans equal a full build, replayed batches change nothing, removed files go."""

import pytest

from corvane.operators import extract, index

PY = "import os\nfrom .util import run\n\nclass A(Base):\n    def go(self):\n        run(1)\n"
TS = 'import { x } from "./lib";\nexport class Page extends View {\n  const y = call(1);\n}\n'
FIRST = [("a.py", 1, 10, "python", PY), ("gone.py", 1, 5, "python", "def old(): pass\n"), ("tests/test_a.py", 1, 4, "python", "import a.py\n"), ("page.ts", 1, 9, "typescript", TS), ("data.bin", 1, 1, None, "zz")]
SECOND = [("a.py", 2, 12, "python", PY + "\ndef more(): return go()\n"), ("new.js", 1, 3, "javascript", "function f() { g(); }\n"), ("tests/test_a.py", 1, 4, "python", "import a.py\n"), ("page.ts", 1, 9, "typescript", "unseen change, same time and size"), ("data.bin", 1, 1, None, "zz")]
SCHEMA = "path string, mtime long, size long, lang string, text string"


def content(store):
    return {t: sorted(map(repr, store.read(t).collect())) for t in store.tables}


@pytest.fixture
def stores(spark, tmp_path):
    return [index.index_store(spark, f"file://{tmp_path}/{n}", 3) for n in "ab"]


def test_two_scans_equal_a_full_build(spark, stores):
    step, whole = stores
    first, second = (spark.createDataFrame(x, SCHEMA) for x in (FIRST, SECOND))
    assert index.update(step, first)["changed"] == 5
    done = index.update(step, second)
    assert (done["changed"], done["removed"]) == (2, 1)
    kept = [r if r[0] != "page.ts" else FIRST[3] for r in SECOND]  # its time and size are the same
    index.update(whole, spark.createDataFrame(kept, SCHEMA), full=True)
    a, b = content(step), content(whole)
    a.pop("states"), b.pop("states")
    assert a == b
    assert {r.path for r in step.read("states").collect()} == {r[0] for r in SECOND}
    names = {(r.file, r.symbol) for r in step.read("symbols").collect()}
    assert {("a.py", "more"), ("a.py", "A"), ("page.ts", "Page"), ("new.js", "f")} <= names and not any(f == "gone.py" for f, _ in names)
    assert [(r.edge_from, r.edge_to) for r in step.read("dependencies").where("edge_from = 'page.ts'").collect()] == [("page.ts", "./lib")]


def test_nothing_new_changes_nothing_and_compaction(spark, stores):
    store = stores[0]
    first = spark.createDataFrame(FIRST, SCHEMA)
    before = index.update(store, first, compact_every=10_000)
    again = index.update(store, first, compact_every=10_000)
    assert again["version"] == before["version"] and again["changed"] == 0
    was = content(store)
    assert index.update(store, first, compact_every=1)["compacted"] and max(store.pending().values()) == 0 and content(store) == was
    row = index.manifest(store).first()
    assert (row.files, row.source_bytes, row.pending) == (5, 29, 0)
    assert index.update(store, spark.createDataFrame([], SCHEMA))["removed"] == 5 and all(not x for x in content(store).values())


def test_ownership_of_the_index(spark, stores):
    index.update(stores[0], spark.createDataFrame(FIRST, SCHEMA))
    got = {(r.test_file, r.owns_file, r.source) for r in index.test_ownership(stores[0]).collect()}
    assert got == {("tests/test_a.py", "a.py", "naming"), ("tests/test_a.py", "a.py", "import")}


def test_stream_of_scans(spark, stores, tmp_path):
    step, whole = stores
    scans = str(tmp_path / "scans")
    add = lambda n, rows: spark.createDataFrame([(n, *r) for r in rows], index.SCAN.replace("scan long", "scan int")).withColumn("scan", __import__("pyspark").sql.functions.col("scan").cast("long")).coalesce(1).write.mode("append").parquet(scans)
    run = lambda store: index.follow(spark.readStream.schema(index.SCAN).option("maxFilesPerTrigger", 1).parquet(scans), store, "scans", str(tmp_path / "checkpoint")).awaitTermination()
    add(1, FIRST)
    run(step)
    one = step.version()
    add(2, SECOND)
    run(step)
    assert step.version() > one
    index.update(whole, spark.createDataFrame(FIRST, SCHEMA))
    index.update(whole, spark.createDataFrame(SECOND, SCHEMA))
    assert content(step) == content(whole)
    # A batch that comes again after a failure is passed over, whatever it holds.
    version = step.version()
    assert index.update(step, spark.createDataFrame(FIRST, SCHEMA), app="scans", batch=1)["skipped"] and step.version() == version


def test_deep_and_large_sources(spark):
    deep = "def g() -> " + "+".join(["x"] * 3000) + ": pass\nclass C: pass\n"
    files = spark.createDataFrame([("deep.py", "python", deep), ("l.py", "python", "é" * 30), ("l.ts", "typescript", "é" * 30), ("n.py", "python", None), ("n.ts", "typescript", None)], "path string, lang string, text string")
    rows = extract.extract_files(files, max_mb=0.00005).collect()
    assert {(r.file, r.symbol) for r in rows if r.relation == "error"} == {("deep.py", "file_too_large"), ("l.py", "file_too_large"), ("l.ts", "file_too_large")}
    rows = extract.extract_files(files).collect()
    assert {r.symbol for r in rows if r.file == "deep.py" and r.relation == "symbol"} in ({"g", "C"}, set())
