from pyspark.sql import functions as F

from corvane.sources import files


def test_scan(spark, tmp_path):
    root = tmp_path / "proj"
    for name, text in {"a.py": "x = 1\n", "src/b.ts": "let y\n", "node_modules/c.js": "z", "notes.txt": "n", "big.py": "#" * 3000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = files.scan_files(spark, str(root), exclude=["big*"]).collect()
    assert [(r.path, r.lang, r.size, r.text) for r in got] == [("a.py", "python", 6, "x = 1\n"), ("src/b.ts", "typescript", 6, "let y\n")]
    assert [r.path for r in files.scan_files(spark, str(root), ["*.py"], max_mb=0.001).collect()] == ["a.py"]
    assert [r.path for r in files.scan_files(spark, str(root), max_files=1).collect()] == ["a.py"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"file": "a", "n": 1}\n\nnot json\n[1]\n{"file": "b"}\n')
    assert sorted((r.file, r.n) for r in files.read_jsonl(spark, str(p), "file string, n int").collect()) == [("a", 1), ("b", None)]
    assert files.count_lines(spark, str(p)) == 5


def test_relation_with_ops(spark, tmp_path):
    base, ops = str(tmp_path / "base"), str(tmp_path / "ops")
    files.write_table(spark.createDataFrame([("a", "f1"), ("b", "f2")], "file string, symbol string"), base)
    files.append_ops(spark.createDataFrame([("a", None, "delete", 1)], "file string, symbol string, op string, seq int"), ops)
    files.append_ops(spark.createDataFrame([("c", "f3", "set", 2)], "file string, symbol string, op string, seq int"), ops)
    assert [tuple(r) for r in files.read_relation(spark, base, ops, "file").collect()] == [("b", "f2"), ("c", "f3")]
    assert files.compact(spark, base, ops, "file") is None
    new = files.compact(spark, base, ops, "file", every=2)
    assert [tuple(r) for r in files.read_relation(spark, new, None, "file").collect()] == [("b", "f2"), ("c", "f3")]
    files.write_documents(spark.read.parquet(new), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2


def test_paths(spark):
    df = spark.createDataFrame([("  .\\src\\A.PY",), ("./././x",)], "p string")
    assert [r[0] for r in df.select(files.normalized_path("p")).collect()] == ["src/A.PY", "././x"]
    assert [r[0] for r in df.select(F.coalesce(files.language("p"), F.lit("-"))).collect()] == ["python", "-"]
    assert [bool(r[0]) for r in df.select(files.matches_any("p", ["*src*PY", "q?"])).collect()] == [True, False]
