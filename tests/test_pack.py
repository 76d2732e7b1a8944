"""The whole context pack on a small corpus."""

from corvane.functions import text as T
from corvane.operators import pack

TASK = "fix the payment refund crash"
CODE = "import os\n\ndef refund(payment):\n    return payment\n"
FILES = {"src/pay.py": CODE, "src/copy.py": CODE.replace("os", "OS"), "src/other.py": "alpha = 1\nbeta = 2\n", "lib/far.py": "gamma delta epsilon zeta\n", "lib/blank.py": "  \n", "src/near.py": "x = 3\nrefund_total = x\ny = 4\n"}


def corpus(spark, names=tuple(FILES)):
    files = spark.createDataFrame([(f,) for f in names], "path string")
    sym = [("src/pay.py", 1, "refund", "pay.refund", 3, 4), ("src/copy.py", 1, "refund", "copy.refund", 3, 4), ("src/other.py", 1, "alpha", "other.alpha", 1, 1)]
    symbols = spark.createDataFrame([s for s in sym if s[0] in names], "file string, place int, symbol string, qualified_name string, line_start int, line_end int")
    refs = spark.createDataFrame([r for r in [("src/near.py", 1, "refund", "near"), ("src/other.py", 1, "nothing", None)] if r[0] in names], "file string, place int, target_symbol string, source_symbol string")
    deps = spark.createDataFrame([], "edge_from string, place int, edge_to string")
    tests = spark.createDataFrame([r for r in [("t/test_pay.py", "src/pay.py", 1)] if r[1] in names], "test_file string, owns_file string, place int")
    texts = spark.createDataFrame([(f, FILES[f]) for f in names], "file string, text string")
    return files, symbols, refs, deps, tests, texts


def test_pack(spark):
    ranked, taken, b = pack.compile_pack(TASK, *corpus(spark), changed=["lib/far.py"], hints=["near"], structural=2.0)
    order = [r.file for r in ranked.orderBy("rank").collect()]
    assert order[:2] == ["lib/far.py", "src/pay.py"] and set(order) == set(FILES)
    assert b["per_snippet_max_chars"] == max(800, min(6000, int(b["max_chars"] / b["top_n_files"] * 2)))
    got = {r.file: r for r in taken.collect()}
    # The copy has the same symbol's lines, so it is a repeat; a blank file gives nothing.
    assert set(got) == {"lib/far.py", "src/pay.py", "src/other.py", "src/near.py"} and got["src/pay.py"].repeats == 1
    assert got["src/pay.py"].content == "def refund(payment):\n    return payment" and (got["src/pay.py"].line_start, got["src/pay.py"].line_end) == (3, 4)
    assert max(r.used for r in got.values()) == sum(len(r.content) for r in got.values())


def test_selection_by_both_rules(spark):
    rows = [(f"f{i}", i, 1, 1, 1, c) for i, c in enumerate(["one two three", "One  two three", "four five six", "seven " * 40, "eight nine", "", "ten eleven twelve thirteen fourteen"], 1)]
    cut = spark.createDataFrame(rows, "file string, rank int, line_start int, line_end int, raw_chars int, content string")
    got = [(r.file, r.used, r.repeats) for r in pack.select_snippets(cut, 60, 3).orderBy("rank").collect()]
    # Shapes: "id id id" has the one identifier "id", as every text of words has: all after the first are alike in shape.
    assert got == [("f1", 13, 5)]
    # By identifiers only: f2 equals f1, f4 is too long for what is left, three are taken.
    got = [(r.file, r.used, r.repeats) for r in pack.select_snippets(cut, 60, 3, structural=2.0).orderBy("rank").collect()]
    assert got == [("f1", 13, 1), ("f3", 26, 1), ("f5", 36, 1)]


def test_empty(spark):
    ranked, taken, b = pack.compile_pack("", *corpus(spark, ()))
    assert ranked.count() == 0 and taken.count() == 0 and b["max_snippets"] > 0
    assert T.py_task_tokens("") == []
