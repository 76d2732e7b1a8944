"""Contracts against a plain validator of the same subset; canonical hashes against json.dumps."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import contracts as co

SCHEMA = {
    "type": "object", "required": ["id", "items"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2},
        "mode": {"enum": ["fast", "full", 3, None, True]},
        "score": {"type": "number", "minimum": 0.5},
        "n": {"type": ["integer", "null"], "minimum": 1},
        "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}}}, "additionalProperties": False}},
        "free": {"type": "something"},
    },
}
VALUES = [
    {"id": "ab", "items": [{"k": 1}]}, {"id": "a", "items": [], "x": 1, "A": 2}, {"items": [{"k": 1.5}, {"tags": ["", "b", 3]}, 7, {"k": 2, "z": None}]}, {"id": 5, "items": {}, "mode": "slow", "score": 0.25, "n": 0},
    {"id": "abc", "items": [{"k": 1}], "mode": 3, "score": 1, "n": None, "free": [1]}, {"id": "abc", "items": [{"k": 1}], "mode": True, "score": True, "n": 1.5}, {"id": "abc", "items": [{"k": 1}], "mode": None, "score": "1"}, [], "s", None, 3, {"id": None, "items": None, "mode": False},
]
KINDS = {dict: "object", list: "array", str: "string", int: "integer", float: "number", bool: "boolean", type(None): "null"}


def slow(v, s, path="$"):
    kind, out = KINDS[type(v)], []
    if "type" in s:
        wanted = s["type"] if isinstance(s["type"], list) else [s["type"]]
        if set(wanted) <= set(KINDS.values()) and kind not in wanted and not (kind == "integer" and "number" in wanted):
            return [f"{path} type"]
    if "enum" in s and not any(type(e) in (type(v), *((int, float) if type(v) in (int, float) else ())) and e == v for e in s["enum"]):
        out.append(f"{path} enum")
    if kind == "string" and len(v) < s.get("minLength", 0):
        out.append(f"{path} minLength")
    if kind in ("integer", "number") and "minimum" in s and v < s["minimum"]:
        out.append(f"{path} minimum")
    if kind == "array":
        if len(v) < s.get("minItems", 0):
            out.append(f"{path} minItems")
        for i, x in enumerate(v):
            out += slow(x, s["items"], f"{path}[{i}]") if "items" in s else []
    if kind == "object":
        out += [f"{path}.{k} missing" for k in s.get("required", []) if k not in v]
        for k, sub in s.get("properties", {}).items():
            out += slow(v[k], sub, f"{path}.{k}") if k in v else []
        if s.get("additionalProperties") is False:
            out += [f"{path}.{k} additionalProperties" for k in sorted(v) if k not in s["properties"]]
    return out


def test_same_as_a_plain_validator(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, j string")
    got = {r.i: (r.warnings, r.repair_count) for r in co.enforce(rows, "j", SCHEMA, "pack").collect()}
    for i, v in enumerate(VALUES):
        said, n = got[i]
        assert [" ".join(m.removeprefix("pack schema violation: ").split(" ")[:2]) for m in said] == slow(v, SCHEMA) and n == len(said)


def test_modes(spark):
    rows = spark.createDataFrame([("{}",), (None,), ("{",), ('{"a":1,"a":2}',)], "j string")
    assert [r.warnings for r in co.enforce(rows, "j", SCHEMA, "pack", "Off").collect()] == [[]] * 4
    warned = [r.warnings for r in co.enforce(rows, "j", SCHEMA, "pack", "on").collect()]
    assert warned == [["pack schema violation: $.id missing required field", "pack schema violation: $.items missing required field"], [], *[["pack schema violation: $ invalid JSON"]] * 2]
    with pytest.raises(Exception, match="schema violation"):
        co.enforce(rows, "j", SCHEMA, "pack", "errors").collect()
    assert co.enforce(rows.limit(0), "j", SCHEMA, "pack", "strict").count() == 0
    many = spark.createDataFrame([(json.dumps({"id": "ab", "items": [{}] * 25}),)], "j string")
    row = co.enforce(many, "j", SCHEMA, "pack").first()
    assert row.repair_count == 21 and row.warnings[-1] == "pack schema violation: +5 more"
    assert [co.mode_of(x) for x in (None, "STRICT ", "odd", "default")] == ["warn", "strict", "warn", "warn"] and co.mode_of("odd", "error") == "strict"


def test_canonical_hashes(spark):
    a = {"b": [1, {"z": None, "y": "é\n"}], "a": {"k": 2.5, "c": True}, "A": ""}
    text = json.dumps(a, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows = spark.createDataFrame([(json.dumps(a),), (json.dumps(dict(reversed(a.items())), indent=2),)], "j string")
    assert [r[0] for r in rows.select(co.canonical("j")).collect()] == [text] * 2
    x, y = spark.sql("SELECT named_struct('b', 1, 'a', map('z', 1.5D, 'k', 2.25D), 'e', cast(null AS int)) AS x, named_struct('e', cast(null AS int), 'a', map('k', 2.25D, 'z', 1.5D), 'b', 1) AS y").select(co.canonical_hash(F.col("x")), co.canonical_hash(F.col("y"))).first()
    assert x == y == hashlib.sha256(json.dumps({"a": {"k": 2.25, "z": 1.5}, "b": 1, "e": None}, separators=(",", ":")).encode()).hexdigest()
    t = spark.createDataFrame([(["Rank ", "", "rank", "x"], [], ["d\\B.py", "", "a.py", " A.py "])], "t array<string>, h array<string>, c array<string>").select(co.task_signature("t", "h"), co.changed_fingerprint("c")).first()
    hashed = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert list(t) == [hashed({"task_tokens": ["rank", "x"], "hint_tokens": []}), hashed({"changed_files": ["d/b.py", "a.py"]})]


def test_a_value_is_read_once(spark):
    """The kind of a value is told once for all its checks, however deep it lies: else each level reads all below it again."""
    rows = spark.createDataFrame([(1, "{}")], "i int, j string")
    plan = co.enforce(rows, "j", SCHEMA, "pack")._jdf.queryExecution().optimizedPlan().toString()
    values = 11  # of the schema: itself, six properties, items, k, tags and a tag
    assert 1 <= plan.count("schemaOfVariant") <= values and plan.count("parseJson(") == 1
