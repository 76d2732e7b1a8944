"""JSON contracts and canonical hashes, inside the JVM: VARIANT values and expressions, no Python per row.

A schema (a subset of JSON Schema: type, enum, minLength, minimum, minItems, items, required, properties,
additionalProperties) is compiled into one expression that lists a value's violations. Integers beyond 64
bits and numbers with an exponent count as ``number``, not ``integer``. An object's keys come in their sorted
order. A text that isn't JSON, or has a key twice, has the one violation ``$ invalid JSON``; null texts have none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 20  # violations that are reported one by one
# Modes of a contract and other names for them.
MODES = ("off", "warn", "strict")
MODE_NAMES = {"enforce": "strict", "error": "strict", "errors": "strict", "on": "warn", "default": "warn"}


def mode_of(value: str | None, default: str = "warn") -> str:
    """A contract's mode by any of its names; the default, or ``warn``, for others."""
    for said in (value or default, default):
        name = str(said).strip().lower()
        name = MODE_NAMES.get(name, name)
        if name in MODES:
            return name
    return "warn"


def kind_of(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null."""
    return _kind(F.schema_of_variant(v))


def _kind(s: Column) -> Column:
    return F.when(F.startswith(s, F.lit("OBJECT")), "object").when(F.startswith(s, F.lit("ARRAY")), "array").when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")


def _is(kind: Column, wanted: Any) -> Column:
    names = [str(w).strip().lower() for w in (wanted if isinstance(wanted, list) else [wanted]) if isinstance(w, str)]
    if not names or set(names) - {"object", "array", "string", "integer", "number", "boolean", "null"}:
        return F.lit(True)  # an unknown type forbids nothing
    return kind.isin([*names, *(["integer"] if "number" in names else [])])


def _step(key: str) -> str:
    if "'" in key:
        raise ValueError(f"a property with a quote isn't supported: {key}")
    return f"$['{key}']"


def _shown(value: Any) -> str:
    return f"'{value}'" if isinstance(value, str) else {True: "true", False: "false", None: "null"}.get(value, str(value)) if value is None or isinstance(value, bool) else str(value)


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: written into an expression of a lambda, it would be computed wherever it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def violations(v: Column, schema: dict[str, Any], path: str | Column = "$") -> Column:
    """What a value breaks of a schema: an array of messages, in the schema's order. v: a VARIANT, not null."""
    at = F.lit(path) if isinstance(path, str) else path

    def facts(x: Column) -> Column:
        v, kind = x["v"], x["kind"]
        out = {"v": v, "kind": kind}
        if "enum" in schema or "minLength" in schema:
            out["text"] = F.when(kind.isin("string", "boolean"), F.try_variant_get(v, "$", "string"))
        if "enum" in schema or "minimum" in schema:
            out["number"] = F.when(kind.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
        if "items" in schema or "minItems" in schema:
            out["items"] = F.when(kind == "array", F.try_variant_get(v, "$", "array<variant>"))
        return F.struct(*[c.alias(n) for n, c in out.items()])

    seen = F.struct(v.alias("v"), F.schema_of_variant(v).alias("s"))
    return _bound(seen, lambda x: _bound(F.struct(x["v"].alias("v"), _kind(x["s"]).alias("kind")), lambda y: _bound(facts(y), lambda f: _broken(f, schema, at))))


def _present(schema: dict[str, Any], at: Column) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNotNull(), violations(x, schema, at)).otherwise(F.array().cast("array<string>"))


def _broken(f: Column, schema: dict[str, Any], at: Column) -> Column:
    """``violations`` by a value's facts: v, kind and what the schema reads of text, number and items."""
    v, kind = f["v"], f["kind"]
    say = lambda bad, *text: F.when(bad, F.concat(at, *[F.lit(t) if isinstance(t, str) else t for t in text]))
    marks: list[Column] = []
    parts: list[Column] = []
    if isinstance(enum := schema.get("enum"), list):
        text, number = f["text"], f["number"]
        strings, numbers = [e for e in enum if isinstance(e, str)], [float(e) for e in enum if _number(e)]
        ok = (kind == "string") & text.isin(strings) if strings else F.lit(False)
        ok = ok | (kind.isin("integer", "number") & number.isin(numbers) if numbers else F.lit(False))
        ok = ok | ((kind == "boolean") & text.isin([str(e).lower() for e in enum if isinstance(e, bool)])) if any(isinstance(e, bool) for e in enum) else ok
        ok = ok | (kind == "null") if None in enum else ok
        marks.append(say(~F.coalesce(ok, F.lit(False)), " enum mismatch: ", F.when(kind == "string", F.concat(F.lit("'"), text, F.lit("'"))).otherwise(F.to_json(v)), f" not in [{', '.join(map(_shown, enum))}]"))
    if isinstance(low := schema.get("minLength"), int):
        n = F.char_length(f["text"])
        marks.append(say((kind == "string") & (n < low), " minLength violation: ", n.cast("string"), f" < {low}"))
    if _number(low := schema.get("minimum")):
        marks.append(say(kind.isin("integer", "number") & (f["number"] < float(low)), " minimum violation: ", F.to_json(v), f" < {low}"))
    is_array, is_object = kind == "array", kind == "object"
    if isinstance(low := schema.get("minItems"), int):
        marks.append(say(is_array & (F.size(f["items"]) < low), " minItems violation: ", F.size(f["items"]).cast("string"), f" < {low}"))
    none = F.array().cast("array<string>")
    if isinstance(sub := schema.get("items"), dict):
        each = F.transform(f["items"], lambda x, i: violations(x, sub, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.when(is_array, F.flatten(each)).otherwise(none))
    if isinstance(required := schema.get("required"), list):
        missing = [F.when(F.try_variant_get(v, _step(k), "variant").isNull(), F.concat(at, F.lit(f".{k} missing required field"))) for k in required if isinstance(k, str)]
        if missing:
            parts.append(F.when(is_object, F.array_compact(F.array(*missing))).otherwise(none))
    if isinstance(properties := schema.get("properties"), dict):
        for key, sub in properties.items():
            if isinstance(sub, dict):
                parts.append(F.when(is_object, _bound(F.try_variant_get(v, _step(key), "variant"), _present(sub, F.concat(at, F.lit(f".{key}"))))).otherwise(none))
        if schema.get("additionalProperties") is False:
            keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
            more = F.filter(keys, lambda k: ~k.isin(list(properties)) if properties else F.lit(True))
            parts.append(F.when(is_object, F.transform(more, lambda k: F.concat(at, F.lit("."), k, F.lit(" additionalProperties not allowed")))).otherwise(none))
    every = F.concat(F.array_compact(F.array(*marks)) if marks else none, *parts) if parts else F.array_compact(F.array(*marks)) if marks else none
    if (wanted := schema.get("type")) is not None:
        said = wanted if isinstance(wanted, str) else "[" + ", ".join(f"'{w}'" for w in wanted) + "]"
        mismatch = F.array(F.concat(at, F.lit(f" type mismatch: expected {said}, got "), kind))
        return F.when(_is(kind, wanted), every).otherwise(mismatch)
    return every


def enforce(rows: DataFrame, column: str, schema: dict[str, Any], label: str, mode: str | None = "warn", most: int = MOST) -> DataFrame:
    """rows with ``warnings`` and ``repair_count`` by a contract on a column of JSON text.

    ``off`` checks nothing. ``warn`` gives up to ``most`` messages and one that counts the others, and as many repairs as
    messages. ``strict`` fails the query at the first row with a violation.
    """
    none = F.array().cast("array<string>")
    mode = mode_of(mode)
    if mode == "off":
        return rows.withColumns({"warnings": none, "repair_count": F.lit(0)})
    v = F.col("_json")
    found = F.when(F.col(column).isNull(), none).when(v.isNull(), F.array(F.lit("$ invalid JSON"))).otherwise(violations(v, schema))
    said = lambda m: F.concat(F.lit(f"{label} schema violation: "), m)
    marked = rows.withColumn("_json", F.try_parse_json(F.col(column))).withColumn("_found", found).drop("_json")
    if mode == "strict":
        first = F.when(F.size("_found") > 0, F.raise_error(said(F.get("_found", F.lit(0)))))
        return marked.withColumn("warnings", F.coalesce(first.cast("array<string>"), none)).withColumn("repair_count", F.size("warnings")).drop("_found")
    more = F.size("_found") - most
    shown = F.transform(F.slice("_found", 1, most), said)
    full = F.when(more > 0, F.array_append(shown, said(F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))))).otherwise(shown)
    return marked.withColumn("warnings", full).withColumn("repair_count", F.size("warnings")).drop("_found")


def canonical(json: str | Column) -> Column:
    """A JSON text with the keys of all its objects sorted, without blanks, decimal numbers without final zeros; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(F.col(json) if isinstance(json, str) else json))


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a structure's canonical JSON: the same for any order of fields, at any depth. Nulls are kept."""
    return F.sha2(F.to_json(F.to_variant_object(value)), 256)


def task_signature(task_tokens: str | Column, hint_tokens: str | Column) -> Column:
    """Hash of a task's and its hints' tokens (arrays; in order, each once)."""
    tidy = lambda c: F.array_distinct(F.filter(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return canonical_hash(F.struct(tidy(task_tokens).alias("task_tokens"), tidy(hint_tokens).alias("hint_tokens")))


def changed_fingerprint(changed: str | Column) -> Column:
    """Hash of changed files (an array): slashes forward, trimmed, lower-case, each once in their order."""
    tidy = F.transform(F.col(changed) if isinstance(changed, str) else changed, lambda x: F.lower(F.trim(F.replace(x, F.lit("\\"), F.lit("/")))))
    return canonical_hash(F.struct(F.array_distinct(F.filter(tidy, lambda x: x != "")).alias("changed_files")))
