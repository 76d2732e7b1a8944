"""Extraction of symbols, references and dependencies from source text.

Python sources are parsed with the standard ``ast`` module in ``mapInArrow`` tasks, all three
relations in one pass; TypeScript and JavaScript are read line by line with native expressions.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import lines

MOST = 24
IDENT = "[A-Za-z_$][A-Za-z0-9_$]*"
# Words before a parenthesis that aren't calls.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "function", "return"]
ROW = (
    "file string, relation string, symbol string, kind string, qualified_name string, scope string, scope_depth int, line_start int, line_end int, signature string, return_type string, "
    "parameters array<string>, decorators array<string>, bases array<string>, relation_targets array<string>, attributes array<string>, target string, edge_type string, confidence double"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(c.split(" ")[0], _KINDS[c.split(" ")[1]]) for c in ROW.split(", ")])


def _unique(items) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))[:MOST]


def _source(node: ast.AST | None) -> str:
    """A node's source; empty if there is none or it is nested too deep."""
    try:
        return ast.unparse(node) if node else ""
    except RecursionError:
        return ""


def _callee(node: ast.expr) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def _names(target: ast.expr) -> list[str]:
    """Names that an assignment's target binds, those within tuples and lists too."""
    if isinstance(target, ast.Name):
        return [target.id]
    if isinstance(target, ast.Starred):
        return _names(target.value)
    return [n for x in target.elts for n in _names(x)] if isinstance(target, ast.Tuple | ast.List) else []


def _parameters(a: ast.arguments) -> list[str]:
    star = [f"*{a.vararg.arg}"] if a.vararg else []
    return [x.arg for x in [*a.posonlyargs, *a.args]] + star + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])


def _symbols(tree: ast.Module, file: str) -> Iterator[dict]:
    """Classes, functions, methods, and variables outside functions, with their dotted scope; blocks of any kind are gone into."""
    stack = [(node, (), ()) for node in reversed(list(ast.iter_child_nodes(tree)))]
    while stack:
        node, scope, kinds = stack.pop()
        base = {"file": file, "relation": "symbol", "scope": ".".join(scope), "scope_depth": len(scope), "line_start": getattr(node, "lineno", 1), "line_end": getattr(node, "end_lineno", None) or getattr(node, "lineno", 1)}
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            decorators = _unique(_source(x) for x in node.decorator_list)
            row = base | {"symbol": node.name, "qualified_name": ".".join((*scope, node.name)), "decorators": decorators}
            attributes = ["decorated"] if decorators else []
            if isinstance(node, ast.ClassDef):
                kind, bases = "class", _unique(_source(b) for b in node.bases)
                row |= {"bases": bases, "relation_targets": bases, "signature": f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"}
            else:
                kind = "method" if kinds[-1:] == ("class",) else "function"
                params, back = _parameters(node.args), _source(node.returns)
                is_async = isinstance(node, ast.AsyncFunctionDef)
                attributes = ["async"] * is_async + attributes + ["bound_to_class"] * (kind == "method")
                row |= {"parameters": _unique(params), "return_type": back, "signature": f"{'async ' * is_async}def {node.name}({', '.join(params)})" + (f" -> {back}" if back else "")}
            yield row | {"kind": kind, "attributes": attributes}
            stack += [(x, (*scope, node.name), (*kinds, kind)) for x in reversed(list(ast.iter_child_nodes(node)))]
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            if not set(kinds) & {"function", "method"}:
                said = _source(node.annotation) if isinstance(node, ast.AnnAssign) else ""
                for name in _unique(n for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) for n in _names(t)):
                    yield base | {"symbol": name, "kind": "variable", "qualified_name": ".".join((*scope, name)), "return_type": said, "signature": f"{name}: {said}" if said else name}
        else:
            stack += [(x, scope, kinds) for x in reversed(list(ast.iter_child_nodes(node)))]


def _links(tree: ast.Module, file: str) -> Iterator[dict]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and (name := _callee(node.func)):
            yield {"file": file, "relation": "reference", "target": name, "edge_type": "call", "line_start": node.lineno, "confidence": 0.8}
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield {"file": file, "relation": "dependency", "target": a.name, "edge_type": "import", "line_start": node.lineno, "confidence": 1.0}
        elif isinstance(node, ast.ImportFrom):
            yield {"file": file, "relation": "dependency", "target": "." * node.level + (node.module or ""), "edge_type": "from_import", "line_start": node.lineno, "confidence": 1.0}


def python_rows(file: str, text: str | None) -> list[dict]:
    """All rows of one source; none if it can't be parsed or is nested too deep."""
    try:
        tree = ast.parse(text or "")
        return [*_symbols(tree, file), *_links(tree, file)]
    except (SyntaxError, ValueError, RecursionError):
        return []


def extract_python(files: DataFrame, path: str = "file", text: str = "text", max_mb: float = 10.0) -> DataFrame:
    """Symbols, references and dependencies (column ``relation``) of Python sources, one pass.

    A source over ``max_mb`` gives one row of relation ``error``; one that can't be parsed gives none.
    Symbols are distinct by qualified name, kind and lines; a line_end before its line_start is lifted to it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for file, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if source is not None and 4 * len(source) > max_mb * (1 << 20) and len(source.encode("utf-8", "surrogatepass")) > max_mb * (1 << 20):
                    rows.append({"file": file, "relation": "error", "symbol": "file_too_large", "line_start": 1, "line_end": 1})
                    continue
                found = {(r.get("qualified_name"), r.get("kind"), r["line_start"], r.get("line_end"), r.get("target"), i if r["relation"] != "symbol" else 0): r for i, r in enumerate(python_rows(file, source))}
                rows += found.values()
            yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()

    return files.select(path, text).mapInArrow(of, ROW)


def ts_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    """Symbols of TypeScript and JavaScript sources: the first rule that fits a line wins."""
    rules = [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({IDENT})"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({IDENT})"), ("interface", rf"^\s*(?:export\s+)?interface\s+({IDENT})"), ("alias", rf"^\s*(?:export\s+)?type\s+({IDENT})"), ("variable", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({IDENT})")]
    kinds = {"interface": "type", "alias": "type"}
    rows = files.select(key, F.posexplode(lines(text)).alias("n", "line"))
    name = F.coalesce(*[F.nullif(F.regexp_extract("line", rx, 1), F.lit("")) for _, rx in rules])
    kind = F.coalesce(*[F.when(F.regexp_like("line", F.lit(rx)), F.lit(kinds.get(k, k))) for k, rx in rules])
    heritage = F.regexp_replace(F.regexp_extract("line", r"\b(?:extends|implements)\s+([^{]*)", 1), r"\bimplements\b", ",")
    targets = F.slice(F.array_distinct(F.filter(F.transform(F.split(heritage, ","), lambda x: F.regexp_replace(F.trim(x), "<.*$", "")), lambda x: x != "")), 1, MOST)
    generic = F.slice(F.filter(F.transform(F.split(F.regexp_extract("line", r"^[^<(={]*<([^>]*)>", 1), ","), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST)
    return rows.withColumns({"symbol": name, "kind": kind}).where("symbol is not null").select(key, "symbol", "kind", (F.col("n") + 1).cast("long").alias("line"), F.substring(F.trim(F.regexp_replace("line", r"\s+", " ")), 1, 240).alias("signature"), targets.alias("relation_targets"), generic.alias("type_parameters"))


def ts_calls(files: DataFrame, key: str, text: str) -> DataFrame:
    """Calls in TypeScript and JavaScript sources: key, target, line."""
    rows = files.select(key, F.posexplode(lines(text)).alias("n", "line"))
    calls = rows.select(key, (F.col("n") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))).alias("target"))
    return calls.where(~F.col("target").isin(NOT_CALLS)).select(key, "target", "line")


def ts_dependencies(files: DataFrame, key: str, text: str) -> DataFrame:
    """Imports and requires of TypeScript and JavaScript sources: key, target, edge_type."""
    found = lambda rx, kind: files.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(1))).alias("target"), F.lit(kind).alias("edge_type"))
    return found(r"""import\s+[^'";]*?from\s+['"]([^'"]+)['"]""", "import").union(found(r"""require\(\s*['"]([^'"]+)['"]\s*\)""", "require"))


def extract_files(files: DataFrame, max_mb: float = 10.0) -> DataFrame:
    """Rows of all sources by their language, with ``lang``; files: path, lang, text. Other languages give none.

    A source over ``max_mb`` (bytes) gives one row of relation ``error`` in either half.
    """
    python = extract_python(files.where("lang = 'python'").select(F.col("path").alias("file"), "text"), max_mb=max_mb).withColumn("lang", F.lit("python"))
    scripts = files.where(F.col("lang").isin("typescript", "javascript")).select(F.struct(F.col("path").alias("file"), "lang").alias("of"), "text", (F.octet_length("text") > int(max_mb * (1 << 20))).alias("large"))
    small = scripts.where("large IS NOT TRUE")
    kinds = dict(c.split(" ") for c in ROW.split(", "))

    def shaped(df: DataFrame, relation: str, **made: Column) -> DataFrame:
        made |= {"file": F.col("of.file"), "relation": F.lit(relation)}
        return df.select(*[made.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], F.col("of.lang").alias("lang"))

    line = F.col("line")
    parts = [
        shaped(ts_symbols(small, "of", "text"), "symbol", symbol=F.col("symbol"), kind=F.col("kind"), qualified_name=F.col("symbol"), scope=F.lit(""), scope_depth=F.lit(0), line_start=line, line_end=line, signature=F.col("signature"), relation_targets=F.col("relation_targets")),
        shaped(ts_calls(small, "of", "text"), "reference", target=F.col("target"), edge_type=F.lit("call"), line_start=line, confidence=F.lit(0.5)),
        shaped(ts_dependencies(small, "of", "text"), "dependency", target=F.col("target"), edge_type=F.col("edge_type"), confidence=F.lit(1.0)),
        shaped(scripts.where("large"), "error", symbol=F.lit("file_too_large"), line_start=F.lit(1), line_end=F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, [python, *parts])
