"""Extraction queries: scripts in pages, and Python sources that Spark writes from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import extract
from corvane.session import table


BLOCK = 200


def _sources(spark, d):
    """Python modules by brand and block of parts: a class for each part type with a method for each part, an import for each type."""
    file = F.concat("p_brand", F.lit("/m"), F.floor(F.col("p_partkey") / BLOCK), F.lit(".py"))
    p = table(spark, d, "part").select(file.alias("file"), "p_type", "p_partkey", F.regexp_replace("p_name", " ", "_").alias("n"))
    method = F.concat(F.lit("    def "), "n", F.lit("_"), "p_partkey", F.lit("(self, size):\n        return make(size)\n"))
    cls = p.groupBy("file", "p_type").agg(F.concat_ws("", F.array_sort(F.collect_list(method))).alias("body"))
    cls = cls.select("file", F.concat(F.lit("import os."), F.lower("p_type"), F.lit("\nfrom ..parts."), F.lower("p_type"), F.lit(" import make\n")).alias("i"), F.concat(F.lit("class "), "p_type", F.lit("(Base):\n    kind: str = 'x'\n"), "body").alias("c"))
    head = F.concat(F.concat_ws("", F.array_sort(F.collect_list("i"))), F.lit("LIMIT = 3\n"), F.concat_ws("", F.array_sort(F.collect_list("c"))))
    return cls.groupBy("file").agg(head.alias("text"))


def py_symbols(spark, d):
    rows = extract.extract_python(_sources(spark, d)).where("relation = 'symbol'")
    return rows.groupBy("file", "kind", "scope").agg(F.count("*").alias("n"), F.min("qualified_name").alias("first_name"), F.max(F.size("parameters")).cast("long").alias("parameters"))


def py_deps(spark, d):
    rows = extract.extract_python(_sources(spark, d)).where("relation = 'dependency'")
    return rows.select("file", "target", "edge_type")


def py_calls(spark, d):
    rows = extract.extract_python(_sources(spark, d)).where("relation = 'reference'")
    return rows.groupBy("file", "target").agg(F.count("*").alias("calls"))


def ts_symbols(spark, d):
    """Declarations in the scripts of pages, a statement a line."""
    scripts = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<script>(.*?)</script>", 1), ";", ";\n").alias("text"))
    return extract.ts_symbols(scripts, "page_id", "text").select("page_id", "symbol", "kind", "line", "signature")


def ts_calls(spark, d):
    scripts = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<script>(.*?)</script>", 1).alias("text"))
    return extract.ts_calls(scripts, "page_id", "text")


QUERIES = {f.__name__: f for f in (py_symbols, py_deps, py_calls, ts_symbols, ts_calls)}
_FILE = f"p_brand || '/m' || p_partkey // {BLOCK} || '.py'"
_SCRIPT = "regexp_extract(html, '<script>(.*?)</script>', 1)"
ORACLE = {
    "py_symbols": f"""WITH p AS (SELECT {_FILE} AS file, p_type, replace(p_name, ' ', '_') || '_' || p_partkey AS m FROM part)
        SELECT file, 'method' AS kind, p_type AS scope, count(*) AS n, min(p_type || '.' || m) AS first_name, 2::BIGINT AS parameters FROM p GROUP BY ALL
        UNION ALL SELECT file, 'class', '', count(DISTINCT p_type), min(p_type), NULL FROM p GROUP BY file
        UNION ALL SELECT file, 'variable', p_type, 1, p_type || '.kind', NULL FROM p GROUP BY file, p_type UNION ALL SELECT DISTINCT file, 'variable', '', 1, 'LIMIT', NULL::BIGINT FROM p""",
    "py_deps": f"SELECT DISTINCT {_FILE} AS file, unnest(['os.' || lower(p_type), '..parts.' || lower(p_type)]) AS target, unnest(['import', 'from_import']) AS edge_type FROM part",
    "py_calls": f"SELECT {_FILE} AS file, 'make' AS target, count(*) AS calls FROM part GROUP BY 1",
    "ts_symbols": f"WITH a AS (SELECT page_id, string_split(replace({_SCRIPT}, ';', ';' || chr(10)), chr(10)) AS ls FROM pages), b AS (SELECT page_id, generate_subscripts(ls, 1)::BIGINT AS line, unnest(ls) AS t FROM a) SELECT page_id, regexp_extract(t, '^\\s*var ([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS symbol, 'variable' AS kind, line, left(trim(regexp_replace(t, '\\s+', ' ', 'g')), 240) AS signature FROM b WHERE regexp_matches(t, '^\\s*var [A-Za-z_$]')",
    "ts_calls": f"WITH a AS (SELECT page_id, unnest(regexp_extract_all({_SCRIPT}, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS target FROM pages) SELECT page_id, target, 1::BIGINT AS line FROM a WHERE target NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function', 'return')",
}
