"""The index kept up to date over two scans of sources that Spark writes from the tables.

Parts are functions of Python modules by brand and block, suppliers are TypeScript files that import and
call them. The first scan lacks the parts of even size and has a file for each nation that goes later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.operators import index
from corvane.session import table
from corvane.sources import scan
from corvane.streaming.jobs import shared

BLOCK = 100


def _scan(spark, d, later):
    p = table(spark, d, "part").where(F.lit(later) | (F.col("p_size") % 2 == 1))
    brand = F.concat(F.lit("b"), F.substring("p_brand", 7, 2))
    module = F.concat(F.lit("src/"), brand, F.lit("/m"), F.floor(F.col("p_partkey") / BLOCK), F.lit(".py"))
    text = F.concat(F.lit("def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey", F.lit("(size):\n    return make(size)\n"))
    python = p.select(module.alias("path"), text.alias("t")).groupBy("path").agg(F.concat(F.lit("from .parts import make\n"), F.concat_ws("", F.array_sort(F.collect_list("t")))).alias("text")).withColumn("lang", F.lit("python"))
    uses = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(p.select("p_partkey", brand.alias("b")), F.col("l_partkey") == F.col("p_partkey"))
    lines = F.concat(F.concat_ws("", F.array_sort(F.collect_set(F.concat(F.lit("import { make } from './src/"), "b", F.lit("';\n"))))), F.concat_ws("", F.array_sort(F.collect_list(F.concat(F.lit("p_"), "p_partkey", F.lit("(1);\n"))))))
    scripts = uses.groupBy(F.concat(F.lit("app/s"), "l_suppkey", F.lit(".ts")).alias("path")).agg(lines.alias("text")).withColumn("lang", F.lit("typescript"))
    files = python.unionByName(scripts)
    if not later:
        old = table(spark, d, "nation").select(F.concat(F.lit("old/n"), "n_nationkey", F.lit(".py")).alias("path"), F.lit("def gone():\n    pass\n").alias("text"), F.lit("python").alias("lang"))
        files = files.unionByName(old)
    return files.select("path", F.crc32("text").alias("mtime"), F.octet_length("text").cast("long").alias("size"), "lang", "text")


def index_update(spark, d):
    """All rows of the index after two updates, then after its compaction."""
    store = index.index_store(spark, f"{shared(spark)}/index-{uuid.uuid4().hex}")
    index.update(store, _scan(spark, d, False))
    index.update(store, _scan(spark, d, True), compact_every=1)
    rows = [
        store.read("symbols").select(F.lit("symbol").alias("relation"), "file", F.col("symbol").alias("name"), F.col("line_start").cast("long").alias("line")),
        store.read("references").select(F.lit("reference"), "file", "target_symbol", F.col("line").cast("long")),
        store.read("dependencies").select(F.lit("dependency"), F.col("edge_from"), "edge_to", F.lit(0).cast("long")),
    ]
    return rows[0].union(rows[1]).union(rows[2])


def index_stream(spark, d):
    """Counts of the index by file, from a stream of the same scans."""
    root = f"{shared(spark)}/index-{uuid.uuid4().hex}"
    store = index.index_store(spark, f"{root}/store")
    for n, later in ((1, False), (2, True)):
        _scan(spark, d, later).select(F.lit(n).cast("long").alias("scan"), "*").coalesce(1).write.mode("append").parquet(f"{root}/scans")
    scans = spark.readStream.schema(index.SCAN).option("maxFilesPerTrigger", 1).parquet(f"{root}/scans")
    index.follow(scans, store, "scans", f"{root}/checkpoint").awaitTermination()
    count = lambda t, key: store.read(t).groupBy(F.col(key).alias("path")).agg(F.count("*").alias(t))
    out = store.read("states").select("path", "size")
    for t, key in (("symbols", "file"), ("references", "file"), ("dependencies", "edge_from")):
        out = out.join(count(t, key), "path", "left").na.fill(0, [t])
    return out


def index_by_keys(spark, d):
    """Symbols of the modules that hold the dearest parts, from these modules' buckets only."""
    store = index.index_store(spark, f"{shared(spark)}/index-{uuid.uuid4().hex}")
    index.update(store, _scan(spark, d, True), compact_every=1)
    p = table(spark, d, "part")
    dearest = p.join(F.broadcast(p.agg(F.max("p_retailprice").alias("p_retailprice"))), "p_retailprice")  # one row
    keys = dearest.select(F.concat(F.lit("src/b"), F.substring("p_brand", 7, 2), F.lit("/m"), F.floor(F.col("p_partkey") / BLOCK), F.lit(".py")).alias("file"))
    return store.read("symbols", keys).select("file", "symbol")


def scanned_files(spark, d):
    """The sources written as files, listed by the scan and read back: those under app/ and src/b1*, and whether their texts are the same."""
    root, files = f"{shared(spark)}/files-{uuid.uuid4().hex}", _scan(spark, d, True).select("path", "text")
    scan.write_files(files, root).write.format("noop").mode("overwrite").save()
    found = scan.with_text(scan.list_files(spark, root, ["app/*", "src/b1*"]), root)
    both = found.join(files.withColumnRenamed("text", "wrote"), "path", "left")
    return both.select("path", "size", "lang", F.col("text").eqNullSafe(F.col("wrote")).alias("same"))


QUERIES = {f.__name__: f for f in (index_update, index_stream, index_by_keys, scanned_files)}
_BASE = f"""p AS (SELECT *, 'b' || substr(p_brand, 7, 2) AS b, replace(p_name, ' ', '_') || '_' || p_partkey AS fn FROM part), m AS (SELECT 'src/' || b || '/m' || p_partkey // {BLOCK} || '.py' AS file, * FROM p),
    u AS (SELECT DISTINCT 'app/s' || l_suppkey || '.ts' AS file, b, p_partkey FROM lineitem JOIN p ON l_partkey = p_partkey),
    n AS (SELECT file, fn, row_number() OVER (PARTITION BY file ORDER BY 'def ' || fn || '(') AS k FROM m),
    i AS (SELECT file, count(*) AS imports, sum(strlen(b) + 31) AS head FROM (SELECT DISTINCT file, b FROM u) GROUP BY file)"""
ORACLE = {
    "index_update": f"""WITH {_BASE}
        SELECT 'symbol' AS relation, file, fn AS name, 2 * k AS line FROM n UNION ALL SELECT 'reference', file, 'make', 2 * k + 1 FROM n
        UNION ALL SELECT 'reference', file, 'p_' || p_partkey, imports + row_number() OVER (PARTITION BY file ORDER BY 'p_' || p_partkey || '(') FROM u JOIN i USING (file)
        UNION ALL SELECT DISTINCT 'dependency', file, '.parts', 0 FROM m UNION ALL SELECT DISTINCT 'dependency', file, './src/' || b, 0 FROM u""",
    "index_stream": f"""WITH {_BASE}
        SELECT file AS path, (24 + sum(strlen(fn) + 34))::BIGINT AS size, count(*) AS symbols, count(*) AS "references", 1::BIGINT AS dependencies FROM n GROUP BY file
        UNION ALL SELECT file, (any_value(head) + sum(strlen('p_' || p_partkey) + 5))::BIGINT, 0, count(*), any_value(imports) FROM u JOIN i USING (file) GROUP BY file""",
    "scanned_files": f"""WITH {_BASE} SELECT file AS path, (24 + sum(strlen(fn) + 34))::BIGINT AS size, 'python' AS lang, true AS same FROM n WHERE file LIKE 'src/b1%' GROUP BY file
        UNION ALL SELECT file, (any_value(head) + sum(strlen('p_' || p_partkey) + 5))::BIGINT, 'typescript', true FROM u JOIN i USING (file) GROUP BY file""",
    "index_by_keys": f"WITH {_BASE} SELECT file, fn AS symbol FROM m WHERE file IN (SELECT file FROM m WHERE p_retailprice = (SELECT max(p_retailprice) FROM part))",
}
