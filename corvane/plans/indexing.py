"""Relation, import and impact queries: parts are symbols of files by type and brand, suppliers are files that use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import graph, relations
from corvane.session import table


def _part_file():
    return F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/b"), F.substring("p_brand", 7, 2), F.lit(".py"))


def _symbols(spark, d):
    p = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol"), F.lower("p_type").alias("t"), _part_file().alias("file"), "p_container" if "p_container" in table(spark, d, "part").columns else F.lit(None).cast("string").alias("p_container"), "p_partkey", "p_size")
    return p.select("symbol", F.concat_ws(".", "t", "symbol").alias("qualified_name"), "file", F.array(F.concat(F.lit("b"), F.col("p_size").cast("string"))).alias("relation_targets"), F.col("p_partkey").alias("line_start"), (F.col("p_partkey") + F.col("p_size")).alias("line_end"))


def _uses(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("file", F.concat(F.lit("app/s"), "l_suppkey", F.lit(".py")))


def _references(spark, d):
    return _uses(spark, d).select("file", F.replace("p_name", F.lit(" "), F.lit("_")).alias("target_symbol"))


def _dependencies(spark, d):
    return _uses(spark, d).where("p_size <= 2").select(F.col("file").alias("edge_from"), F.concat(F.lit("src."), F.lower("p_type"), F.lit(".b"), F.substring("p_brand", 7, 2), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("edge_to")).distinct()


def _files(spark, d):
    return table(spark, d, "part").select(_part_file().alias("path")).union(table(spark, d, "supplier").select(F.concat(F.lit("app/s"), "s_suppkey", F.lit(".py")))).distinct()


def relation_links(spark, d):
    out = relations.relation_links(_symbols(spark, d), _references(spark, d), _dependencies(spark, d), _files(spark, d))
    return out.groupBy("src", "dst").agg(F.round(F.sum("weight"), 4).alias("weight"))


def resolved_dependencies(spark, d):
    return graph.resolve_dependencies(_dependencies(spark, d), _files(spark, d))


def impacted_by_change(spark, d):
    """Files that depend on the files of one type of part, at any distance."""
    resolved = graph.resolve_dependencies(_dependencies(spark, d), _files(spark, d))
    return relations.impacted_files(resolved, ["src/promo/b8.py", "src/large/b6.py"])


def resolved_ways(spark, d):
    """Lines' dependencies written in four ways: a path, relative to the importing file, below the app's root, and a dotted name; some lead nowhere."""
    files = _files(spark, d).union(table(spark, d, "part").select(F.concat(F.lit("src/frontend/src/x"), "p_size", F.lit(".ts")))).distinct()
    way = F.when(F.col("l_linenumber") == 1, F.col("part")).when(F.col("l_linenumber") == 2, F.concat(F.lit("./s"), F.col("l_suppkey") + 1)).when(F.col("l_linenumber") == 3, F.concat(F.lit("@/x"), "p_size")).when(F.col("l_linenumber") == 4, F.concat_ws(".", F.lit("src"), F.lower("p_type"), F.concat(F.lit("b"), F.substring("p_brand", 7, 2)))).otherwise(F.concat(F.lit("nowhere/"), "p_size"))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = li.withColumn("part", _part_file()).select(F.concat(F.lit("app/s"), "l_suppkey", F.lit(".py")).alias("edge_from"), way.alias("edge_to")).distinct()
    return graph.resolve_dependencies(e, files)


def impacted_chain(spark, d):
    """All files that depend on one type's core file, over brands, parts, suppliers and shops."""
    e = _calls(spark, d).select(F.col("src").alias("edge_from"), F.col("dst").alias("target"))
    return relations.impacted_files(e, ["core/promo.py", "none.py"])


def impacted_by_text(spark, d):
    """Nothing depends on the changed file, so the documents that mention it are taken."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".py")).alias("path"), "text")
    return relations.impacted_files(_calls(spark, d).select(F.col("src").alias("edge_from"), F.col("dst").alias("target")), ["lib/license.py"], docs)


def _calls(spark, d):
    """Links over four kinds of files: nations' orders use suppliers, those use part files, those their brand's, and that the types it has."""
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    sold = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    supplier, brand = F.concat(F.lit("app/s"), "l_suppkey", F.lit(".py")), F.concat(F.lit("lib/b"), F.substring("p_brand", 7, 2), F.lit(".py"))
    ways = [sold.select(F.concat(F.lit("shop/n"), "c_nationkey", F.lit(".py")), supplier), _uses(spark, d).select("file", _part_file()), p.select(_part_file(), brand), p.select(brand, F.concat(F.lit("core/"), F.lower("p_type"), F.lit(".py")))]
    return reduce(DataFrame.union, ways).toDF("src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def call_graph_links(spark, d):
    """Three levels about two part files, down by a file's heaviest links, and up."""
    starts = spark.createDataFrame([("src/promo/b8.py",), ("src/large/b6.py",)], "node string")
    return relations.call_graph(_calls(spark, d), starts, 1)[1].select("src", "dst", "weight", "direction")


def call_graph_levels(spark, d):
    """The nodes of the same search with their levels."""
    starts = spark.createDataFrame([("src/promo/b8.py",), ("src/large/b6.py",)], "node string")
    return relations.call_graph(_calls(spark, d), starts, 1)[0].select("node", F.col("level").cast("long").alias("level"))


def inheritance_tree(spark, d):
    """Regions, their nations, and customers of a nation as classes below each other."""
    r = table(spark, d, "region").select(F.col("r_name").alias("symbol"), F.col("r_name").alias("qualified_name"), F.array().cast("array<string>").alias("bases"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.concat_ws(".", "r_name", "n_name").alias("qualified_name"), F.array(F.lower("r_name")).alias("bases"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.concat(F.lit("supplier.S"), "s_suppkey").alias("qualified_name"), F.array("n_name").alias("bases"))
    return relations.inheritance_tree(r.union(n).union(s)).select("root", "node", "parent", F.col("depth").cast("long").alias("depth"), "circular")


def textual_dependents(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".py")).alias("path"), "text")
    return relations.textual_dependents(docs, ["lib/license.py", "doc_3.py"])


def test_files(spark, d):
    s = _symbols(spark, d).withColumn("file", F.when(F.col("line_end") - F.col("line_start") <= 3, F.concat(F.lit("tests/test_"), F.replace("file", F.lit("/"), F.lit("_")))).otherwise(F.col("file")))
    return relations.test_files_of(s, "red", "src/promo/b1.py").select("file", "line_start", "symbol")


def symbol_places(spark, d):
    names = _references(spark, d).select(F.upper("target_symbol").alias("name")).distinct()
    return relations.symbol_places(_symbols(spark, d), names).select("name", "file", "line_start")


def index_inputs(spark, d):
    manifest = table(spark, d, "part").where("p_size <= 10").select(_part_file().alias("path"))
    tests = table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("owns_file"))
    return relations.index_inputs(manifest, _dependencies(spark, d), tests).groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count("*").alias("files")).where("not top like 'doc%'").union(relations.index_inputs(manifest, _dependencies(spark, d), tests).where("path like 'doc%'").agg(F.lit("doc").alias("top"), F.count("*").alias("files")))


def candidate_files(spark, d):
    tests = table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("owns_file"))
    return relations.candidate_files(_symbols(spark, d), _references(spark, d), _dependencies(spark, d), tests, ["app/s1.py", "src/promo/b11.py"])


def file_dependencies(spark, d):
    e = graph.resolve_dependencies(_dependencies(spark, d), _files(spark, d)).toDF("src", "dst")
    out = relations.file_dependencies(e)
    return out.select("file", F.concat_ws(",", "imports").alias("imports"), F.concat_ws(",", "imported_by").alias("imported_by"), "n_imports", "n_exports", "total_edges")


QUERIES = {f.__name__: f for f in (relation_links, resolved_dependencies, impacted_by_change, resolved_ways, impacted_chain, impacted_by_text, call_graph_links, call_graph_levels, inheritance_tree, textual_dependents, test_files, symbol_places, index_inputs, candidate_files, file_dependencies)}
_BASE = """p AS (SELECT p_partkey, p_size, lower(p_type) AS t, substr(p_brand, 7, 2) AS b, replace(p_name, ' ', '_') AS sym, 'src/' || lower(p_type) || '/b' || substr(p_brand, 7, 2) || '.py' AS file FROM part),
    u AS (SELECT 'app/s' || l_suppkey || '.py' AS src, p.* FROM lineitem JOIN p ON l_partkey = p_partkey),
    dp AS (SELECT DISTINCT src, file, 'src.' || t || '.b' || b || '.' || sym AS edge_to FROM u WHERE p_size <= 2)"""
_CALLS = """w AS (SELECT 'shop/n' || c_nationkey || '.py' AS src, 'app/s' || l_suppkey || '.py' AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey UNION ALL SELECT src, file FROM u
        UNION ALL SELECT file, 'lib/b' || b || '.py' FROM p UNION ALL SELECT 'lib/b' || b || '.py', 'core/' || t || '.py' FROM p),
    e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM w GROUP BY ALL), h AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 10), st AS (SELECT unnest(['src/promo/b8.py', 'src/large/b6.py']) AS node),
    d1 AS (SELECT * FROM h WHERE src IN (FROM st)), d2 AS (SELECT * FROM h WHERE src IN (SELECT dst FROM d1) AND src NOT IN (FROM st)), u1 AS (SELECT * FROM e WHERE dst IN (FROM st)), u2 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM u1) AND dst NOT IN (FROM st))"""
ORACLE = {
    "relation_links": f"""WITH {_BASE}, st AS (SELECT DISTINCT unnest(list_distinct([lower(sym), t || '.' || lower(sym), 'b' || p_size])) AS token, file AS dst FROM p),
        mt AS (SELECT DISTINCT unnest(['src.' || t || '.b' || b, 'b' || b]) AS token, file AS dst FROM p UNION SELECT unnest(['app.s' || s_suppkey, 's' || s_suppkey]), 'app/s' || s_suppkey || '.py' FROM supplier),
        al AS (SELECT * FROM st UNION SELECT * FROM mt),
        x AS (SELECT src, dst, count(*) * 1.0 AS w FROM u JOIN al ON token = lower(sym) GROUP BY src, dst
              UNION ALL SELECT src, dst, count(*) * 0.8 FROM dp JOIN al ON token = lower(edge_to) GROUP BY src, dst
              UNION ALL SELECT file, dst, count(*) * 0.7 FROM p JOIN st ON token = 'b' || p_size GROUP BY file, dst
              UNION ALL SELECT file, dst, count(*) * 0.6 FROM p JOIN mt ON token = 'b' || p_size GROUP BY file, dst)
        SELECT src, dst, round(sum(w::DOUBLE), 4) AS weight FROM x WHERE src <> dst GROUP BY src, dst""",
    "resolved_dependencies": f"WITH {_BASE} SELECT DISTINCT src AS edge_from, file AS target FROM dp",
    "impacted_by_change": f"WITH {_BASE} SELECT DISTINCT src AS node FROM dp WHERE file IN ('src/promo/b8.py', 'src/large/b6.py') UNION SELECT unnest(['src/promo/b8.py', 'src/large/b6.py'])",
    "resolved_ways": f"""WITH {_BASE}, l AS (SELECT l_suppkey AS s, l_linenumber AS n, p.* FROM lineitem JOIN p ON l_partkey = p_partkey), f AS (SELECT 'app/s' || s_suppkey || '.py' AS path FROM supplier)
        SELECT DISTINCT 'app/s' || s || '.py' AS edge_from, CASE n WHEN 1 THEN file WHEN 2 THEN 'app/s' || (s + 1) || '.py' WHEN 3 THEN 'src/frontend/src/x' || p_size || '.ts' ELSE file END AS target FROM l WHERE n IN (1, 3, 4) OR (n = 2 AND 'app/s' || (s + 1) || '.py' IN (FROM f))""",
    "impacted_chain": f"WITH RECURSIVE {_BASE}, {_CALLS}, r AS (SELECT unnest(['core/promo.py', 'none.py']) AS node UNION SELECT src FROM e JOIN r ON dst = node) SELECT node FROM r",
    "impacted_by_text": "SELECT 'lib/license.py' AS node UNION ALL SELECT 'doc_' || doc_id || '.py' FROM documents WHERE regexp_matches(lower(text), 'lib\\.license|license') AND strlen(text) <= 1000000",
    "call_graph_links": f"WITH {_BASE}, {_CALLS} SELECT DISTINCT * FROM (SELECT src, dst, weight, 'down' AS direction FROM d1 UNION ALL SELECT src, dst, weight, 'down' FROM d2 UNION ALL SELECT src, dst, weight, 'up' FROM u1 UNION ALL SELECT src, dst, weight, 'up' FROM u2)",
    "call_graph_levels": f"WITH {_BASE}, {_CALLS} SELECT node, min(level)::BIGINT AS level FROM (SELECT node, 0 AS level FROM st UNION ALL SELECT dst, 1 FROM d1 UNION ALL SELECT dst, 2 FROM d2 UNION ALL SELECT src, 1 FROM u1 UNION ALL SELECT src, 2 FROM u2) GROUP BY node",
    "inheritance_tree": """WITH n AS (SELECT r_name AS root, r_name || '.' || n_name AS q, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT r_name AS root, r_name AS node, NULL AS parent, 0::BIGINT AS depth, false AS circular FROM region UNION ALL SELECT root, q, root, 1, false FROM n
        UNION ALL SELECT root, 'supplier.S' || s_suppkey, q, 2, false FROM supplier JOIN n ON s_nationkey = k""",
    "textual_dependents": "SELECT 'doc_' || doc_id || '.py' AS path FROM documents WHERE regexp_matches(lower(text), 'lib\\.license|license|doc_3') AND doc_id <> 3 AND strlen(text) <= 1000000",
    "test_files": f"WITH {_BASE}, s AS (SELECT 'tests/test_' || replace(file, '/', '_') AS f, sym, p_partkey FROM p WHERE p_size <= 3) SELECT f AS file, min(p_partkey) AS line_start, arg_min(sym, p_partkey) AS symbol FROM s WHERE contains(lower(sym), 'red') OR contains(f, 'b1') GROUP BY f ORDER BY f LIMIT 5",
    "symbol_places": f"WITH {_BASE} SELECT upper(sym) AS name, min((file, p_partkey)).file AS file, min((file, p_partkey)).p_partkey AS line_start FROM p WHERE sym IN (SELECT sym FROM u) GROUP BY 1".replace("min((file, p_partkey)).file", "min({'file': file, 'k': p_partkey}).file").replace("min((file, p_partkey)).p_partkey", "min({'file': file, 'k': p_partkey}).k"),
    "index_inputs": f"WITH {_BASE}, a AS (SELECT file AS path FROM p WHERE p_size <= 10 UNION SELECT src FROM dp UNION SELECT 'doc_' || doc_id FROM labels WHERE quality = 1) SELECT CASE WHEN path LIKE 'doc%' THEN 'doc' ELSE split_part(path, '/', 1) END AS top, count(*) AS files FROM a GROUP BY 1",
    "candidate_files": f"WITH {_BASE}, a AS (SELECT file AS path FROM p UNION SELECT src FROM u UNION SELECT 'doc_' || doc_id FROM labels WHERE quality = 1) SELECT path, path IN ('app/s1.py', 'src/promo/b11.py') AS changed FROM a",
    "file_dependencies": f"""WITH {_BASE}, e AS (SELECT DISTINCT src, file AS dst FROM dp), f AS (SELECT src AS file FROM e UNION SELECT dst FROM e ORDER BY 1 LIMIT 100)
        SELECT f.file, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = f.file), '') AS imports, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = f.file), '') AS imported_by,
        (SELECT count(*) FROM e WHERE src = f.file) AS n_imports, (SELECT count(*) FROM e WHERE dst = f.file) AS n_exports, (SELECT count(*) FROM e) AS total_edges FROM f""",
}
