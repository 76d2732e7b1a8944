"""Relation, symbol and change-impact queries over the driver's tables.

Parts are symbols, suppliers are modules, an order's lines are references: an order's suppliers use
each other's parts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import graph, symbols
from corvane.session import table


def _symbols(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("symbol"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_start"))


_SYM = "s AS (SELECT p_name AS symbol, p_brand || '.' || p_name AS qualified_name, p_type AS kind, p_brand AS file, p_partkey AS line_start FROM part)"


def symbol_search(spark, d):
    out = symbols.search(_symbols(spark, d), "Red", ["ECONOMY", "PROMO", "nonsense"], ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"], 50)
    return out.select("symbol", "qualified_name", "kind", "file", "line_start", "score")


def symbol_details(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("query")).distinct()
    return symbols.details(_symbols(spark, d), names).select("query", "symbol", "file", "line_start", F.col("rank").cast("long").alias("rank"))


def called_by(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    refs = li.select(F.col("p_name").alias("target_symbol"), F.concat(F.lit("supplier_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("source_symbol"))
    return symbols.called_by(_symbols(spark, d).select("symbol", "qualified_name").distinct(), refs)


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "A", 10).when(F.col("l_returnflag") == "N", 8).otherwise(7).alias("weight"))


_EDGES = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 8 ELSE 7 END AS weight FROM lineitem), g AS (SELECT src, dst, sum(weight) AS w FROM e GROUP BY src, dst), n AS (SELECT src, dst, round(w::DOUBLE / max(w) OVER (PARTITION BY src), 6) AS weight FROM g)"


def relation_graph(spark, d):
    return graph.relation_graph(_edges(spark, d)).select("src", "dst", "weight")


def relation_graph_stats(spark, d):
    return graph.relation_graph(_edges(spark, d)).agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("edges"))


def relation_proximity(spark, d):
    seeds = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.proximity(graph.relation_graph(_edges(spark, d)), seeds).select("node", F.round("proximity", 8).alias("proximity"))


def neighbors_top10(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("long").alias("weight"))
    return graph.top_neighbours(counts, 10).select("src", "dst", "weight", F.col("rank").cast("long").alias("rank"))


def _modules(spark, d):
    """Calls between parts: from a returned line of an order to the next line, if that one is returned too."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    nxt = li.withColumns({"dst": F.lead("l_partkey").over(w), "flag": F.lead("l_returnflag").over(w)})
    return nxt.where("l_returnflag = 'R' and flag = 'R' and dst <> l_partkey").select(F.col("l_partkey").alias("src"), "dst").distinct()


_MOD = "m AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, l_returnflag AS f, lead(l_partkey) OVER w AS dst, lead(l_returnflag) OVER w AS g FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE f = 'R' AND g = 'R' AND dst <> src)"


def call_graph_down(spark, d):
    starts = table(spark, d, "part").where("p_partkey <= 3").select(F.col("p_partkey").alias("node"))
    return graph.levels(_modules(spark, d), starts, 3).select("node", F.col("level").cast("long").alias("level"))


def call_graph_up(spark, d):
    m = _modules(spark, d)
    starts = table(spark, d, "part").where("p_partkey <= 3").select(F.col("p_partkey").alias("node"))
    return graph.levels(m.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, 3).select("node", F.col("level").cast("long").alias("level"))


def impacted_closure(spark, d):
    m = _modules(spark, d)
    starts = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return graph.reachable(m.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts).select("node")


def _classes(spark, d):
    """Nations are classes whose base is their region's; regions are classes without a base."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    sub = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("symbol"), F.concat_ws(".", "r_name", "n_name").alias("qualified_name"), F.array(F.coalesce("r_name", F.lit("?"))).alias("bases"))
    return sub.union(r.select(F.col("r_name").alias("symbol"), F.col("r_name").alias("qualified_name"), F.array().cast("array<string>").alias("bases")))


def inheritance_roots(spark, d):
    return graph.inheritance(_classes(spark, d))[1]


def inheritance_links(spark, d):
    return graph.inheritance(_classes(spark, d))[0]


def dependencies_both(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("n"), F.col("l_partkey") % 97).alias("dst"))
    out = graph.dependencies_both(e)
    return out.select("file", F.size("imports").cast("long").alias("n_imports"), F.size("imported_by").cast("long").alias("n_exports"), F.concat_ws(",", "imports").alias("imports"), F.concat_ws(",", "imported_by").alias("imported_by"))


def impacted_tests(spark, d):
    """Orders (tests) that own a line of an impacted part, by their first such line; the first 64."""
    impacted = table(spark, d, "part").where("p_size = 1 and p_type = 'PROMO'").select("p_partkey")
    own = table(spark, d, "lineitem").join(impacted, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return own.groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("first_line")).orderBy("first_line", "l_orderkey").limit(64)


def shard_assignment(spark, d):
    return symbols.shards(table(spark, d, "part"), "p_brand", "p_partkey", 20, 4)


def _paths(spark, d):
    p = table(spark, d, "part").select(F.regexp_replace("p_name", " ", "_").alias("n"), "p_brand", "p_type").distinct()
    return p.select(F.when(F.col("p_type") == "PROMO", F.concat(F.lit("src/tests/test_"), "n", F.lit("_"), F.lower(F.substring("p_brand", 7, 2)), F.lit(".py"))).otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "n", F.lit("_"), F.lower(F.substring("p_brand", 7, 2)), F.lit(".py"))).alias("path")).distinct()


def ownership_naming(spark, d):
    files = _paths(spark, d)
    deps = files.select(F.col("path").alias("edge_from"), F.concat(F.regexp_extract("path", "test_([a-z]+_[a-z]+)", 1), F.lit("_1.py")).alias("edge_to"))
    return symbols.ownership(files, deps).groupBy("test_file", "source").agg(F.count("*").alias("owned"), F.min("owns_file").alias("first_file"))


def removed_files(spark, d):
    """Customers of before (all) against now (those with an order since 1998): removed, added or changed."""
    before = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("size"))
    now = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("size"))
    j = before.alias("b").join(now.alias("n"), "key", "full").select("key", F.col("b.size").alias("was"), F.col("n.size").alias("is_now"))
    state = F.when(F.col("is_now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("is_now"), "changed").otherwise("same")
    return j.withColumn("state", state)


def changed_sources_union(spark, d):
    """Ordered union of change sources, each file by the first source that names it, with that source's confidence."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    parts = [o.where("o_orderstatus = 'P'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), li.where("l_returnflag = 'R'").select("l_suppkey")]
    every = None
    for i, p in enumerate(parts):
        p = p.toDF("key").distinct().withColumn("src", F.lit(i))
        every = p if every is None else every.unionAll(p)
    conf = F.create_map(*[F.lit(x) for i, c in enumerate((0.99, 0.98, 0.96, 0.9)) for x in (i, c)])
    return every.groupBy("key").agg(F.min("src").cast("long").alias("source")).withColumn("confidence", conf[F.col("source").cast("int")])


def workspace_route(spark, d):
    """Each host (workspace) with the number of page paths under it, and every page's longest matching workspace."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    spaces = p.select(F.explode(F.array_distinct(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2)))).alias("ws")).distinct()
    keys = p.select("page_id", F.explode(F.array_distinct(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2)))).alias("ws")).join(spaces, "ws")
    rn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(F.char_length("ws")), "ws"))
    best = keys.withColumn("rn", rn).where("rn = 1")
    return best.groupBy("ws").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def patterns_detected(spark, d):
    """Customers are classes; a method is named by the priority and the status of an order."""
    sup = table(spark, d, "customer").select(F.concat(F.element_at(F.array(F.lit("Query"), F.lit("Cache"), F.lit("Event")), (F.col("c_nationkey") % 3 + 1).cast("int")), "c_custkey", F.element_at(F.array(F.lit("Builder"), F.lit("Factory"), F.lit("Decorator"), F.lit("Bus"), F.lit("Store")), (F.col("c_nationkey") % 5 + 1).cast("int"))).alias("symbol"), F.col("c_custkey").alias("k"), "c_nationkey")
    none = F.array().cast("array<string>")
    cls = sup.select("symbol", F.col("symbol").alias("qualified_name"), F.lit("class").alias("kind"), F.lit("a.py").alias("file"), F.col("k").alias("line_start"), F.lit("").alias("scope"), F.when(F.col("c_nationkey") % 7 == 0, F.array(F.lit("_instance"))).otherwise(none).alias("attributes"), none.alias("parameters"), none.alias("decorators"), F.lit("").alias("return_type"))
    names = ["build", "with_size", "set_a", "subscribe", "notify", "get_instance", "create_part", "on_open", "on_close", "on_error", "wrap", "unsubscribe", "attach", "detach", "set_b"]
    place = (F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 3 + F.expr("position(o_orderstatus in 'FOP')")
    calls = table(spark, d, "orders").select("o_custkey", place.alias("m")).distinct()
    fun = calls.join(sup, F.col("o_custkey") == F.col("k")).select(F.element_at(F.array(*[F.lit(x) for x in names]), F.col("m")).alias("symbol"), F.col("symbol").alias("scope"), "k")
    fun = fun.select("symbol", F.concat_ws(".", "scope", "symbol").alias("qualified_name"), F.lit("method").alias("kind"), F.lit("a.py").alias("file"), F.col("k").alias("line_start"), "scope", none.alias("attributes"), F.when(F.col("symbol") == "wrap", F.array(F.lit("func"))).otherwise(none).alias("parameters"), F.when(F.col("symbol") == "wrap", F.array(F.lit("functools.wraps"))).otherwise(none).alias("decorators"), F.when(F.col("symbol") == "create_part", "Part").otherwise("").alias("return_type"))
    out = symbols.patterns(cls.unionByName(fun))
    return out.select("pattern", "symbol", "qualified_name", "line_start", F.round("confidence", 2).alias("confidence"), F.concat_ws(",", F.array_sort("indicators")).alias("indicators"))


QUERIES = {f.__name__: f for f in (symbol_search, symbol_details, called_by, relation_graph, relation_graph_stats, relation_proximity, neighbors_top10, call_graph_down, call_graph_up, impacted_closure, inheritance_roots, inheritance_links, dependencies_both, impacted_tests, shard_assignment, ownership_naming, removed_files, changed_sources_union, workspace_route, patterns_detected)}
_CLS = "c AS (SELECT n_name AS symbol, r_name || '.' || n_name AS qualified_name, [coalesce(r_name, '?')] AS bases FROM nation LEFT JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, [] FROM region), lk AS (SELECT DISTINCT a.symbol AS child, b.symbol AS parent FROM (SELECT symbol, unnest(bases) AS base FROM c) a JOIN c b ON a.base = b.symbol OR a.base = b.qualified_name WHERE a.symbol <> b.symbol)"
_LEVELS = lambda a, b: f"WITH RECURSIVE {_MOD}, t AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey <= 3 UNION SELECT m.{b}, level + 1 FROM t JOIN m ON m.{a} = t.node WHERE level < 3) SELECT node, min(level)::BIGINT AS level FROM t GROUP BY node"
_PATH = "pa AS (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'src/tests/test_' || n || '_' || b || '.py' ELSE 'src/' || lower(p_type) || '/' || n || '_' || b || '.py' END AS path FROM (SELECT replace(p_name, ' ', '_') AS n, lower(substr(p_brand, 7, 2)) AS b, p_type FROM part))"
ORACLE = {
    "symbol_search": f"WITH {_SYM} SELECT *, CASE WHEN lower(symbol) = 'red' THEN 1.0 WHEN lower(qualified_name) = 'red' THEN 0.9 WHEN starts_with(lower(symbol), 'red') THEN 0.7 WHEN starts_with(lower(qualified_name), 'red') THEN 0.5 WHEN contains(lower(symbol), 'red') THEN 0.3 WHEN contains(lower(qualified_name), 'red') THEN 0.2 ELSE 0 END::DOUBLE AS score FROM s WHERE kind IN ('ECONOMY', 'PROMO') AND contains(lower(qualified_name), 'red') ORDER BY score DESC, lower(symbol), file, line_start LIMIT 50",
    "symbol_details": f"WITH {_SYM} SELECT symbol AS query, symbol, file, line_start, row_number() OVER (PARTITION BY symbol ORDER BY line_start, file) AS rank FROM s QUALIFY rank <= 5",
    "called_by": "WITH c AS (SELECT DISTINCT p_name AS symbol, 'supplier_' || lpad(l_suppkey::VARCHAR, 6, '0') AS caller FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY caller) AS rn FROM c) SELECT symbol, count(*) AS n_callers, list(caller ORDER BY caller) FILTER (WHERE rn <= 20) AS callers FROM r GROUP BY symbol",
    "relation_graph": f"WITH {_EDGES} SELECT src, dst, weight FROM n",
    "relation_graph_stats": f"WITH {_EDGES} SELECT count(DISTINCT src) AS nodes, count(*) AS edges FROM n",
    "relation_proximity": f"WITH {_EDGES}, s AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 9000), p AS (SELECT src AS node, 0.7 * max(weight) AS p FROM n WHERE dst IN (SELECT node FROM s) GROUP BY src UNION ALL SELECT dst, 0.3 * max(weight) FROM n WHERE src IN (SELECT node FROM s) GROUP BY dst) SELECT node, round(sum(p), 8)::DOUBLE AS proximity FROM p GROUP BY node",
    "neighbors_top10": "WITH g AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity)::BIGINT AS weight FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM g QUALIFY rank <= 10",
    "call_graph_down": _LEVELS("src", "dst"),
    "call_graph_up": _LEVELS("dst", "src"),
    "impacted_closure": f"WITH RECURSIVE {_MOD}, t AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT m.src FROM t JOIN m ON m.dst = t.node) SELECT node FROM t",
    "inheritance_roots": f"WITH {_CLS} SELECT symbol FROM c WHERE symbol NOT IN (SELECT child FROM lk)",
    "inheritance_links": f"WITH {_CLS} SELECT * FROM lk",
    "dependencies_both": "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'n' || (l_partkey % 97) AS dst FROM lineitem), a AS (SELECT src AS file, list(dst ORDER BY dst) AS i FROM e GROUP BY src), b AS (SELECT dst AS file, list(src ORDER BY src) AS x FROM e GROUP BY dst) SELECT file, coalesce(len(i), 0)::BIGINT AS n_imports, coalesce(len(x), 0)::BIGINT AS n_exports, coalesce(array_to_string(i, ','), '') AS imports, coalesce(array_to_string(x, ','), '') AS imported_by FROM a FULL JOIN b USING (file)",
    "impacted_tests": "SELECT l_orderkey, min(l_linenumber)::BIGINT AS first_line FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1 AND p_type = 'PROMO') GROUP BY l_orderkey ORDER BY first_line, l_orderkey LIMIT 64",
    "shard_assignment": "WITH c AS (SELECT p_brand, p_partkey, greatest(1, least(4, ceil(count(*) OVER (PARTITION BY p_brand) / 20.0)))::BIGINT AS shards, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_brand, p_partkey, i % shards AS shard, shards FROM c",
    "ownership_naming": f"""WITH {_PATH}, f AS (SELECT path, starts_with(path, 'src/tests/') AS t, list_filter(string_split(replace(regexp_replace(string_split(path, '/')[-1], '\\.py$', ''), 'test_', ''), '_'), lambda x: x <> '') AS w FROM pa),
        o AS (SELECT DISTINCT a.path AS test_file, b.path AS owns_file, 'naming' AS source FROM (SELECT path, unnest(w) AS w FROM f WHERE t) a JOIN (SELECT path, unnest(w) AS w FROM f WHERE NOT t) b USING (w)
        UNION ALL SELECT DISTINCT a.path, b.path, 'import' FROM f a JOIN (SELECT string_split(path, '/')[-1] AS nm, max(path) AS path FROM f WHERE NOT t GROUP BY 1) b ON b.nm = regexp_extract(a.path, 'test_([a-z]+_[a-z]+)', 1) || '_1.py' WHERE a.t)
        SELECT test_file, source, count(*) AS owned, min(owns_file) AS first_file FROM o GROUP BY test_file, source""",
    "removed_files": "WITH n AS (SELECT o_custkey AS key, count(*) AS size FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT coalesce(c.c_custkey, n.key) AS key, c.c_nationkey::BIGINT AS was, n.size AS is_now, CASE WHEN n.size IS NULL THEN 'removed' WHEN c.c_custkey IS NULL THEN 'added' WHEN c.c_nationkey <> n.size THEN 'changed' ELSE 'same' END AS state FROM customer c FULL JOIN n ON c.c_custkey = n.key",
    "changed_sources_union": "WITH u AS (SELECT o_custkey AS key, 0 AS s FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT l_suppkey, 3 FROM lineitem WHERE l_returnflag = 'R') SELECT key, min(s)::BIGINT AS source, [0.99, 0.98, 0.96, 0.9][min(s) + 1]::DOUBLE AS confidence FROM u GROUP BY key",
    "workspace_route": "WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), w AS (SELECT page_id, CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[:2], '/') ELSE path END AS ws FROM p) SELECT ws, count(*) AS pages, min(page_id) AS first_page FROM w GROUP BY ws",
    "patterns_detected": """WITH s AS (SELECT c_custkey AS k, c_nationkey AS nk, ['Query', 'Cache', 'Event'][c_nationkey % 3 + 1] || c_custkey || ['Builder', 'Factory', 'Decorator', 'Bus', 'Store'][c_nationkey % 5 + 1] AS symbol FROM customer),
        f AS (SELECT k, symbol AS scope, ['build', 'with_size', 'set_a', 'subscribe', 'notify', 'get_instance', 'create_part', 'on_open', 'on_close', 'on_error', 'wrap', 'unsubscribe', 'attach', 'detach', 'set_b'][m] AS symbol FROM (SELECT DISTINCT o_custkey, (o_orderpriority[1]::INT - 1) * 3 + position(o_orderstatus IN 'FOP') AS m FROM orders) JOIN s ON k = o_custkey),
        fs AS (SELECT k, list(symbol) AS ms FROM f GROUP BY k), c AS (SELECT s.k, nk, s.symbol, lower(s.symbol) AS low, coalesce(ms, []) AS ms, len(list_filter(coalesce(ms, []), lambda x: x IN ('subscribe', 'unsubscribe', 'notify'))) >= 2 AS o1, len(list_filter(coalesce(ms, []), lambda x: x IN ('attach', 'detach', 'notify'))) >= 2 AS o2 FROM s LEFT JOIN fs USING (k)),
        r AS (SELECT 'singleton' AS pattern, symbol, symbol AS q, k, [CASE WHEN nk % 7 = 0 THEN 'has_instance_attribute' END, CASE WHEN list_contains(ms, 'get_instance') THEN 'has_get_instance_method' END] AS i, (nk % 7 = 0)::INT * 0.4 + list_contains(ms, 'get_instance')::INT * 0.4 AS conf FROM c
        UNION ALL SELECT 'factory', symbol, symbol, k, ['class_name_ends_with_Factory'], 0.8 FROM c WHERE ends_with(low, 'factory')
        UNION ALL SELECT 'factory', symbol, scope || '.' || symbol, k, ['name_starts_with_create', 'returns_object'], 0.8 FROM f WHERE symbol = 'create_part'
        UNION ALL SELECT 'observer', symbol, symbol, k, [CASE WHEN o1 THEN 'subscribe_pattern' END, CASE WHEN o2 THEN 'attach_pattern' END, CASE WHEN list_has_all(ms, ['on_open', 'on_close', 'on_error']) THEN 'has_3_on_methods' END], CASE WHEN o1 OR o2 THEN 0.7 WHEN list_has_all(ms, ['on_open', 'on_close', 'on_error']) THEN 0.5 ELSE 0 END FROM c
        UNION ALL SELECT 'decorator', symbol, symbol, k, ['class_name_ends_with_Decorator'], 0.7 FROM c WHERE ends_with(low, 'decorator')
        UNION ALL SELECT 'decorator', symbol, scope || '.' || symbol, k, ['uses_functools_wraps', 'single_callable_param'], 0.9 FROM f WHERE symbol = 'wrap'
        UNION ALL SELECT 'builder', symbol, symbol, k, [CASE WHEN ends_with(low, 'builder') THEN 'class_name_ends_with_Builder' END, CASE WHEN list_contains(ms, 'build') THEN 'has_build_method' END, CASE WHEN list_contains(ms, 'with_size') THEN 'has_2_with_methods' END, CASE WHEN list_has_all(ms, ['set_a', 'set_b']) THEN 'has_4_set_methods' END], ends_with(low, 'builder')::INT * 0.5 + list_contains(ms, 'build')::INT * 0.3 + list_contains(ms, 'with_size')::INT * 0.3 + list_has_all(ms, ['set_a', 'set_b'])::INT * 0.2 FROM c)
        SELECT pattern, symbol, q AS qualified_name, k AS line_start, round(least(1.0, conf), 2)::DOUBLE AS confidence, array_to_string(list_sort(list_filter(i, lambda x: x IS NOT NULL)), ',') AS indicators FROM r WHERE conf >= CASE pattern WHEN 'singleton' THEN 0.4 ELSE 0.5 END""",
}
