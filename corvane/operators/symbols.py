"""Symbol search, details, callers, ownership and design patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_score(query: str, symbol: str, qualified: str) -> Column:
    """Tier of a symbol for a query, in any case: exact, prefix or contained, by symbol before qualified name."""
    q, s, n = F.lit(query.strip().lower()), F.lower(F.coalesce(symbol, F.lit(""))), F.lower(F.coalesce(qualified, F.lit("")))
    return F.when(s == q, 1.0).when(n == q, 0.9).when(F.startswith(s, q), 0.7).when(F.startswith(n, q), 0.5).when(F.contains(s, q), 0.3).when(F.contains(n, q), 0.2).otherwise(0.0)


def search(symbols: DataFrame, query: str, kinds: list[str] = (), known_kinds: list[str] = (), limit: int = 50) -> DataFrame:
    """Best symbols for a query. Kinds that aren't known are ignored; without a known one all kinds count."""
    use = [k for k in kinds if k in known_kinds]
    rows = symbols.where(F.col("kind").isin(use)) if use else symbols
    rows = rows.withColumn("score", match_score(query, "symbol", "qualified_name")).where("score > 0")
    return rows.orderBy(F.desc("score"), F.lower("symbol"), "file", "line_start").limit(min(500, max(1, limit)))


def details(symbols: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """The best candidate for each query name and the next ones: query, symbol, file, line_start, rank."""
    hit = symbols.join(queries, (F.lower("symbol") == F.lower("query")))
    order = Window.partitionBy("query").orderBy(F.desc((F.col("symbol") == F.col("query")).cast("int")), "line_start", "file")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def called_by(symbols: DataFrame, references: DataFrame, most: int = 20) -> DataFrame:
    """Callers of each symbol, by its name or its qualified name: symbol, n_callers, callers (first ``most``).

    The alternative is written as a union of equi-joins, so it never becomes a nested loop.
    """
    names = symbols.select("symbol", F.col("symbol").alias("name")).union(symbols.select("symbol", F.col("qualified_name").alias("name"))).distinct()
    calls = names.join(references.select(F.col("target_symbol").alias("name"), F.col("source_symbol").alias("caller")).distinct(), "name").select("symbol", "caller").distinct()
    top = calls.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("caller")))
    return top.groupBy("symbol").agg(F.count("*").alias("n_callers"), F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.col("caller")))).alias("callers"))


def is_test_file(path: str | Column) -> Column:
    """Below a tests folder, named test_*, *_test.py, or *.test and *.spec of .ts and .tsx."""
    p = F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(p, "/"), -1)
    return F.contains(p, F.lit("/tests/")) | F.startswith(name, F.lit("test_")) | name.rlike(r"(_test\.py|\.(test|spec)\.tsx?)$")


def name_tokens(path: str) -> Column:
    """Words of a file's stem without the marks of a test."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"test_|_test|\.test|\.spec|spec_|tests_", "")
    return F.array_distinct(F.filter(F.split(stem, "[-_]"), lambda x: x != ""))


def ownership(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Which sources a test file owns: by a shared word of their names (0.6), or by an import of the file's name (0.8).

    files: path. Words are exploded on both sides and joined, instead of comparing all pairs.
    """
    f = files.select("path", is_test_file("path").alias("t"), name_tokens("path").alias("w"))
    tests, sources = f.where("t").select(F.col("path").alias("test_file"), F.explode("w").alias("w")), f.where("not t").select(F.col("path").alias("owns_file"), F.explode("w").alias("w"))
    naming = tests.join(sources, "w").select("test_file", "owns_file").distinct().withColumns({"source": F.lit("naming"), "confidence": F.lit(0.6)})
    named = f.where("not t").groupBy(F.lower(F.element_at(F.split("path", "/"), -1)).alias("name")).agg(F.max("path").alias("owns_file"))
    dep = dependencies.select(F.col("edge_from").alias("test_file"), F.lower(F.trim("edge_to")).alias("name")).join(f.where("t").select(F.col("path").alias("test_file")), "test_file", "left_semi")
    imports = dep.join(named, "name").select("test_file", "owns_file").distinct().withColumns({"source": F.lit("import"), "confidence": F.lit(0.8)})
    return naming.union(imports)


def shards(items: DataFrame, group: str, item: str, size: int, most: int) -> DataFrame:
    """Round-robin shards of each group's items in order: group, item, shard, shards."""
    n = F.count("*").over(Window.partitionBy(group))
    count = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(n / size))).cast("long")
    place = F.row_number().over(Window.partitionBy(group).orderBy(item)) - 1
    return items.select(group, item, (place % count).cast("long").alias("shard"), count.alias("shards"))


# Names that mark patterns.
SINGLETON = ["get_instance", "getinstance", "instance", "get_singleton"]
FACTORY = ["create_", "make_", "build_", "new_", "construct_"]
PLAIN_TYPES = ["", "None", "void", "bool", "int", "str", "float"]
OBSERVERS = {
    "subscribe_pattern": ["subscribe", "unsubscribe", "notify"],
    "listener_pattern": ["add_listener", "remove_listener", "notify_listeners"],
    "observer_pattern": ["add_observer", "remove_observer", "notify_observers"],
    "attach_pattern": ["attach", "detach", "notify"],
}
CALLABLES = ["func", "fn", "f", "function", "callable"]


def patterns(symbols: DataFrame, kinds: list[str] = ()) -> DataFrame:
    """Design patterns by rules: pattern, symbol, qualified_name, file, line_start, confidence, indicators.

    symbols: symbol, qualified_name, kind, file, line_start, scope, attributes, parameters, decorators,
    return_type. A top-level class's methods count twice for the builder rule, as its name is its
    qualified name too.
    """
    cls = symbols.where("kind = 'class'").withColumns({"low": F.lower("symbol"), "qlow": F.lower("qualified_name")})
    fun = symbols.where("kind in ('function', 'method')").withColumn("low", F.lower("symbol"))
    scope = fun.where("scope <> ''").groupBy(F.lower("scope").alias("sc")).agg(F.array_sort(F.collect_list("low")).alias("ms"))
    none = F.array().cast("array<string>")
    c = cls.join(scope.toDF("low", "m1"), "low", "left").join(scope.toDF("qlow", "m2"), "qlow", "left")
    c = c.withColumns({"methods": F.concat(F.coalesce("m1", none), F.coalesce("m2", none)), "attributes": F.coalesce("attributes", none)})
    when = lambda cond, name: F.when(cond, F.lit(name) if isinstance(name, str) else name)
    count = lambda p: F.size(F.filter("methods", lambda x: F.startswith(x, F.lit(p))))

    def found(df: DataFrame, pattern: str, rules: list[tuple[Column, float, Column | str]], least: float) -> DataFrame:
        conf = F.round(F.least(F.lit(1.0), sum((F.when(ok, w).otherwise(0.0) for ok, w, _ in rules), F.lit(0.0))), 2)
        marks = F.array_compact(F.array(*[when(ok, name) for ok, _, name in rules]))
        return df.select(F.lit(pattern).alias("pattern"), "symbol", "qualified_name", "file", "line_start", conf.alias("confidence"), marks.alias("indicators")).where(F.col("confidence") >= least)

    single = F.filter("methods", lambda x: x.isin(SINGLETON))
    singleton = found(c, "singleton", [(F.exists("attributes", lambda a: F.contains(F.lower(a), F.lit("_instance")) | (F.lower(a) == "instance")), 0.4, "has_instance_attribute"), (F.size(single) > 0, 0.4, F.concat(F.lit("has_"), F.get(single, F.lit(0)), F.lit("_method"))), (F.array_contains("methods", "__new__"), 0.2, "overrides___new__")], 0.4)
    prefix = F.coalesce(*[F.when(F.startswith("low", F.lit(p)), F.lit(f"name_starts_with_{p[:-1]}")) for p in FACTORY])
    rt = F.trim(F.coalesce("return_type", F.lit("")))
    factory = found(fun, "factory", [(prefix.isNotNull(), 0.5, prefix), (~rt.isin(PLAIN_TYPES), 0.3, "returns_object")], 0.5).union(found(cls, "factory", [(F.endswith("low", F.lit("factory")), 0.8, "class_name_ends_with_Factory")], 0.5))
    distinct = F.array_distinct("methods")
    pairs = [F.size(F.array_intersect(distinct, F.array(*[F.lit(m) for m in ms]))) >= 2 for ms in OBSERVERS.values()]
    on = F.size(F.filter(distinct, lambda x: F.startswith(x, F.lit("on_")) & (F.char_length(x) > 3)))
    any_pair = pairs[0] | pairs[1] | pairs[2] | pairs[3]
    observer = c.select(F.lit("observer").alias("pattern"), "symbol", "qualified_name", "file", "line_start", F.when(any_pair, 0.7).when(on >= 3, 0.5).otherwise(0.0).alias("confidence"), F.array_compact(F.array(*[when(p, n) for p, n in zip(pairs, OBSERVERS, strict=True)], F.when(on >= 3, F.concat(F.lit("has_"), on.cast("string"), F.lit("_on_methods"))))).alias("indicators")).where("confidence >= 0.5")
    params, decs = F.coalesce("parameters", none), F.coalesce("decorators", none)
    decorator = found(fun, "decorator", [(F.exists(decs, lambda x: F.contains(F.lower(x), F.lit("wraps"))), 0.6, "uses_functools_wraps"), ((F.size(params) == 1) & F.lower(F.get(params, F.lit(0))).isin(CALLABLES), 0.3, "single_callable_param"), (F.lower(rt).isin("callable", "wrapper"), 0.2, "returns_callable")], 0.5).union(found(cls, "decorator", [(F.endswith("low", F.lit("decorator")), 0.7, "class_name_ends_with_Decorator")], 0.5))
    w, s = count("with_"), count("set_")
    builder = found(c, "builder", [(F.endswith("low", F.lit("builder")), 0.5, "class_name_ends_with_Builder"), (F.array_contains("methods", "build"), 0.3, "has_build_method"), (w >= 2, 0.3, F.concat(F.lit("has_"), w.cast("string"), F.lit("_with_methods"))), (s >= 3, 0.2, F.concat(F.lit("has_"), s.cast("string"), F.lit("_set_methods")))], 0.5)
    every = {"singleton": singleton, "factory": factory, "observer": observer, "decorator": decorator, "builder": builder}
    use = [k for k in kinds if k in every] or list(every)
    out = every[use[0]]
    for k in use[1:]:
        out = out.union(every[k])
    return out.orderBy(F.desc("confidence"), "symbol", "pattern")
