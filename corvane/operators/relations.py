"""The relation graph from symbols, references and dependencies, and what is asked of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import lines
from corvane.operators import graph as G

WORD = "[A-Za-z_][A-Za-z0-9_.$]{1,127}"
# Weight of a link by what it comes from.
LINK_WEIGHTS = {"reference": 1.0, "dependency": 0.8, "target_symbol": 0.7, "target_module": 0.6}
# Marks of interfaces in names and in bases.
INTERFACE_NAMES = ["protocol", "interface", "abc", "abstract"]
INTERFACE_BASES = ["protocol", "abc", "interface"]


def _module_name(raw: Column) -> Column:
    """A module's dotted name, lower case: slashes as dots, leading and final dots off."""
    return F.lower(F.btrim(F.replace(F.replace(F.trim(raw), F.lit("\\"), F.lit("/")), F.lit("/"), F.lit(".")), F.lit(".")))


def _words(raw: Column) -> Column:
    return F.transform(F.regexp_extract_all(raw, F.lit(WORD), F.lit(0)), lambda x: F.lower(x))


def symbol_names(symbols: DataFrame) -> DataFrame:
    """Every token that stands for a file by its symbols: token, target. Names, qualified names, relation targets, and their words."""
    targets = F.slice("relation_targets", 1, 24) if "relation_targets" in symbols.columns else F.array().cast("array<string>")
    values = F.filter(F.transform(F.concat(F.array("symbol", "qualified_name"), F.coalesce(targets, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != "")
    v = symbols.select("file", F.explode(values).alias("v"))
    return v.select("file", F.explode(F.array_distinct(F.concat(F.array(F.lower("v")), _words(F.col("v"))))).alias("token")).select("token", F.col("file").alias("target")).distinct()


def module_names(files: DataFrame) -> DataFrame:
    """Every token that stands for a source file by its path: dotted path, stem, and the package of an ``__init__``: token, target."""
    f = files.where(F.lower("path").rlike(r"\.(py|js|jsx|ts|tsx)$"))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    name, parent = F.element_at(F.split(stem, "/"), -1), F.regexp_replace(stem, "/?[^/]*$", "")
    dotted = lambda c: F.lower(F.replace(c, F.lit("/"), F.lit(".")))
    tokens = F.array_compact(F.array(dotted(stem), F.lower(name), F.when((name == "__init__") & (parent != ""), dotted(parent))))
    return f.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col("path").alias("target")).distinct()


def relation_links(symbols: DataFrame, references: DataFrame, dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Weighted links between files: src, dst, weight, one row per kind and pair. Feed to ``graph.relation_graph``.

    symbols: file, symbol, qualified_name, relation_targets; references: file, target_symbol; dependencies: edge_from,
    edge_to; files: path. A row links its file to every other file that its name, module name or any of its words stands
    for. Equal rows are counted before the join, so a name used a million times in a file is joined once.
    """
    by_symbol, by_module = symbol_names(symbols), module_names(files)
    every = by_symbol.union(by_module).distinct()
    raw = references.select(F.col("file").alias("src"), F.trim("target_symbol").alias("raw"), F.lit("reference").alias("kind")).union(dependencies.select("edge_from", F.trim("edge_to"), F.lit("dependency")))
    raw = raw.where("raw <> ''").groupBy("src", "raw", "kind").agg(F.count("*").alias("n"))
    # A name is resolved once, however many files use it; then the counts are joined and added up.
    tokens = F.array_distinct(F.concat(F.array(F.lower("raw"), _module_name(F.col("raw"))), _words(F.col("raw"))))
    resolved = raw.select("raw").distinct().select("raw", F.explode(tokens).alias("token")).join(every, "token").select("raw", F.col("target").alias("dst")).distinct()
    hit = raw.join(resolved, "raw")
    weight = F.create_map(*[F.lit(x) for kv in LINK_WEIGHTS.items() for x in kv])
    out = [hit.groupBy("src", "dst", "kind").agg(F.sum("n").alias("n"))]
    if "relation_targets" in symbols.columns:
        t = symbols.select(F.col("file").alias("src"), F.explode(F.slice("relation_targets", 1, 24)).alias("x")).select("src", F.trim("x").alias("x")).where("x <> ''")
        for kind, key, names in (("target_symbol", F.lower("x"), by_symbol), ("target_module", _module_name(F.col("x")), by_module)):
            out.append(t.select("src", key.alias("token")).groupBy("src", "token").agg(F.count("*").alias("n")).join(names, "token").groupBy("src", F.col("target").alias("dst")).agg(F.sum("n").alias("n")).select("src", "dst", F.lit(kind).alias("kind"), "n"))
    links = reduce(DataFrame.unionByName, out)
    return links.where("src <> dst").select("src", "dst", (weight[F.col("kind")] * F.col("n")).alias("weight"))


def candidate_files(symbols: DataFrame, references: DataFrame, dependencies: DataFrame, tests: DataFrame, changed: list[str] = ()) -> DataFrame:
    """All files that a relation names, changed ones first, then by path: path, changed."""
    named = symbols.select("file").union(references.select("file")).union(dependencies.select("edge_from")).union(tests.select("owns_file")).toDF("path").where("path <> ''").distinct()
    return named.withColumn("changed", F.col("path").isin(list(changed)) if changed else F.lit(False)).orderBy(F.desc("changed"), "path")


def seed_files(candidates: DataFrame, changed: list[str], hints: list[str]) -> DataFrame:
    """Candidates that are changed, then those whose path has a hint: node, in their order (``place``)."""
    low = F.lower("path")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c.lower()) for c in changed]), low), F.lit(0)) if changed else F.lit(0)
    hinted = reduce(lambda a, h: a | F.contains(low, F.lit(h.lower())), [h for h in hints if h], F.lit(False))
    place = F.when(rank > 0, F.struct(F.lit(0).alias("a"), rank.cast("long").alias("b"))).when(hinted, F.struct(F.lit(1).alias("a"), F.lit(0).cast("long").alias("b")))
    return candidates.select(F.col("path").alias("node"), place.alias("place")).where("place is not null")


def expand_candidates(candidates: DataFrame, graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """candidates (path, changed, place) with their new order: changed ones first, the rest by proximity to the seeds, then as before."""
    near = G.proximity(graph, seeds).withColumnRenamed("node", "path")
    out = candidates.join(near, "path", "left").withColumn("proximity", F.when(F.col("changed"), 0.0).otherwise(F.coalesce("proximity", F.lit(0.0))))
    return out.orderBy(F.desc("changed"), F.desc("proximity"), "place")


def call_graph(graph: DataFrame, starts: DataFrame, depth: int, direction: str = "both", symbols: DataFrame | None = None, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, level, symbol_count) and links (src, dst, weight, direction) around the starts.

    Breadth-first, each link once. Down, only a node's ``most`` heaviest links are followed. Nodes up to
    ``depth`` are gone on from, so the last level is depth + 1. graph: src, dst, weight; starts: node.
    """
    graph = G._checkpoint(graph.select("src", "dst", "weight"))
    heavy = G._checkpoint(G.top_neighbours(graph, most).drop("rank"))
    ways = {"down": (heavy, "src", "dst"), "up": (graph, "dst", "src")}
    nodes, links = [starts.select("node", F.lit(0).alias("level"))], []
    for way in ("down", "up"):
        if direction not in (way, "both"):
            continue
        edges, near, far = ways[way]
        frontier = seen = G._checkpoint(starts.select("node").distinct().withColumn("level", F.lit(0)))
        for k in range(depth + 1):
            out = G._checkpoint(edges.join(frontier.select(F.col("node").alias(near)), near))
            links.append(out.select("src", "dst", F.bround("weight", 4).alias("weight"), F.lit(way).alias("direction")))
            frontier = G._checkpoint(out.select(F.col(far).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(k + 1)))
            seen = seen.union(frontier)
        nodes.append(seen)
    n = reduce(DataFrame.union, nodes).groupBy("node").agg(F.min("level").alias("level"))
    if symbols is not None:
        counts = symbols.groupBy(F.col("file").alias("node")).agg(F.count("*").alias("symbol_count"))
        n = n.join(counts, "node", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
    return n, reduce(DataFrame.union, links).distinct()


def is_interface(symbol: str = "symbol", bases: str = "bases", decorators: str | None = None) -> Column:
    """Whether a class is an interface by its name, a base or a decorator."""
    any_of = lambda c, marks: reduce(lambda a, m: a | F.contains(F.lower(c), F.lit(m)), marks, F.lit(False))
    out = any_of(F.col(symbol), INTERFACE_NAMES) | F.coalesce(F.exists(bases, lambda b: any_of(b, INTERFACE_BASES)), F.lit(False))
    return out | F.coalesce(F.exists(decorators, lambda x: F.contains(F.lower(x), F.lit("abstract"))), F.lit(False)) if decorators else out


def inheritance_tree(classes: DataFrame, include_interfaces: bool = True, max_depth: int = 1000) -> DataFrame:
    """Every class below its roots: root, node (qualified names), parent, depth, path, circular.

    classes: symbol, qualified_name, bases (and decorators). A base names a class by its name or qualified name, in any
    case. A root has no base among the classes. A class that its own path already has is marked circular and not gone
    below; if every class of a cycle has a base, none of it is below a root.
    """
    c = classes.where(~is_interface("symbol", "bases", "decorators" if "decorators" in classes.columns else None)) if not include_interfaces else classes
    names = c.select("qualified_name", F.explode(F.array_distinct(F.array(F.lower("symbol"), F.lower("qualified_name")))).alias("name"))
    base = c.select(F.col("qualified_name").alias("child"), F.explode(F.transform("bases", lambda b: F.lower(F.trim(b)))).alias("name"))
    links = G._checkpoint(base.join(names, "name").select(F.col("qualified_name").alias("parent"), "child").where("lower(parent) <> lower(child)").distinct())
    roots = c.select("qualified_name").distinct().join(links, F.col("qualified_name") == F.col("child"), "left_anti")
    level = G._checkpoint(roots.select(F.col("qualified_name").alias("root"), F.col("qualified_name").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("qualified_name").alias("path"), F.lit(False).alias("circular")))
    every = [level]
    for k in range(1, max_depth + 1):
        nxt = level.where("not circular").drop("parent").join(links, F.col("node") == F.col("parent"))
        level = G._checkpoint(nxt.select("root", F.col("child").alias("node"), "parent", F.lit(k).alias("depth"), F.concat("path", F.array("child")).alias("path"), F.array_contains("path", F.col("child")).alias("circular")))
        if not level.limit(1).count():
            return reduce(DataFrame.union, every)
        every.append(level)
    raise RuntimeError(f"classes are still found below depth {max_depth}")


def file_dependencies(edges: DataFrame, direction: str = "both", most: int = 100) -> DataFrame:
    """The first ``most`` files with their distinct imports and importers: file, imports, imported_by, n_imports, n_exports, total_edges."""
    d = G.dependencies_both(edges)
    none = F.array().cast("array<string>")
    d = d.withColumns({"imports": F.col("imports") if direction in ("both", "imports") else none, "imported_by": F.col("imported_by") if direction in ("both", "exports") else none})
    d = d.withColumns({"n_imports": F.size("imports").cast("long"), "n_exports": F.size("imported_by").cast("long")})
    total = edges.select("src", "dst").distinct().agg(F.count("*").alias("total_edges"))
    return d.orderBy("file").limit(most).crossJoin(F.broadcast(total))  # one row


def test_files_of(symbols: DataFrame, name: str, definition_file: str, most: int = 5) -> DataFrame:
    """Files of tests that have a symbol named like ``name`` or are named after the defining file, by their first such row: file, line_start, symbol."""
    stem = definition_file.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    low = F.lower("file")
    hit = symbols.where(F.contains(low, F.lit("test")) & (F.contains(F.lower("symbol"), F.lit(name.lower())) | F.contains(low, F.lit(stem))))
    first = hit.groupBy("file").agg(F.min(F.struct("line_start", "symbol", "line_end")).alias("s"))
    return first.orderBy("file").limit(most).select("file", "s.line_start", "s.line_end", "s.symbol")


def symbol_places(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Where each name is defined: its first row by file and line, by name or qualified name in any case. names: name."""
    keys = symbols.select(F.explode(F.array_distinct(F.array(F.lower("symbol"), F.lower("qualified_name")))).alias("low"), F.struct("file", "line_start", "line_end").alias("at"))
    wanted = names.select("name", F.lower("name").alias("low")).distinct()
    return keys.join(wanted, "low").groupBy("name").agg(F.min("at").alias("at")).select("name", "at.file", "at.line_start", "at.line_end")


def symbol_context(symbols: DataFrame, references: DataFrame, texts: DataFrame, name: str, kind: str = "related", most: int = 10) -> DataFrame:
    """Snippets around a symbol: its definition (5 lines about), callers, callees and tests (3 lines): type, name, file, line_start, line_end, content.

    kind: definition, usage or related. Callers and callees that are symbols are shown where they are defined.
    texts: file, text. Each part is at most ``most`` rows, so the texts' side is the only large one.
    """
    kind = kind if kind in ("definition", "usage", "related") else "definition"
    exact = F.desc((F.col("symbol") == name).cast("int"))
    found = symbols.where(F.lower("symbol") == name.lower()).orderBy(exact, "line_start", "file").limit(1)
    at = found.select(F.lit("definition").alias("type"), F.lit(0).alias("ord"), F.lit(name).alias("name"), "file", "line_start", "line_end", F.lit(5).alias("about"))
    parts = [at] if kind in ("definition", "related") else []
    if kind in ("usage", "related"):
        callers = references.where(F.col("target_symbol") == name).select(F.col("source_symbol").alias("name")).distinct().orderBy("name").limit(most)
        parts.append(symbol_places(symbols, callers).select(F.lit("usage"), F.lit(1), "name", "file", "line_start", "line_end", F.lit(3)))
    if kind == "related":
        callees = references.where(F.col("source_symbol") == name).select(F.col("target_symbol").alias("name")).distinct().orderBy("name").limit(most)
        parts.append(symbol_places(symbols, callees).select(F.lit("callee"), F.lit(2), "name", "file", "line_start", "line_end", F.lit(3)))
    place = found.select("file").first()
    if place is not None:
        parts.append(test_files_of(symbols, name, place.file).select(F.lit("test"), F.lit(3), "symbol", "file", "line_start", "line_end", F.lit(3)))
    rows = reduce(DataFrame.union, parts).toDF("type", "ord", "name", "file", "a", "b", "about")
    shown = texts.join(F.broadcast(rows), "file").withColumn("ls", lines("text"))  # some tens of rows
    a, b = F.greatest(F.lit(1), F.col("a") - F.col("about")), F.least(F.size("ls"), F.col("b") + F.col("about"))
    shown = shown.withColumns({"line_start": a.cast("int"), "line_end": b.cast("int")}).where("line_end >= line_start")
    out = shown.withColumn("content", F.array_join(F.slice("ls", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    return out.orderBy("ord", "name", "file").select("type", "name", "file", "line_start", "line_end", "content")


def textual_dependents(texts: DataFrame, changed: list[str], max_bytes: int = 1_000_000) -> DataFrame:
    """Source files whose text has the dotted path or the stem of a changed file, in any case: path. texts: path, text."""
    tokens = set()
    for c in changed:
        stem = c.replace("\\", "/").removeprefix("./").rsplit(".", 1)[0]
        tokens |= {stem.replace("/", ".").lower(), stem.rsplit("/", 1)[-1].lower()} - {""}
    low = F.lower("text")
    hit = reduce(lambda a, t: a | F.contains(low, F.lit(t)), sorted(tokens), F.lit(False))
    fits = F.lower("path").rlike(r"\.(py|ts|tsx|js|jsx)$") & (F.octet_length("text") <= max_bytes) & ~F.col("path").isin(list(changed))
    return texts.where(fits & hit).select("path")


def impacted_files(resolved: DataFrame, changed: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Changed files and all that depend on them, at any distance: node. resolved: edge_from, target.

    If no dependency leads to a changed file, files that mention one in their text are taken instead.
    """
    spark = resolved.sparkSession
    starts = spark.createDataFrame([(c,) for c in changed], "node string")
    out = G.reachable(resolved.select(F.col("target").alias("src"), F.col("edge_from").alias("dst")), starts).select("node")
    if texts is not None and not out.join(starts, "node", "left_anti").limit(1).count():
        out = out.union(textual_dependents(texts, changed).withColumnRenamed("path", "node")).distinct()
    return out


def impacted_test_files(tests: DataFrame, impacted: DataFrame, most: int = 64) -> DataFrame:
    """Tests that own an impacted file, each once, in the order of their first such row: test_file. tests: test_file, owns_file, place."""
    own = tests.join(impacted.select(F.col("node").alias("owns_file")), "owns_file", "left_semi")
    return own.groupBy("test_file").agg(F.min("place").alias("place")).orderBy("place", "test_file").limit(most)


def index_inputs(manifest: DataFrame, dependencies: DataFrame, tests: DataFrame) -> DataFrame:
    """All files that an index knows: of its manifest, sources of dependencies, and owned ones: path."""
    return manifest.select("path").union(dependencies.select("edge_from")).union(tests.select("owns_file")).where("path <> ''").distinct()
