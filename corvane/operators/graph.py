"""Relation graphs: weights, proximity, levels, reachability, inheritance and dependencies."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


JOINED = 16  # rounds of a search whose tables are read one by one


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage into the folder of spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in one process (tests)."""
    sc = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return df.checkpoint()


def relation_graph(edges: DataFrame) -> DataFrame:
    """edges: src, dst, weight, any number per pair. Summed, without loops, relative to each source's heaviest."""
    summed = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    return summed.select("src", "dst", F.bround(F.least(F.lit(1.0), F.col("w") / F.max("w").over(Window.partitionBy("src"))), 6).alias("weight"))


def proximity(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """0.7 x the heaviest link to a seed + 0.3 x the heaviest link from one: node, proximity. seeds: node."""
    s = seeds.select("node").distinct()
    to = graph.join(s, graph.dst == s.node, "left_semi").groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("w")).select("node", (0.7 * F.col("w")).alias("p"))
    back = graph.join(s, graph.src == s.node, "left_semi").groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("w")).select("node", (0.3 * F.col("w")).alias("p"))
    return to.union(back).groupBy("node").agg(F.sum("p").alias("proximity"))


def top_neighbours(graph: DataFrame, n: int = 10) -> DataFrame:
    """The n heaviest links of each source: src, dst, weight, rank."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return graph.withColumn("rank", r).where(F.col("rank") <= n)


def levels(graph: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Breadth-first levels up to depth along src -> dst: node, level (the smallest). starts: node."""
    graph = _checkpoint(graph.select("src", "dst").distinct())
    seen = frontier = _checkpoint(starts.select("node").distinct().withColumn("level", F.lit(0)))
    for k in range(1, depth + 1):
        nxt = graph.join(frontier, graph.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = _checkpoint(nxt.join(seen, "node", "left_anti").withColumn("level", F.lit(k)))
        seen = seen.union(frontier)
    return seen


def reachable(graph: DataFrame, starts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Everything reached from the starts along src -> dst, with its distance: node, level. Raises if a path is longer than max_rounds.

    A round writes its new nodes only; every ``JOINED`` rounds what was found is put into one table.
    """
    graph = _checkpoint(graph.select("src", "dst").distinct())
    seen = frontier = _checkpoint(starts.select("node").distinct().withColumn("level", F.lit(0)))
    for k in range(1, max_rounds + 1):
        nxt = graph.join(frontier, graph.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = _checkpoint(nxt.join(seen, "node", "left_anti").withColumn("level", F.lit(k)))
        if not frontier.limit(1).count():
            return seen
        seen = seen.union(frontier)
        if k % JOINED == 0:
            seen = _checkpoint(seen)
    raise RuntimeError(f"nodes are still reached after {max_rounds} rounds")


def inheritance(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes: symbol, qualified_name, bases. Links (child, parent) by a base's name; and roots (symbol)."""
    base = classes.select(F.col("symbol").alias("child"), F.explode("bases").alias("base"))
    names = classes.select("symbol", F.explode(F.array_distinct(F.array("symbol", "qualified_name"))).alias("name"))
    links = base.join(names, base.base == names.name).select("child", F.col("symbol").alias("parent")).where("child <> parent").distinct()
    return links, classes.select("symbol").join(links, classes.symbol == links.child, "left_anti")


def dependencies_both(edges: DataFrame) -> DataFrame:
    """Distinct imports and exports of every file: file, imports, imported_by (sorted arrays)."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_list("dst")).alias("imports"))
    back = e.groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_list("src")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return out.join(back, "file", "full").select("file", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


# Endings of source files, and names that stand for their folder.
ENDINGS = [".py", ".ts", ".tsx", ".js", ".jsx"]
FOLDER_NAMES = ["index", "__init__"]


def module_aliases(files: DataFrame) -> DataFrame:
    """Names by which a file can be imported: alias, path. files: path."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    name, parent = F.element_at(F.split(stem, "/"), -1), F.regexp_replace(stem, "/?[^/]*$", "")
    dotted = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    folder = F.when((name == "__init__") & (parent != ""), F.array(parent, dotted(parent))).when((name == "index") & (parent != ""), F.array(parent))
    names = F.concat(F.array(stem, F.col("path"), dotted(stem), dotted(F.col("path")), name), F.coalesce(folder, F.array().cast("array<string>")))
    out = files.select("path", F.explode(names).alias("a")).select(F.btrim("a", F.lit(".")).alias("alias"), "path")
    return out.where("alias <> ''").distinct()


def resolve_dependencies(edges: DataFrame, files: DataFrame, app_root: str = "src/frontend/src/") -> DataFrame:
    """Resolve edge_to to files: the exact path; else, if it starts with a dot, the paths relative to the importing
    file (``./``, ``../``, or one dot and one more for each folder up); else ``@/`` below ``app_root``; else all files
    that the name, or any dotted prefix of it, is an alias of. edges: edge_from, edge_to; files: path. Returns edge_from, target.
    """
    to = F.regexp_replace(F.replace(F.trim("edge_to"), F.lit("\\"), F.lit("/")), r"^\./(?=[^./])", "./")
    e = edges.select("edge_from", to.alias("to")).where("to <> ''").distinct()
    parts = F.split(F.regexp_replace("edge_from", "/?[^/]*$", ""), "/")
    dots = ~F.col("to").contains("/")  # of a name with leading dots: one for the folder itself
    up = F.when(dots, F.char_length(F.regexp_extract("to", r"^(\.+)", 1)) - 1).otherwise(F.size(F.regexp_extract_all(F.regexp_extract("to", r"^((\.\.?/)+)", 1), F.lit(r"\.\./"), F.lit(0))))
    rest = F.when(dots, F.replace(F.regexp_replace("to", r"^\.+", ""), F.lit("."), F.lit("/"))).otherwise(F.regexp_replace("to", r"^(\.\.?/)+", ""))
    base = F.array_join(F.filter(F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), F.array(rest)), lambda x: x != ""), "/")
    tails = [*ENDINGS, *(f"/{n}{x}" for n in FOLDER_NAMES for x in ENDINGS)]
    relative = F.when(base.rlike(r"\.[^./]+$"), F.array(base)).otherwise(F.transform(F.array(*[F.lit(x) for x in tails]), lambda x: F.concat(base, x)))
    dotted = F.btrim(F.replace("to", F.lit("/"), F.lit(".")), F.lit("."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(dotted, r"\."))), lambda k: F.array_join(F.slice(F.split(dotted, r"\."), 1, k), "."))
    names = F.concat(F.array(F.col("to"), F.replace("to", F.lit("."), F.lit("/")), F.btrim("to", F.lit("/"))), prefixes, F.transform(prefixes, lambda x: F.replace(x, F.lit("."), F.lit("/"))))
    ranked = lambda xs, n: F.transform(xs, lambda x: F.struct(x.alias("alias"), F.lit(n).alias("pr")))
    none = F.array().cast("array<struct<alias:string,pr:int>>")
    tried = F.concat(
        ranked(F.array(F.col("to")), 0),
        F.when(F.startswith("to", F.lit(".")), ranked(relative, 1)).otherwise(none),
        F.when(F.startswith("to", F.lit("@/")), ranked(F.array(F.concat(F.lit(app_root), F.substring("to", 3, 1 << 20))), 2)).otherwise(none),
        F.when(~F.startswith("to", F.lit(".")), ranked(F.array_distinct(names), 3)).otherwise(none),
    )
    tries = e.select("edge_from", "to", F.explode(tried).alias("t")).select("edge_from", "to", "t.alias", "t.pr")
    # The first two ways name paths themselves, the others aliases.
    whole = tries.where("pr < 2").join(files.select(F.col("path").alias("alias"), "path").distinct(), "alias")
    by_name = tries.where("pr >= 2").join(module_aliases(files), "alias")
    found = whole.unionByName(by_name).withColumn("first", F.min("pr").over(Window.partitionBy("edge_from", "to")))
    return found.where("pr = first").select("edge_from", F.col("path").alias("target")).distinct()
