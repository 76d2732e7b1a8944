"""From packs to what is verified: test and check selection, changed files put into empty packs, callers of symbols.

All of them take any number of packs (``pack_id``) at once; a pack's lists are ranked before they are gathered
and cut by a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tests of a plan, and how an injected file is marked.
MOST_TESTS = 20
INJECTED = "strict_changed_file_fallback"
LEAST_CHARS = 200
MOST_REASONS = 8


def _first(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)


def target_tests(top: DataFrame, owned: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """Tests that own a pack's files, in the order of ``owned``, the first ``most``: pack_id, target_tests. top: pack_id, path; owned: test_file, owns_file, place."""
    hit = top.select("pack_id", F.col("path").alias("owns_file")).distinct().join(owned.where("test_file <> ''"), "owns_file")
    first = _first(hit.groupBy("pack_id", "test_file").agg(F.min("place").alias("place")), ["pack_id"], ["place", "test_file"], most)
    return first.groupBy("pack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "test_file"))), lambda x: x["test_file"]).alias("target_tests"))


def verify_plan(packs: DataFrame, top: DataFrame, owned: DataFrame, changed: DataFrame, groups: dict[str, str], checks: DataFrame, enabled: list[str] = (), most: int = MOST_TESTS) -> DataFrame:
    """What to verify of every pack: tests and checks, and why: one row a pack.

    Without a changed file all enabled groups' checks are run, else those of the groups of the changed files' endings. A
    check is taken once, at its first place. groups: verify group by ending; checks: group, place, command (a
    configuration, small); without ``enabled`` all groups with a check are. Columns: pack_id, run_all, changed_groups,
    target_tests, target_checks, reason (``run_all`` or ``changed_verify_groups_match``).
    """
    ending = F.regexp_extract(F.lower("path"), r"[^/](\.[^./]+)$", 1)
    mapped = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[ending] if groups else F.lit(None).cast("string")
    of = changed.groupBy("pack_id").agg(F.array_sort(F.collect_set(F.lower(F.trim(mapped)))).alias("changed_groups"))
    p = packs.select("pack_id").distinct().join(of, "pack_id", "left")
    p = p.select("pack_id", F.col("changed_groups").isNull().alias("run_all"), F.coalesce("changed_groups", F.array().cast("array<string>")).alias("changed_groups"))
    use = checks.select(F.lower(F.trim("group")).alias("group"), "place", F.trim("command").alias("command")).where("command <> ''")
    if enabled:
        use = use.where(F.col("group").isin([e.strip().lower() for e in enabled]))
    every = use.groupBy("command").agg(F.min("place").alias("place"))
    listed = lambda rows, *keys: rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "command"))), lambda x: x["command"]).alias("target_checks"))
    whole = listed(every)  # one row
    some = p.select("pack_id", F.explode("changed_groups").alias("group")).join(F.broadcast(use), "group").groupBy("pack_id", "command").agg(F.min("place").alias("place"))
    mine = listed(some, "pack_id").withColumnRenamed("target_checks", "mine")
    none = F.array().cast("array<string>")
    out = p.join(mine, "pack_id", "left").crossJoin(F.broadcast(whole)).join(target_tests(top, owned, most), "pack_id", "left")
    return out.select("pack_id", "run_all", "changed_groups", F.coalesce("target_tests", none).alias("target_tests"), F.when(F.col("run_all"), F.col("target_checks")).otherwise(F.coalesce("mine", none)).alias("target_checks"), F.when(F.col("run_all"), "run_all").otherwise("changed_verify_groups_match").alias("reason"))


def inject_changed(packs: DataFrame, top: DataFrame, snippets: DataFrame, changed: DataFrame, texts: DataFrame, top_n: int = 8, max_snippets: int = 30, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Changed files for packs that a strict scope has left empty: rows of files, and of snippets.

    A pack without a file gets its first ``top_n`` changed files that there are (score 1.0), one without a snippet the heads
    of its first ``max_snippets``. packs: pack_id; top, snippets: pack_id; changed: pack_id, path, place; texts: path, text.
    """
    named = changed.withColumn("path", F.regexp_replace(F.trim(F.replace("path", F.lit("\\"), F.lit("/"))), r"^(\./)+", "")).where("path <> ''").groupBy("pack_id", "path").agg(F.min("place").alias("place"))
    there = named.join(packs.select("pack_id").distinct(), "pack_id", "left_semi").join(texts.select("path").distinct(), "path", "left_semi")
    lacks = lambda rows, n: _first(there.join(rows.select("pack_id").distinct(), "pack_id", "left_anti"), ["pack_id"], ["place", "path"], n)
    files = lacks(top, max(1, top_n)).select("pack_id", F.col("_n").alias("rank"), "path", F.lit(1.0).alias("score"), F.array(F.lit(INJECTED)).alias("reasons"))
    head = F.substring(F.coalesce("text", F.lit("")), 1, max(LEAST_CHARS, most))
    shown = lacks(snippets, max(1, max_snippets)).join(texts.select("path", head.alias("content")), "path")
    content = F.when(F.col("content") == "", "[empty file]").otherwise(F.col("content"))
    lines = F.char_length(content) - F.char_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return files, shown.select("pack_id", F.col("_n").alias("rank"), "path", F.lit(1).alias("line_start"), lines.alias("line_end"), F.lit(INJECTED).alias("reason"), content.alias("content"))


def plan_and_gate(packs: DataFrame, top: DataFrame, snippets: DataFrame, plans: DataFrame, max_affected_files: int = 12, max_snippets: int = 24) -> DataFrame:
    """What every pack affects and what gates it, one row a pack: its first files and snippets, tests and checks.

    Files and snippets are cut by their rank (at most 200 and 240, at least 1) before those without a path or content are
    left out; a snippet's relevance is its file's score in the whole of ``top`` (the last of repeated ones, 0 without one),
    a file has up to ``MOST_REASONS`` reasons. Columns: pack_id, affected_files, minimal_snippets, target_tests,
    target_checks, selected_tests_count, selected_checks_count, selection_reason, scope_files_hint. top: pack_id, rank,
    path, score, reasons; snippets: pack_id, rank, path, line_start, line_end, symbol, content; plans: of ``verify_plan``.
    """
    lists = lambda rows, item, name: rows.groupBy("pack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias(name))
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    named = top.withColumn("path", F.trim("path")).where("path <> ''")
    score = F.round(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), 6)
    first = named.where(F.col("rank") <= max(1, min(200, max_affected_files)))
    scores = named.groupBy("pack_id", "path").agg(F.max_by(score, F.struct("rank", score.alias("score"))).alias("relevance_score"))
    files = first.join(scores, ["pack_id", "path"]).withColumn("file", F.struct(F.col("rank").cast("long").alias("rank"), "path", F.col("relevance_score").alias("score"), F.slice(filled(F.col("reasons")), 1, MOST_REASONS).alias("reasons")))
    shown = snippets.where(F.col("rank") <= max(1, min(240, max_snippets))).withColumn("path", F.trim("path")).where((F.col("path") != "") & F.regexp_like("content", F.lit(r"\S")))
    begin = F.greatest(F.lit(1), F.coalesce("line_start", F.lit(1))).cast("long")
    text = F.struct("path", begin.alias("line_start"), F.greatest(begin, F.coalesce(F.col("line_end").cast("long"), begin)).alias("line_end"), F.trim(F.coalesce("symbol", F.lit(""))).alias("symbol"), "content", F.coalesce("relevance_score", F.lit(0.0)).alias("relevance_score"))
    out = packs.select("pack_id").distinct().join(lists(files, F.col("file"), "affected_files"), "pack_id", "left")
    out = out.join(lists(shown.join(scores, ["pack_id", "path"], "left"), text, "minimal_snippets"), "pack_id", "left").join(plans, "pack_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    tests, checks = filled(F.col("target_tests")), filled(F.col("target_checks"))
    return out.select("pack_id", empty("affected_files").alias("affected_files"), empty("minimal_snippets").alias("minimal_snippets"), tests.alias("target_tests"), checks.alias("target_checks"), F.size(tests).cast("long").alias("selected_tests_count"), F.size(checks).cast("long").alias("selected_checks_count"), F.coalesce("reason", F.lit("")).alias("selection_reason"), F.transform(empty("affected_files"), lambda f: f["path"]).alias("scope_files_hint"))


def callers(symbols: DataFrame, references: DataFrame, most: int = 20) -> DataFrame:
    """Who calls each symbol: symbol, file, n_callers, called_by (the first ``most``, in order of first sight).

    A reference calls a symbol by its name or qualified name, in any case; one that doesn't, but points to the symbol's
    file, calls it too. symbols: symbol, qualified_name, file; references: target_symbol, edge_to, source_symbol, place.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    s = symbols.select("symbol", "file", low("symbol").alias("name"), low("qualified_name").alias("qname"), F.lower(F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), r"^\./", "")).alias("path")).distinct()
    r = references.select(low("target_symbol").alias("target"), low("edge_to").alias("dst"), F.trim("source_symbol").alias("source"), "place").where("source <> ''")
    r = r.groupBy("target", "dst", "source").agg(F.min("place").alias("place"))
    names = s.select("symbol", "file", F.explode(F.array_distinct(F.array("name", "qname"))).alias("target"))
    by_name = names.join(r.groupBy("target", "source").agg(F.min("place").alias("place")), "target").select("symbol", "file", "source", "place")
    to_file = s.join(r, s.path == r.dst).where((F.col("target") != F.col("name")) & (F.col("target") != F.col("qname"))).select("symbol", "file", "source", "place")
    calls = by_name.union(to_file).groupBy("symbol", "file", "source").agg(F.min("place").alias("place"))
    first = _first(calls, ["symbol", "file"], ["place", "source"], most)
    n = calls.groupBy("symbol", "file").agg(F.count("*").alias("n_callers"))
    shown = first.groupBy("symbol", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "source"))), lambda x: x["source"]).alias("called_by"))
    return n.join(shown, ["symbol", "file"])
