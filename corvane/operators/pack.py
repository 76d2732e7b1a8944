"""The whole context pack of one task: candidates ranked by all signals, then snippets under an adaptive budget.

Whole relations are only aggregated and joined; from the ranked head on (``most`` files, 200) all sides are
bounded by parameters, so they are broadcast and folded in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import budget, context, graph, rank, relations, snippets

# Share of the lexical score, likeness that counts as a repeat (shape, identifiers), lines of a whole syntax unit.
LEXICAL = 0.2
STRUCTURAL, SEMANTIC = 0.92, 0.82
MAX_UNIT_LINES = 320


def rank_candidates(files: DataFrame, symbols: DataFrame, references: DataFrame, dependencies: DataFrame, tests: DataFrame, task: str, changed: list[str] = (), hints: list[str] = (), most: int = 200) -> DataFrame:
    """The first ``most`` files of a task in their order: file, score, reasons, base, bm25, pin, rank.

    Nine signals with relation proximity to changed and hinted files, hints, BM25 over the head's pseudo
    documents (scaled to 0..1, a share of ``LEXICAL``), then changed files first and their neighbours raised.
    Changed files are always in the head. files: path; the relations as in ``rank.score_files`` and
    ``context.pseudo_documents``. An empty table of files gives no row.
    """
    changed, tokens = list(dict.fromkeys(changed)), T.py_task_tokens(task)
    is_changed = F.col("file").isin(changed) if changed else F.lit(False)
    links = relations.relation_links(symbols, references, dependencies, files)
    seeds = relations.seed_files(files, changed, list(hints))
    near = graph.proximity(graph.relation_graph(links), seeds).withColumnRenamed("node", "file")
    scored = rank.score_files(files.select(F.col("path").alias("file")).distinct(), symbols, references, dependencies, tests, tokens, changed, near)
    hinted = rank.hint_boost(scored, list(hints), "file").select("file", F.col("score").alias("base"), "reasons")
    head = graph._checkpoint(hinted.orderBy(F.desc(is_changed), F.desc("base"), "file").limit(most))
    some = F.broadcast(head.select("file"))  # ``most`` rows
    of_head = lambda rows, key: rows.join(some.withColumnRenamed("file", key), key, "left_semi")
    pseudo = context.pseudo_documents(head.select("file"), of_head(symbols, "file"), of_head(references, "file"), of_head(dependencies, "edge_from"), of_head(tests, "owns_file"))
    lexical = head.join(rank.bm25(pseudo, tokens, "file", "text"), "file", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    over = Window.partitionBy()  # ``most`` rows
    blended = lexical.withColumn("score", F.bround((1 - LEXICAL) * F.col("base") + LEXICAL * rank.min_max(F.col("bm25"), over), 6))
    pinned = rank.pin_changed(blended, changed)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("pin"), F.desc("score"), "file"))  # ``most`` rows
    return graph._checkpoint(pinned.select("file", "score", "reasons", "base", "bm25", "pin", place.alias("rank")))


def effective_budget(ranked: DataFrame, task: str, n_changed: int) -> dict[str, int]:
    """Characters, snippets, files and radius by the task's intent and complexity; one row of numbers comes back."""
    twelve = ranked.where("rank <= 12").agg(F.coalesce(F.max("score") - F.min("score"), F.lit(0.0)).alias("spread"))
    cx = budget.complexity(F.lit(len(T.py_task_tokens(task))), F.lit(n_changed), F.col("spread"))
    out = twelve.select(*[v.alias(k) for k, v in budget.budget(budget.intent(F.lit(task)), cx).items()]).first().asDict()
    window = max(1, min(out["max_snippets"], out["top_n_files"]))
    return out | {"per_snippet_max_chars": max(800, min(6000, int(out["max_chars"] / window * 2)))}


def cut_snippets(ranked: DataFrame, symbols: DataFrame, texts: DataFrame, tokens: list[str], top_n: int, radius: int, most: int) -> DataFrame:
    """A snippet of each of the first ``top_n`` files with a text: file, rank, line_start, line_end, raw_chars, content.

    The lines of the symbol that the task names most; of one longer than ``MAX_UNIT_LINES`` the lines around
    its start; without symbols the first line with a token. Then compressed by five rules, cut to ``most``; one without signal is left out.
    texts: file, text.
    """
    top = F.broadcast(ranked.where(F.col("rank") <= top_n).select("file", "rank"))
    held = texts.join(top, "file").select("file", "rank", T.lines("text").alias("ls")).where("size(ls) > 0")
    focus = context.focus_symbols(symbols.join(top, "file", "left_semi"), tokens).select("file", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    named = lambda x: F.exists(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), lambda t: F.contains(F.lower(x), t))
    d = held.join(focus, "file", "left").withColumns({"n": F.size("ls"), "hit": F.array_position(F.transform("ls", named), True)})
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.col("n"), c)).cast("int")
    start = F.when(F.col("a").isNull(), clamp(F.col("hit"))).otherwise(clamp(F.col("a")))
    end = F.greatest(F.col("at"), clamp(F.coalesce("b", "a")))
    d = d.withColumn("at", start).withColumn("to", end).withColumn("whole", F.col("a").isNotNull() & (F.col("to") - F.col("at") < MAX_UNIT_LINES))
    d = d.withColumns({"line_start": F.when(F.col("whole"), F.col("at")).otherwise(clamp(F.col("at") - radius)), "line_end": F.when(F.col("whole"), F.col("to")).otherwise(clamp(F.col("at") + radius))})
    d = d.withColumn("raw", snippets.truncate(F.array_join(F.slice("ls", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"), most))
    small = snippets.compress(d, "raw", F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), most, F.col("a").isNotNull()).where("not dropped")
    return small.select("file", "rank", "line_start", "line_end", F.char_length("raw").alias("raw_chars"), F.col("compressed").alias("content"))


def _repeats(seen: Column, x: Column, structural: float, semantic: float) -> Column:
    """Whether a snippet is like one seen before it: equal, or alike in shape or identifiers."""
    return F.exists(seen, lambda y: (y["fp"] == x["fp"]) | (T.jaccard(y["shape"], x["shape"]) >= structural) | (T.jaccard(y["words"], x["words"]) >= semantic))


def select_snippets(cut: DataFrame, max_chars: int, max_snippets: int, structural: float = STRUCTURAL, semantic: float = SEMANTIC) -> DataFrame:
    """What is taken in rank order: file, rank, line_start, line_end, content, used, and how many were left out as repeats.

    A repeat is left out; one that is too long for what is left is skipped but still counts as seen. Blank
    ones don't count. The fold runs over the task's ``top_n`` snippets in one row. A shape's identifiers are
    ``id`` and ``num`` only, so by shape nearly all code is alike; a ``structural`` over 1 turns that rule off.
    """
    item = F.struct("rank", "file", "line_start", "line_end", "content", T.fingerprint("content").alias("fp"), T.semantic_tokens(T.structural_signature("content")).alias("shape"), T.semantic_tokens("content").alias("words"))
    one = cut.where(F.trim("content") != "").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = one.schema["items"].dataType.elementType.simpleString()
    taken_kind = kind[:-1] + ",used:int>"
    empty = lambda k: F.array().cast(f"array<{k}>")
    start = F.struct(F.lit(0).alias("used"), F.lit(0).cast("long").alias("repeats"), empty(kind).alias("seen"), empty(taken_kind).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        used, again = acc["used"] + F.char_length(x["content"]), _repeats(acc["seen"], x, structural, semantic)
        full, fits = F.size(acc["taken"]) >= max_snippets, used <= max_chars
        seen = F.array_append(acc["seen"], x)
        more = F.array_append(acc["taken"], x.withField("used", used))
        grown = F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), acc["repeats"].alias("repeats"), seen.alias("seen"), F.when(fits, more).otherwise(acc["taken"]).alias("taken"))
        left_out = F.struct(acc["used"].alias("used"), (acc["repeats"] + 1).alias("repeats"), acc["seen"].alias("seen"), acc["taken"].alias("taken"))
        return F.when(full, acc).when(again, left_out).otherwise(grown)

    folded = one.select(F.aggregate("items", start, step).alias("f"))
    return folded.select("f.repeats", F.inline("f.taken")).select("file", "rank", "line_start", "line_end", "content", "used", "repeats")


def compile_pack(task: str, files: DataFrame, symbols: DataFrame, references: DataFrame, dependencies: DataFrame, tests: DataFrame, texts: DataFrame, changed: list[str] = (), hints: list[str] = (), structural: float = STRUCTURAL, semantic: float = SEMANTIC) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """A task's pack: ranked files (``rank_candidates``, the budget's number), snippets (``select_snippets``) and the budget."""
    ranked = rank_candidates(files, symbols, references, dependencies, tests, task, changed, hints)
    b = effective_budget(ranked, task, len(changed))
    cut = cut_snippets(ranked, symbols, texts, T.py_task_tokens(task), b["top_n_files"], b["snippet_radius"], b["per_snippet_max_chars"])
    return ranked.where(F.col("rank") <= b["top_n_files"]), select_snippets(cut, b["max_chars"], b["max_snippets"], structural, semantic), b
