"""Document fingerprints from closed syncmers (DataFrame and SQL functions only).

A k-mer is a closed syncmer if the smallest of its inner s-mers (by hash) is its first or its last.
Whether it is one depends on the k-mer alone, so an edit changes only the anchors it touches. Units
are words (k = 4, s = 2), and characters (k = 10, s = 4) for texts of up to ``CHARS_UP_TO`` words,
where words are too few; texts of ``WORDS_FROM`` to ``CHARS_UP_TO`` words have both. A text with
fewer than k units is one k-mer. The fingerprint keeps the ``SKETCH`` smallest distinct 32-bit
hashes of the syncmers of each kind, which estimates the Jaccard similarity of all of them:
``likeness`` is the share of the smallest ``SKETCH`` hashes of both texts that both have. It takes
the kind that both have, characters first.

``anchors`` gives the syncmers with their positions, for positional matching by a join.

Defined cases: a null text counts as empty; an empty text's fingerprint is empty, like only itself
(likeness 1). Equal texts have equal fingerprints. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import documents, written

WORD_K, WORD_S = 4, 2
CHAR_K, CHAR_S = 10, 4
WORDS_FROM, CHARS_UP_TO = 24, 96
SKETCH = 64


def _mer(array: str, at: str, n: int) -> str:
    return f"xxhash64({', '.join(f'get({array}, {at} + {j})' for j in range(n))})"


def _selected(units: str, smers: str, k: int, s: int) -> Column:
    """(position, hash) of the closed syncmers of an array of unit hashes whose s-mers are given."""
    m = k - s + 1
    inner = f"get({smers}, i + 1)" if m == 3 else f"array_min(slice({smers}, i + 2, {m - 2}))"
    return F.expr(
        f"""CASE WHEN size({units}) = 0 THEN array()
        WHEN size({units}) < {k} THEN array(named_struct('pos', 0, 'hash', xxhash64({units}) & 4294967295L))
        ELSE transform(filter(sequence(0, size({units}) - {k}), i -> least(get({smers}, i), get({smers}, i + {m - 1})) <= {inner}),
                       i -> named_struct('pos', i, 'hash', xxhash64(get({smers}, i), get({smers}, i + {m - 1}), {', '.join(f'get({units}, i + {j})' for j in range(s, k - s))}) & 4294967295L)) END"""
        if k > 2 * s
        else f"""CASE WHEN size({units}) = 0 THEN array()
        WHEN size({units}) < {k} THEN array(named_struct('pos', 0, 'hash', xxhash64({units}) & 4294967295L))
        ELSE transform(filter(sequence(0, size({units}) - {k}), i -> least(get({smers}, i), get({smers}, i + {m - 1})) <= {inner}),
                       i -> named_struct('pos', i, 'hash', xxhash64(get({smers}, i), get({smers}, i + {m - 1})) & 4294967295L)) END"""
    )


def _with_syncmers(df: DataFrame, text_col: str) -> DataFrame:
    """df with array columns ``s_w`` and ``s_c`` of (pos, hash); null where a kind isn't used."""
    out = df.withColumn("s_words", F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda x: x != ""))
    out = out.withColumns(
        {
            "s_uw": F.when(F.size("s_words") >= WORDS_FROM, F.transform("s_words", lambda x: F.xxhash64(x))),
            "s_uc": F.when(F.size("s_words") <= CHARS_UP_TO, F.transform(F.filter(F.split(F.coalesce(text_col, F.lit("")), ""), lambda x: x != ""), lambda x: F.xxhash64(x))),
        }
    ).drop("s_words")
    mers = lambda u, s: F.expr(f"CASE WHEN size({u}) < {s} THEN array() ELSE transform(sequence(0, size({u}) - {s}), i -> {_mer(u, 'i', s)}) END")
    out = out.withColumns({"s_mw": mers("s_uw", WORD_S), "s_mc": mers("s_uc", CHAR_S)})
    return out.withColumns(
        {
            "s_w": F.when(F.col("s_uw").isNotNull(), _selected("s_uw", "s_mw", WORD_K, WORD_S)),
            "s_c": F.when(F.col("s_uc").isNotNull(), _selected("s_uc", "s_mc", CHAR_K, CHAR_S)),
        }
    ).drop("s_uw", "s_uc", "s_mw", "s_mc")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per closed syncmer: id_col, unit (``word`` or ``char``), pos (in units), hash."""
    both = _with_syncmers(docs.select(id_col, F.col(text_col).alias("s_text")), "s_text")
    kinds = F.array(F.struct(F.lit("word").alias("unit"), F.col("s_w").alias("a")), F.struct(F.lit("char").alias("unit"), F.col("s_c").alias("a")))
    return both.select(id_col, F.explode(kinds).alias("k")).select(id_col, "k.unit", F.inline("k.a"))


def sketch(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with column ``name``: struct<w, c> of sorted hashes; null for a kind that isn't used."""
    out = _with_syncmers(df, text_col)
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["hash"]))), 1, SKETCH)
    return out.withColumn(name, F.struct(least(F.col("s_w")).alias("w"), least(F.col("s_c")).alias("c"))).drop("s_w", "s_c")


def fingerprint(name: str) -> Column:
    """The sketch as text: each kind's letter and its hashes in eight hexadecimal digits."""
    digits = lambda k: F.coalesce(F.concat(F.lit(k), F.array_join(F.transform(F.col(f"{name}.{k}"), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")), F.lit(""))
    return F.when(F.size(F.col(f"{name}.c")) == 0, F.lit("")).otherwise(F.concat(digits("w"), digits("c")))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the syncmers of two sketches, 0 to 1."""

    def of(kind: str) -> Column:
        x, y = f"{a}.{kind}", f"{b}.{kind}"
        every = f"slice(array_sort(array_union({x}, {y})), 1, {SKETCH})"
        return F.expr(f"CASE WHEN size({x}) = 0 AND size({y}) = 0 THEN 1D ELSE size(array_intersect(array_intersect({x}, {y}), {every})) / cast(size({every}) AS double) END")

    both = lambda kind: F.col(f"{a}.{kind}").isNotNull() & F.col(f"{b}.{kind}").isNotNull()
    return F.when(both("c"), of("c")).when(both("w"), of("w")).otherwise(F.lit(0.0))


def _previous(keys: DataFrame) -> DataFrame:
    """keys (doc_id, h, n; distinct) with the row before each in that order, cyclically: p_id, p_h, p_n.

    Range partitions are numbered and written; inside each the row before is the window's last one,
    and a partition's first row takes the last row of the partition before, one row a partition.
    """
    cut = keys.repartitionByRange("doc_id", "h").withColumn("part", F.spark_partition_id())
    cut = written(cut, "order")
    ends = cut.groupBy("part").agg(F.max(F.struct("doc_id", "h", "n")).alias("end"))
    whole = Window.orderBy("part")  # one row a partition
    last = F.last("end").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("end").over(whole), last).alias("before"))
    inner = F.lag(F.struct("doc_id", "h", "n")).over(Window.partitionBy("part").orderBy("doc_id", "h"))
    p = cut.withColumn("p", inner).join(F.broadcast(ends), "part").withColumn("p", F.coalesce("p", "before"))
    return p.select("doc_id", "h", F.col("p.doc_id").alias("p_id"), F.col("p.h").alias("p_h"), F.col("p.n").alias("p_n"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's sketch, its edited text's, the next document's, and their likenesses.

    Next is the next row in the order of id (nulls first) and text hash, after the last the first;
    rows alike in both count once in this order and get equal results. The edited text has the last
    floor(n_chars / 4) code points replaced by the first as many of the next text. Texts are shuffled
    once; what each text lends to the one before it goes by a second, smaller shuffle.

    Returns id_col, n_chars, edited, fp, edited_fp, near_edited, near_next.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = rows.select("doc_id", "h", F.char_length("text").alias("n")).distinct()
    before = _previous(keys).withColumnsRenamed({"doc_id": "k_id", "h": "k_h"})
    own = sketch(rows, "text", "fp")
    placed = own.join(before.hint("shuffle_hash"), own.doc_id.eqNullSafe(before.k_id) & (own.h == before.k_h))
    lent = placed.select(F.col("p_id").alias("to_id"), F.col("p_h").alias("to_h"), F.expr("substring(text, 1, p_n div 4)").alias("head"), F.col("fp").alias("next_fp"))
    lent = lent.dropDuplicates(["to_id", "to_h"])
    main = placed.select("doc_id", "h", "text", "fp")
    out = main.join(lent, main.doc_id.eqNullSafe(lent.to_id) & (main.h == lent.to_h))
    n = F.char_length("text")
    out = out.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 4), head)").alias("edited"))
    out = sketch(out, "edited", "edited_fp")
    return out.select(F.col("doc_id").alias(id_col), "n_chars", "edited", "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_edited(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("fp").alias("fingerprint"), fingerprint("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op4_syncmers": op4_syncmers}
ORACLE: dict[str, str] = {}
