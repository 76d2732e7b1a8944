"""Quality rules with adaptive thresholds per language and source (DataFrame and SQL functions only).

A text's words are what lies between blanks and the control characters 9 to 13. Its metrics, in
permille, are symbols per word character, repeated lines per line and immediate word repeats per
word. Their distribution in each (language, source) is kept as a histogram of whole permilles: a
quantile sketch of bounded size (1,001 counts a metric) that merges by adding counts, gives the same
result whatever the partitioning, and is off by less than one permille. Sketches are of the texts that
pass the base rules. A text fails if a metric is over its group's threshold: an upper quantile of the
group's sketch and a part of that quantile's distance from the median (``RULES``), but no less than the
metric's ``least``, so that a group of all zeros doesn't reject a text for one mark. A group of fewer
than ``MIN_GROUP`` such rows takes its language's sketch, and that of all rows if the language is rare
too. Base rules, the same for all: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent
of the words in 5-word windows that occur twice or more in the text.

Sketches are partially aggregated before their shuffle, so a group with a third of all rows sends at
most 3 x 1,001 counts a task; thresholds are joined by group (small enough to be broadcast by
adaptive execution; a skewed group is split otherwise).

Defined cases: a null or empty text has no words and fails the base rules. Null languages and
sources form groups of their own. Repeated rows are judged alike and count as often as they occur.
An empty table gives no rows. ``filter_quality`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents, written

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 10, 20
MIN_GROUP = 30
#: Of each metric: the quantile in hundredths, tenths of its distance from the median to add, and the least threshold.
RULES = {"symbol_pm": (75, 30, 10), "dup_line_pm": (99, 5, 200), "stutter_pm": (95, 30, 20)}


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, and the text's counts and metrics. Names starting with ``q_`` are taken."""
    text = F.coalesce(text_col, F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    out = docs.withColumns(
        {
            "q_w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)),
            "q_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != ""),
            "q_symbols": (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long"),
        }
    )
    out = out.withColumn("q_h", F.transform("q_w", lambda x: F.xxhash64(x)))
    out = out.withColumn("q_win", F.expr("CASE WHEN size(q_h) < 5 THEN array() ELSE transform(sequence(0, size(q_h) - 5), i -> xxhash64(get(q_h, i), get(q_h, i + 1), get(q_h, i + 2), get(q_h, i + 3), get(q_h, i + 4))) END"))
    # Only a text with a repeated window has its windows sorted.
    out = out.withColumn("q_srt", F.expr("CASE WHEN size(array_distinct(q_win)) < size(q_win) THEN sort_array(transform(q_win, (h, i) -> struct(h, i))) END"))
    out = out.withColumn("q_at", F.expr("sort_array(array_compact(transform(q_srt, (s, i) -> CASE WHEN get(q_srt, i - 1).h = s.h OR get(q_srt, i + 1).h = s.h THEN s.i END)))"))
    n_repeat = F.expr("coalesce(aggregate(q_at, named_struct('p', -5, 't', 0L), (a, x) -> named_struct('p', x, 't', a.t + least(5, x - a.p)), a -> a.t), 0L)")
    out = out.withColumns(
        {
            "q_n_words": F.size("q_w").cast("long"),
            "q_word_chars": F.char_length(F.array_join("q_w", "")).cast("long"),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_n_repeat_words": n_repeat,
            "q_stutter": F.expr("CASE WHEN size(q_h) < 2 THEN 0L ELSE aggregate(sequence(1, size(q_h) - 1), 0L, (a, i) -> a + CASE WHEN get(q_h, i) = get(q_h, i - 1) THEN 1L ELSE 0L END) END"),
        }
    ).drop("q_w", "q_h", "q_win", "q_srt", "q_at", "q_lines")
    pm = lambda a, b: F.least(F.expr(f"{a} * 1000 div greatest({b}, 1)"), F.lit(1000)).cast("int")
    return out.withColumns(
        {
            "q_symbol_pm": pm("q_symbols", "q_word_chars"),
            "q_dup_line_pm": pm("q_n_dup_lines", "q_n_lines"),
            "q_stutter_pm": pm("q_stutter", "q_n_words"),
            "q_base_failed": F.expr(f"q_n_words < {MIN_WORDS} OR 100 * q_n_repeat_words > {MAX_REPEATED} * q_n_words"),
        }
    )


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows per group, metric and permille: columns lang, source, metric, v, n. Merge by adding n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"q_{m}").alias("v")) for m in RULES])
    rows = measured.where("not q_base_failed").select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(pairs).alias("s"))
    return rows.groupBy("lang", "source", "s.metric", "s.v").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """A row per (lang, source) with a threshold column per metric, ``t_<metric>``."""
    levels = {"g": ["lang", "source"], "l": ["lang"], "a": []}
    found = {}
    for name, keys in levels.items():
        merged = sketch.groupBy(*keys, "metric", "v").agg(F.sum("n").alias("n"))
        # At most 1,001 values a group and metric: (v, n) pairs are folded in place.
        folded = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"), F.sum("n").alias("rows"))
        at = lambda hundredths: F.expr(f"aggregate(h, named_struct('c', 0L, 'v', cast(null as int)), (a, x) -> named_struct('c', a.c + x.n, 'v', CASE WHEN a.v IS NULL AND (a.c + x.n) * 100 >= rows * {hundredths} THEN x.v ELSE a.v END), a -> a.v)")
        rule = F.create_map(*[x for m, r in RULES.items() for x in (F.lit(m), F.struct(*[F.lit(v).alias(n) for n, v in zip(("q", "tenths", "least"), r, strict=True)]))])[F.col("metric")]
        folded = folded.withColumn("rule", rule)
        quantiles = folded.select(*keys, "metric", "rows", "rule", at(50).alias("mid"), at("rule.q").alias("high"))
        limit = F.greatest(F.col("rule.least"), F.col("high") + F.expr("rule.tenths * (high - mid) div 10").cast("int"))
        found[name] = quantiles.groupBy(*keys).agg(F.max("rows").alias(f"{name}_rows"), *[F.max(F.when(F.col("metric") == m, limit)).alias(f"{name}_{m}") for m in RULES])
    g, lang, every = found["g"], found["l"].withColumnRenamed("lang", "l_lang"), found["a"]
    out = g.join(lang, g.lang.eqNullSafe(lang.l_lang)).join(F.broadcast(every))  # every: one row
    pick = lambda m: F.when(F.col("g_rows") >= MIN_GROUP, F.col(f"g_{m}")).when(F.col("l_rows") >= MIN_GROUP, F.col(f"l_{m}")).otherwise(F.col(f"a_{m}"))
    return out.select("lang", "source", *[pick(m).alias(f"t_{m}") for m in RULES])


def judge(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measured (see ``metrics``; read twice, so best a written table) with boolean column ``q_kept``."""
    limits = thresholds(sketches(measured, lang_col, source_col)).select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *[F.col(f"t_{m}").alias(f"q_t_{m}") for m in RULES])
    out = measured.join(limits, F.col(lang_col).eqNullSafe(F.col("q_lang")) & F.col(source_col).eqNullSafe(F.col("q_source")), "left")
    fine = ~F.col("q_base_failed")
    for m in RULES:
        fine = fine & (F.col(f"q_{m}") <= F.coalesce(f"q_t_{m}", F.lit(1000)))
    return out.withColumn("q_kept", fine)


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with all their columns. The measured rows are written once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"))
    inside = lambda c: f"q_row.`{c}`"
    kept = judge(written(metrics(rows, inside(text_col)), "quality"), inside(lang_col), inside(source_col)).where("q_kept")
    return kept.select("q_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    measured = written(metrics(docs).drop("text"), "quality")
    names = ["n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(measured).select("doc_id", F.col("q_symbols").alias("n_symbols"), *[F.col(f"q_{n}").alias(n) for n in names])


#: SQL of the judged rows over a table ``docs0``; text_dup_safe: row numbers stand for rows.
JUDGED_SQL = """
q0 AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS tx FROM docs0),
q1 AS (SELECT rid, list_filter(string_split_regex(tx, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         length(tx) - length(regexp_replace(tx, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM q0),
q2 AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q1),
q3 AS (SELECT rid, i, w, lag(w) OVER d AS w0, lead(w, 4) OVER d AS w4,
         concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS k
       FROM q2 WINDOW d AS (PARTITION BY rid ORDER BY i)),
q4 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM q3 WHERE w4 IS NOT NULL),
q5 AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM q4 WHERE c > 1) GROUP BY rid),
q6 AS (SELECT rid, count(*) FILTER (WHERE w = w0) AS stutter FROM q3 GROUP BY rid),
q7 AS (SELECT q0.rid, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(stutter, 0)::BIGINT AS stutter
       FROM q0 JOIN q1 USING (rid) LEFT JOIN q5 USING (rid) LEFT JOIN q6 USING (rid)),
q8 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         least(n_symbols * 1000 // greatest(word_chars, 1), 1000) AS m1, least(n_dup_lines * 1000 // greatest(n_lines, 1), 1000) AS m2,
         least(stutter * 1000 // greatest(n_words, 1), 1000) AS m3 FROM q7),
q9 AS (SELECT lang, source, unnest([1, 2, 3]) AS m, unnest([m1, m2, m3]) AS v FROM q8 WHERE NOT base_failed),
q10 AS (SELECT grouping(lang, source) AS lv, lang, source, m, v, count(*) AS n FROM q9 GROUP BY GROUPING SETS ((lang, source, m, v), (lang, m, v), (m, v))),
q11 AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, m ORDER BY v) AS c, sum(n) OVER (PARTITION BY lv, lang, source, m) AS t FROM q10),
q12 AS (SELECT lv, lang, source, m, max(t) AS t, min(v) FILTER (WHERE c * 100 >= t * 50) AS mid, min(v) FILTER (WHERE c * 100 >= t * [75, 99, 95][m]) AS high FROM q11 GROUP BY lv, lang, source, m),
q13 AS (SELECT *, greatest([10, 200, 20][m], high + [30, 5, 30][m] * (high - mid) // 10) AS lim FROM q12),
q14 AS (SELECT g.lang, g.source, g.m, CASE WHEN g.t >= 30 THEN g.lim WHEN l.t >= 30 THEN l.lim ELSE a.lim END AS lim
        FROM q13 g JOIN q13 l ON g.m = l.m AND g.lang IS NOT DISTINCT FROM l.lang AND l.lv = 1 JOIN q13 a ON g.m = a.m AND a.lv = 3 WHERE g.lv = 0),
q15 AS (SELECT lang, source, max(lim) FILTER (WHERE m = 1) AS t1, max(lim) FILTER (WHERE m = 2) AS t2, max(lim) FILTER (WHERE m = 3) AS t3 FROM q14 GROUP BY lang, source),
judged AS (SELECT q8.*, NOT base_failed AND m1 <= coalesce(t1, 1000) AND m2 <= coalesce(t2, 1000) AND m3 <= coalesce(t3, 1000) AS kept
           FROM q8 LEFT JOIN q15 ON q8.lang IS NOT DISTINCT FROM q15.lang AND q8.source IS NOT DISTINCT FROM q15.source)
"""
ORACLE = {
    "op10_quality_rules": "WITH docs0 AS (SELECT * FROM documents)," + JUDGED_SQL
    + "SELECT q0.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged JOIN q0 USING (rid)"
}
QUERIES = {"op10_quality_rules": op10_quality_rules}
