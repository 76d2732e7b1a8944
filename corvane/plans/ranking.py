"""Ranking queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import graph, rank
from corvane.session import table

TASK = "Fix the trash thread rerank: idiot clown version of tion_ring and apache license, then the loser"
TOKENS = T.py_task_tokens(TASK)
HINTS = ["doc_1", "doc_77"]
CHANGED = ["doc_7", "doc_3", "doc_90"]
_SQL_TOKENS = "[" + ", ".join(f"'{t}'" for t in TOKENS) + "]"
_HITS = " + ".join(f"contains(lower(text), '{t}')::INT" for t in TOKENS)
N = len(TOKENS)
SIGNALS = ("symbol", "reference", "dependency", "signature", "relation", "test", "structural", "syntax_unit", "changed")
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def task_tokens(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.posexplode(T.task_tokens("text")).alias("pos", "token")).select("item_id", F.col("pos").cast("long").alias("pos"), "token")


def token_hits(spark, d):
    hits = T.token_hits("text", TOKENS)
    return table(spark, d, "documents").select("doc_id", hits.alias("hits"), F.round(T.normalized_hits(hits, N), 6).alias("match"))


def _files(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("file"))
    ls = F.split(F.coalesce("text", F.lit("")), "\n")  # name, qualified name and relation target of a file's symbol
    symbols = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("file"), F.get(ls, F.lit(0)).alias("symbol"), F.get(ls, F.lit(1)).alias("qualified_name"), F.col("source").alias("signature"), F.array_compact(F.array(F.get(ls, F.lit(2)))).alias("relation_targets"), F.lit(1).alias("line_start"), F.size(ls).alias("line_end"))
    # A part's references: one row per line of an order, by the part's name.
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    refs = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("doc_"), "l_suppkey").alias("file"), F.col("p_name").alias("target_symbol"), F.col("p_type").alias("source_symbol"))
    deps = table(spark, d, "supplier").select(F.concat(F.lit("doc_"), "s_suppkey").alias("edge_from"), F.concat(F.lit("thread."), "s_nationkey").alias("edge_to"))
    tests = table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("owns_file"))
    return files, symbols, refs, deps, tests


def rank_score(spark, d):
    li = table(spark, d, "lineitem")
    edges = li.select(F.concat(F.lit("doc_"), "l_suppkey").alias("src"), F.concat(F.lit("doc_"), "l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "A", 10).when(F.col("l_returnflag") == "N", 8).otherwise(7).alias("weight"))
    seeds = spark.createDataFrame([(c,) for c in CHANGED], "node string")
    near = graph.proximity(graph.relation_graph(edges), seeds).withColumnRenamed("node", "file")
    scored = rank.score_files(*_files(spark, d), TOKENS, CHANGED, near)
    return scored.select("file", F.round("score", 4).alias("score"), *[F.round(f"s_{k}", 4).alias(f"s_{k}") for k in SIGNALS], F.concat_ws(",", "reasons").alias("reasons")).orderBy(F.desc("score"), "file").limit(12)


_RANK_SQL = f"""
f AS (SELECT 'doc_' || doc_id AS file, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
s AS (SELECT file, h(ls[1]) + h(coalesce(ls[2], '')) AS sh, h(concat_ws(' ', ls[1], ls[2], source, ls[3])) AS gh, h(coalesce(ls[3], '')) AS xh, (len(ls) > 1)::INT AS u FROM f),
e AS (SELECT 'doc_' || l_suppkey AS src, 'doc_' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 8 ELSE 7 END AS weight FROM lineitem),
g AS (SELECT src, dst, sum(weight) AS w FROM e WHERE src <> dst GROUP BY src, dst), ng AS (SELECT src, dst, round(w::DOUBLE / max(w) OVER (PARTITION BY src), 6) AS weight FROM g),
p0 AS (SELECT src AS file, 0.7 * max(weight) AS p FROM ng WHERE dst IN ('doc_7', 'doc_3', 'doc_90') GROUP BY src UNION ALL SELECT dst, 0.3 * max(weight) FROM ng WHERE src IN ('doc_7', 'doc_3', 'doc_90') GROUP BY dst),
pr AS (SELECT file, sum(p) AS p FROM p0 GROUP BY file),
r AS (SELECT 'doc_' || l_suppkey AS file, sum(h(p_name) + h(p_type)) AS rh FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
dd AS (SELECT 'doc_' || s_suppkey AS file, sum(h('thread.' || s_nationkey)) AS dh FROM supplier GROUP BY 1),
t AS (SELECT 'doc_' || doc_id AS file, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1),
j AS (SELECT file, sh, gh, xh, coalesce(pr.p, 0) AS p, coalesce(rh, 0) AS rh, coalesce(dh, 0) AS dh, coalesce(t.n, 0) AS tn, u FROM s LEFT JOIN r USING (file) LEFT JOIN dd USING (file) LEFT JOIN t USING (file) LEFT JOIN pr USING (file)),
k AS (SELECT file, least(1.0, sh / {N}.0) AS s_symbol, least(1.0, rh / {N}.0) AS s_reference, least(1.0, dh / {N}.0) AS s_dependency, least(1.0, gh / ({N} * 1.8)) AS s_signature,
      least(1.0, tn / 3.0) AS s_test, least(1.0, xh / ({N} * 1.2)) AS s_structural, least(1.0, p) AS s_relation, least(1.0, u / 4.0) AS s_syntax_unit, (file IN ('doc_7', 'doc_3', 'doc_90'))::INT::DOUBLE AS s_changed FROM j)
"""


def hint_boost_rank(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("file"), T.normalized_hits(T.token_hits("text", TOKENS), N).alias("score"))
    out = rank.pin_changed(rank.hint_boost(docs, HINTS, "file"), CHANGED)
    return out.select("file", F.round("score", 6).alias("score"), F.col("pin").cast("long").alias("pin")).orderBy(F.asc_nulls_last("pin"), F.desc("score"), "file").limit(20)


def bm25_topk(spark, d):
    docs = table(spark, d, "documents")
    head = docs.select("doc_id", T.normalized_hits(T.token_hits("text", TOKENS), N).alias("base")).orderBy(F.desc("base"), "doc_id").limit(200)
    scored = head.join(rank.bm25(docs, TOKENS, "doc_id", "text"), "doc_id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    norm = rank.min_max(F.col("bm25"), Window.partitionBy())  # 200 rows
    out = scored.withColumn("lexical", norm).withColumn("score", 0.8 * F.col("base") + 0.2 * F.col("lexical"))
    return out.select("doc_id", F.round("bm25", 4).alias("bm25"), F.round("lexical", 4).alias("lexical"), F.round("score", 4).alias("score"))


def project_stats(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


def eval_metrics(spark, d):
    """Every benchmark item is a case: its passage is searched by all its tokens, expected are the documents that hold all of it.

    Recall is the share of the expected ones found, for the cases that have any; every case counts for the rest.
    """
    cases = table(spark, d, "benchmark").select("item_id", "text", T.task_tokens("text").alias("tokens"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", T.semantic_tokens("text", None).alias("words"), "text")
    # Cases meet documents on their tokens. A document that holds a passage has all its whole words, so it is among these.
    terms = cases.select("item_id", F.explode("tokens").alias("w"))
    pairs = docs.select("doc_id", F.explode("words").alias("w")).join(terms, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    ranked = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    # Who may hold the passage: documents with all its tokens but the first and the last, which may be parts of longer words.
    near = ranked.join(cases.select("item_id", F.size("tokens").alias("n"), F.col("text").alias("passage")), "item_id").where("score >= n - 2 or rn <= 10")
    held = near.join(docs.select("doc_id", "text", "n_chars"), "doc_id").withColumn("hit", F.contains("text", F.col("passage")).cast("int"))
    top = lambda k: F.sum(F.when(F.col("rn") <= k, F.col("hit")))
    per = held.groupBy("item_id").agg(F.sum("hit").alias("expected"), (top(5) / F.nullif(F.sum("hit"), F.lit(0))).alias("r5"), (top(10) / F.nullif(F.sum("hit"), F.lit(0))).alias("r10"), F.max(F.when((F.col("hit") == 1) & (F.col("rn") <= 10), 1.0 / F.col("rn"))).alias("rr"), F.sum(F.when(F.col("rn") <= 10, F.col("n_chars"))).alias("chars"))
    per = cases.select("item_id").join(per, "item_id", "left").select("item_id", F.coalesce("expected", F.lit(0)).alias("expected"), "r5", "r10", F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce("chars", F.lit(0)).alias("chars"))
    # The 95th percentile by its place in the order; the count goes along, so no list of all cases is made.
    total = per.agg(F.count("*").alias("cases"), F.count("r5").alias("judged"), F.round(F.avg("r5"), 6).alias("recall_at_5"), F.round(F.avg("r10"), 6).alias("recall_at_10"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("chars"), 4).alias("avg_chars"))
    places = per.groupBy("chars").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total.select("cases")))  # one row
    upto = F.sum("n").over(Window.orderBy("chars"))  # distinct sums of ten documents
    p95 = places.withColumn("upto", upto).where("upto > bround(0.95 * (cases - 1))").agg(F.min("chars").alias("p95_chars"))
    return total.crossJoin(p95)  # one row each


QUERIES = {f.__name__: f for f in (task_tokens, token_hits, rank_score, hint_boost_rank, bm25_topk, project_stats, eval_metrics)}
_H = lambda x: "(" + " + ".join(f"contains(lower({x}), '{t}')::INT" for t in TOKENS) + ")"


def _expand(sql: str) -> str:
    """Writes out h(x), the number of task tokens in x."""
    out, i = "", 0
    while (j := sql.find("h(", i)) >= 0:
        if j and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out += sql[i : j + 2]
            i = j + 2
            continue
        depth, k = 1, j + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out += sql[i:j] + _H(sql[j + 2 : k - 1])
        i = k
    return out + sql[i:]


_IDS = "regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]{1,63}')"
ORACLE = {
    "task_tokens": f"""WITH r AS (SELECT item_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS p FROM (SELECT item_id, {_IDS} AS ts FROM benchmark)),
        g AS (SELECT item_id, token, min(p) AS p FROM r WHERE NOT list_contains({STOPS}, token) GROUP BY item_id, token)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p) - 1 AS pos, token FROM g""",
    "token_hits": f"SELECT doc_id, ({_HITS})::BIGINT AS hits, round(least(1.0, ({_HITS})::DOUBLE / {N}), 6)::DOUBLE AS match FROM documents",
    "rank_score": "WITH " + _expand(_RANK_SQL) + """ SELECT file, round(0.24 * s_symbol + 0.2 * s_reference + 0.13 * s_dependency + 0.12 * s_signature + 0.1 * s_relation + 0.1 * s_test + 0.08 * s_structural + 0.03 * s_syntax_unit + 0.12 * s_changed, 4)::DOUBLE AS score,
        """ + ", ".join(f"round(s_{k}, 4)::DOUBLE AS s_{k}" for k in SIGNALS) + ", coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN s_{k} > 0 THEN '{v}' END" for k, v in rank.REASONS.items()) + "), ''), 'baseline') AS reasons FROM k ORDER BY score DESC, file LIMIT 12",
    "hint_boost_rank": f"""WITH a AS (SELECT 'doc_' || doc_id AS file, least(1.0, ({_HITS})::DOUBLE / {N}) AS s FROM documents),
        b AS (SELECT file, s + CASE WHEN contains(file, 'doc_1') OR contains(file, 'doc_77') THEN 0.05 ELSE 0 END AS score, nullif(list_position(['doc_7', 'doc_3', 'doc_90'], file), 0)::BIGINT AS pin FROM a)
        SELECT file, round(score, 6)::DOUBLE AS score, pin FROM b ORDER BY pin ASC NULLS LAST, b.score DESC, file LIMIT 20""",
    "bm25_topk": f"""WITH h AS (SELECT doc_id, least(1.0, ({_HITS})::DOUBLE / {N}) AS base FROM documents ORDER BY base DESC, doc_id LIMIT 200),
        k AS (SELECT doc_id, {_IDS} AS ts FROM documents), l AS (SELECT doc_id, len(ts) AS dl, ts FROM k WHERE len(ts) > 0),
        q AS (SELECT unnest({_SQL_TOKENS}) AS w), st AS (SELECT count(*) AS n, avg(dl) AS al FROM l),
        tf AS (SELECT doc_id, dl, w, len(list_filter(ts, lambda x: x = w)) AS f FROM l, q), df AS (SELECT w, count(*) FILTER (WHERE f > 0) AS df FROM tf GROUP BY w),
        b AS (SELECT doc_id, sum(CASE WHEN f > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / al)) ELSE 0 END) AS bm25 FROM tf JOIN df USING (w), st GROUP BY doc_id),
        j AS (SELECT doc_id, base, coalesce(bm25, 0) AS bm25 FROM h LEFT JOIN b USING (doc_id)), m AS (SELECT *, min(bm25) OVER () AS lo, max(bm25) OVER () AS hi FROM j),
        z AS (SELECT *, CASE WHEN hi - lo <= 1e-9 THEN CASE WHEN hi <= 0 THEN 0 ELSE 0.5 END ELSE (bm25 - lo) / (hi - lo) END AS lexical FROM m)
        SELECT doc_id, round(bm25, 4)::DOUBLE AS bm25, round(lexical, 4)::DOUBLE AS lexical, round(0.8 * base + 0.2 * lexical, 4)::DOUBLE AS score FROM z""",
    "project_stats": "SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "eval_metrics": f"""WITH c AS (SELECT item_id, unnest(list_distinct(ts)) AS w FROM (SELECT item_id, {_IDS} AS ts FROM benchmark)), c1 AS (SELECT * FROM c WHERE NOT list_contains({STOPS}, w)),
        dw AS (SELECT DISTINCT doc_id, unnest({_IDS}) AS w FROM documents),
        s AS (SELECT item_id, doc_id, count(*) AS score FROM dw JOIN c1 USING (w) GROUP BY item_id, doc_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s QUALIFY rn <= 10),
        x AS (SELECT item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        h AS (SELECT k.item_id, rn, n_chars, (x.doc_id IS NOT NULL)::INT AS hit FROM k JOIN documents USING (doc_id) LEFT JOIN x USING (item_id, doc_id)),
        n AS (SELECT item_id, count(*) AS expected FROM x GROUP BY item_id),
        p AS (SELECT item_id, sum(CASE WHEN rn <= 5 THEN hit END)::DOUBLE AS h5, sum(hit)::DOUBLE AS h10, max(CASE WHEN hit = 1 THEN 1.0::DOUBLE / rn END) AS rr, sum(n_chars)::BIGINT AS chars FROM h GROUP BY item_id),
        q AS (SELECT b.item_id, CASE WHEN expected > 0 THEN coalesce(h5, 0) / expected END AS r5, CASE WHEN expected > 0 THEN coalesce(h10, 0) / expected END AS r10, coalesce(rr, 0) AS rr, coalesce(chars, 0) AS chars FROM benchmark b LEFT JOIN n USING (item_id) LEFT JOIN p USING (item_id))
        SELECT count(*) AS cases, count(r5) AS judged, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr, round(avg(chars), 4) AS avg_chars,
        list_sort(list(chars))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95_chars FROM q""",
}
