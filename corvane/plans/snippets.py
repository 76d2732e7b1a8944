"""Snippet, search and budget queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import budget, snippets
from corvane.plans.ranking import STOPS, TOKENS
from corvane.session import table

FOCUS = ["idiot", "clown", "version", "trash"]
PATTERN = "licen[cs]ed?|apache"


def exact_dedup(spark, d):
    """Texts alike up to case and blanks: the class's smallest id and size, one row per document."""
    docs = table(spark, d, "documents").select("doc_id", T.fingerprint("text").alias("fp"))
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return docs.join(classes, "fp").select("doc_id", "fp", "class_id", "copies")


def structural_sig(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.structural_signature("text"), 256).alias("signature"))


def snippet_window(spark, d):
    out = snippets.snippet_window(table(spark, d, "documents"), "doc_id", "text", FOCUS, 1)
    return out.select("doc_id", "line_start", "line_end", "matched", F.sha1("content").alias("content_sha1"))


def rule_compress(spark, d):
    """Rule compression of every document."""
    out = snippets.compress_lines(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_lines", "kept_lines", "dropped_imports", "dropped_comments", "dropped_blanks", F.sha1("content").alias("content_sha1"))


COMPRESS_TOKENS = ["idiot", "license", "import", "thread"]


def snippet_compression(spark, d):
    """All five rules on every document as a snippet of 3,000 characters; those of even n_chars have a symbol."""
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    out = snippets.compress(docs, "text", F.array(*[F.lit(t) for t in COMPRESS_TOKENS]), 3000, F.col("n_chars") % 2 == 0)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("trim_import_block", "trim_comment_block", "collapse_blank_runs", "drop_low_signal", "truncate_max_chars", "original_chars", "compressed_chars", "saved_chars")], "dropped", F.round("coverage", 6).alias("coverage"), F.sha1("compressed").alias("content_sha1"))


def near_dup_pairs(spark, d):
    return snippets.near_duplicate_pairs(table(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dup_classes(spark, d):
    return snippets.near_duplicate_classes(table(spark, d, "documents"), "doc_id", "text")


def grep_matches(spark, d):
    out = snippets.grep(table(spark, d, "documents"), "doc_id", "text", PATTERN)
    return out.select("doc_id", "line", "column", "match", "line_text", F.sha1("snippet").alias("snippet_sha1"))


def grep_first(spark, d):
    """The first 50 matches of all."""
    return snippets.grep(table(spark, d, "documents"), "doc_id", "text", "idiot", limit=50).select("doc_id", "line", "column", "match")


def budget_pack(spark, d):
    """Each source's documents, those with most task tokens first, packed into 24,000 characters and 60 snippets."""
    docs = table(spark, d, "documents")
    head = docs.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(T.token_hits("text", TOKENS)), "doc_id")))
    return snippets.pack_budget(head, "source", "rn", "text", 24000, 60).select("source", "rank", F.col("chars").cast("long").alias("chars"), F.col("used").cast("long").alias("used"))


def token_estimate(spark, d):
    docs = table(spark, d, "documents")
    head = F.least(F.char_length("text"), F.lit(600))
    return docs.select("doc_id", T.token_estimate(F.char_length("text"), 1.1).alias("tokens"), F.round(T.reduction_ratio(T.token_estimate(head), T.token_estimate(F.char_length("text"))), 6).alias("saved"))


def intent_budget(spark, d):
    """Intent and adaptive budget of every first user turn (the task) with its conversation's turns as changes."""
    c = table(spark, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.count("*").alias("changed"), F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("t")).where("t is not null")
    t = turns.select("conv_id", "changed", F.col("t.text").alias("task")).withColumn("n_tokens", F.size(T.task_tokens("task")))
    t = t.withColumns({"intent": budget.intent(F.col("task")), "cx": budget.complexity(F.col("n_tokens"), F.col("changed"), F.lit(0.0))})
    return t.select("conv_id", "intent", F.round("cx", 4).alias("complexity"), *[v.alias(k) for k, v in budget.budget(F.col("intent"), F.col("cx")).items()])


def auto_budget_preset(spark, d):
    b = table(spark, d, "benchmark").union(table(spark, d, "conversations").where("turn = 0").select("conv_id", "text"))
    b = b.withColumn("n", F.size(T.task_tokens("text")))
    return b.select("item_id", F.sha1("text").alias("task_sha1"), budget.auto_preset(F.col("text"), F.col("n"), (F.col("item_id") % 10).cast("int"), (F.col("item_id") % 5).cast("int")).alias("preset"))


def hotspots(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.size(T.lines("text")).cast("long").alias("lines"), F.size(F.filter(T.lines("text"), lambda x: F.regexp_like(x, F.lit("^(import |from )")))).cast("long").alias("imports")).orderBy(F.desc("lines"), F.desc("bytes"), "doc_id").limit(20)


def missing_modules(spark, d):
    """Distinct script targets named in pages, with the number of pages."""
    p = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z0-9_]+)"'), F.lit(1)))).alias("module"))
    return p.groupBy("module").agg(F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (exact_dedup, structural_sig, snippet_window, rule_compress, snippet_compression, near_dup_pairs, near_dup_classes, grep_matches, grep_first, budget_pack, token_estimate, intent_budget, auto_budget_preset, hotspots, missing_modules)}
_IDS = "regexp_extract_all(lower({}), '[A-Za-z_][A-Za-z0-9_]{{1,63}}')"
_WS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LINES = "l0 AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]') AS x FROM documents), l1 AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS ls FROM l0)"
_N_TOKENS = "len(list_distinct(list_filter(" + _IDS + ", lambda t: NOT list_contains(" + STOPS + ", t))))"
_CASE = lambda x, ks: "(" + " + ".join(f"contains(lower({x}), '{k}')::INT" for k in ks) + ")"
ORACLE = {
    "exact_dedup": f"WITH f AS (SELECT doc_id, sha1({_WS.format('lower(text)')}) AS fp FROM documents) SELECT doc_id, fp, min(doc_id) OVER (PARTITION BY fp) AS class_id, count(*) OVER (PARTITION BY fp) AS copies FROM f",
    "structural_sig": f"SELECT doc_id, sha256({_WS.format(chr(39).join(['regexp_replace(regexp_replace(lower(text), ', '[A-Za-z_][A-Za-z0-9_]*', ', ', 'id', ', ', 'g', '), ', '[0-9]+', ', ', 'num', ', ', 'g', ')']))}) AS signature FROM documents",
    "snippet_window": f"WITH {_LINES}, a AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda y: regexp_matches(lower(y), 'idiot|clown|version|trash')), true) AS hit FROM l1), b AS (SELECT *, greatest(coalesce(hit, 0), 1) AS fo FROM a), c AS (SELECT *, greatest(1, fo - 1)::BIGINT AS line_start, least(len(ls), fo + 1)::BIGINT AS line_end FROM b) SELECT doc_id, line_start, line_end, coalesce(hit, 0) > 0 AS matched, sha1(array_to_string(ls[line_start:line_end], chr(10))) AS content_sha1 FROM c",
    "rule_compress": f"""WITH {_LINES}, a AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, rtrim(unnest(ls)) AS line FROM l1), b AS (SELECT *, trim(line) AS s FROM a),
        k AS (SELECT *, CASE WHEN s = '' THEN 'b' WHEN (starts_with(s, 'import ') OR starts_with(s, 'from ')) AND NOT contains(s, '(') AND NOT contains(s, ')') THEN 'i' WHEN regexp_matches(s, '^(#|//|/\\*|\\*|"{{3}}|''{{3}})') THEN 'c' ELSE 'o' END AS kind FROM b),
        i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) AS g FROM k),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, g ORDER BY n) AS place FROM i), q AS (SELECT *, CASE kind WHEN 'i' THEN place > 12 WHEN 'c' THEN place > 8 WHEN 'b' THEN place > 1 ELSE false END AS gone FROM p)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT gone) AS kept_lines, count(*) FILTER (WHERE gone AND kind = 'i') AS dropped_imports, count(*) FILTER (WHERE gone AND kind = 'c') AS dropped_comments, count(*) FILTER (WHERE gone AND kind = 'b') AS dropped_blanks,
        sha1(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS content_sha1 FROM q GROUP BY doc_id""",
    "snippet_compression": f"""WITH {_LINES}, d AS (SELECT doc_id, text, n_chars % 2 = 0 AS sy, {COMPRESS_TOKENS} AS ts FROM documents), h AS (SELECT *, NOT sy AND length(text) > 1200 AND NOT list_bool_or(list_transform(ts, lambda t: contains(lower(text), t))) AS silent FROM d),
        a AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, rtrim(unnest(ls)) AS line FROM l1), b AS (SELECT *, trim(line) AS s FROM a),
        k AS (SELECT *, CASE WHEN s = '' THEN 'b' WHEN (starts_with(s, 'import ') OR starts_with(s, 'from ')) AND NOT contains(s, '(') AND NOT contains(s, ')') THEN 'i' WHEN regexp_matches(s, '^(#|//|/\\*|\\*|"{{3}}|\'\'{{3}})') THEN 'c' ELSE 'o' END AS kind, list_bool_or(list_transform({COMPRESS_TOKENS}, lambda t: contains(lower(line), t))) AND s <> '' AS hit FROM b),
        i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) AS g FROM k),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, g ORDER BY n) AS place FROM i), q AS (SELECT *, CASE kind WHEN 'i' THEN place > 12 WHEN 'c' THEN place > 8 WHEN 'b' THEN place > 1 ELSE false END AS gone FROM p),
        t AS (SELECT doc_id, count(*) FILTER (WHERE gone AND kind = 'i') AS ni, count(*) FILTER (WHERE gone AND kind = 'c') AS nc, count(*) FILTER (WHERE gone AND kind = 'b') AS nb, coalesce(count(*) FILTER (WHERE hit)::DOUBLE / nullif(count(*) FILTER (WHERE s <> ''), 0), 0) AS cov, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS body FROM q GROUP BY doc_id),
        u AS (SELECT h.*, coalesce(ni, 0) AS ni, coalesce(nc, 0) AS nc, coalesce(nb, 0) AS nb, CASE WHEN silent THEN 0 ELSE coalesce(cov, 0) END AS cov, trim(coalesce(body, '') || CASE WHEN ni > 0 THEN chr(10) || '# ... [omitted ' || ni || ' import lines]' ELSE '' END || CASE WHEN nc > 0 THEN chr(10) || '# ... [omitted ' || nc || ' comment lines]' ELSE '' END, chr(10)) AS c FROM h LEFT JOIN t USING (doc_id)),
        v AS (SELECT *, silent OR (NOT sy AND cov <= 0 AND length(c) > 1200) AS dropped FROM u), w AS (SELECT *, NOT dropped AND length(c) > 3000 AS long FROM v),
        x AS (SELECT *, CASE WHEN dropped THEN '' WHEN long THEN rtrim(left(c, 2984)) || chr(10) || '... [truncated]' WHEN c = '' THEN left(text, 3000) ELSE c END AS o FROM w)
        SELECT doc_id, CASE WHEN silent THEN 0 ELSE ni END AS trim_import_block, CASE WHEN silent THEN 0 ELSE nc END AS trim_comment_block, CASE WHEN silent THEN 0 ELSE nb END AS collapse_blank_runs, dropped::INT::BIGINT AS drop_low_signal, long::INT::BIGINT AS truncate_max_chars, length(text) AS original_chars, length(o) AS compressed_chars, greatest(0, length(text) - length(o)) AS saved_chars, dropped, round(cov, 6)::DOUBLE AS coverage, sha1(o) AS content_sha1 FROM x""",
    "near_dup_pairs": f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({_IDS.format('text')})) AS s FROM documents), c AS (SELECT s, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s),
        w AS (SELECT id, len(s) AS n, unnest(s) AS w FROM c), f AS (SELECT *, count(*) OVER (PARTITION BY w) AS df FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY df, w) AS pos FROM f),
        p AS (SELECT id, n, w FROM r WHERE df > 1 AND pos <= n - ceil(0.82 * n) + 1), j AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y USING (w) WHERE x.id < y.id),
        k AS (SELECT a, b, len(list_intersect(x.s, y.s))::DOUBLE AS i, len(x.s) + len(y.s) AS t FROM j JOIN c x ON x.id = a JOIN c y ON y.id = b)
        SELECT a, b, round(i / (t - i), 6) AS similarity FROM k WHERE i / (t - i) >= 0.82 - 1e-12""",
    "near_dup_classes": f"WITH s AS (SELECT doc_id, list_sort(list_distinct({_IDS.format('text')})) AS s FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS members FROM s WHERE len(s) > 0",
    "grep_matches": f"""WITH {_LINES}, a AS (SELECT doc_id, ls, generate_subscripts(ls, 1) AS i, unnest(ls) AS t FROM l1), b AS (SELECT *, regexp_extract_all(t, '(?i)(licen[cs]ed?|apache)', 1) AS ms, string_split_regex(t, '(?i)licen[cs]ed?|apache') AS gaps FROM a WHERE regexp_matches(t, '(?i)licen[cs]ed?|apache')),
        c AS (SELECT *, generate_subscripts(ms, 1) AS k, unnest(ms) AS m FROM b)
        SELECT doc_id, i::BIGINT AS line, (list_sum(list_transform(gaps[:k], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda z: length(z))), 0) + 1)::BIGINT AS "column", m AS match, left(t, 400) AS line_text, sha1(left(array_to_string(ls[greatest(1, i - 1):least(len(ls), i + 1)], chr(10)), 1200)) AS snippet_sha1 FROM c""",
    "grep_first": f"""WITH {_LINES}, a AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS t FROM l1), b AS (SELECT *, regexp_extract_all(t, '(?i)idiot') AS ms, string_split_regex(t, '(?i)idiot') AS gaps FROM a WHERE regexp_matches(t, '(?i)idiot')),
        c AS (SELECT *, generate_subscripts(ms, 1) AS k, unnest(ms) AS m FROM b)
        SELECT doc_id, i::BIGINT AS line, (list_sum(list_transform(gaps[:k], lambda z: length(z))) + 5 * (k - 1) + 1)::BIGINT AS "column", m AS match FROM c ORDER BY doc_id, line, "column" LIMIT 50""",
    "budget_pack": f"""WITH RECURSIVE h AS (SELECT source, length(text) AS c, row_number() OVER (PARTITION BY source ORDER BY {_CASE('text', TOKENS)} DESC, doc_id) AS rn FROM documents),
        f AS (SELECT source, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS c, false AS taken FROM (SELECT DISTINCT source FROM documents)
              UNION ALL SELECT h.source, h.rn, CASE WHEN used + h.c <= 24000 THEN used + h.c ELSE used END, h.c, used + h.c <= 24000 FROM f JOIN h ON h.source = f.source AND h.rn = f.rn + 1)
        SELECT source, rn AS rank, c AS chars, used FROM f WHERE taken""",
    "token_estimate": "SELECT doc_id, greatest(1, round_even(ceil(length(text) / 4.0) * 1.1, 0))::BIGINT AS tokens, round(least(1.0, 1 - greatest(1, ceil(least(length(text), 600) / 4.0)) / greatest(1, ceil(length(text) / 4.0))), 6)::DOUBLE AS saved FROM documents",
    "intent_budget": f"""WITH t AS (SELECT conv_id, count(*) AS changed, min_by(text, turn) FILTER (WHERE role = 'user') AS task FROM conversations GROUP BY conv_id HAVING task IS NOT NULL),
        v AS (SELECT *, {_N_TOKENS.format('task')} AS n, [{', '.join(_CASE('task', k) for k in budget.INTENTS.values())}] AS s FROM t),
        i AS (SELECT *, CASE WHEN list_max(s) = 0 THEN 6 ELSE list_position(s, list_max(s)) END AS k, least(1.0, 0.45 * least(1.0, n / 24.0) + 0.4 * least(1.0, changed / 12.0))::DOUBLE AS cx FROM v)
        SELECT conv_id, [{', '.join(repr(k) for k in [*budget.INTENTS, 'general'])}][k] AS intent, round(cx, 4) AS complexity, """
    + ", ".join(f"greatest(1, round_even({base} * least(greatest([{', '.join(f'{v[i]}::DOUBLE' for v in budget.FACTORS.values())}][k] * (0.75 + 0.55 * cx), 0.65), 1.45), 0))::BIGINT AS {key}" for i, (key, base) in enumerate(budget.BASE.items()))
    + " FROM i",
    "auto_budget_preset": f"""WITH b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations WHERE turn = 0), n AS (SELECT *, {_N_TOKENS.format('text')} AS n, item_id % 10 AS ch, item_id % 5 AS hi, length(trim(text)) AS sz FROM b),
        s AS (SELECT *, least(6, n // 4) + least(5, ch // 2) + (hi >= 3)::INT + 2 * ({_CASE('text', budget.COMPLEX)} > 0)::INT - ({_CASE('text', budget.QUICK)} > 0)::INT AS sc FROM n)
        SELECT item_id, sha1(text) AS task_sha1, CASE WHEN ch <= 1 AND n <= 8 AND sz <= 120 AND sc <= 2 THEN 'tiny' WHEN ch >= 8 OR n >= 20 OR sz >= 260 OR sc >= 8 THEN 'medium' ELSE 'small' END AS preset FROM s""",
    "hotspots": f"WITH {_LINES} SELECT l1.doc_id, strlen(text)::BIGINT AS bytes, len(ls)::BIGINT AS lines, len(list_filter(ls, lambda y: regexp_matches(y, '^(import |from )')))::BIGINT AS imports FROM l1 JOIN documents d ON d.doc_id = l1.doc_id ORDER BY lines DESC, bytes DESC, l1.doc_id LIMIT 20",
    "missing_modules": "WITH m AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([A-Za-z0-9_]+)\"', 1))) AS module FROM pages) SELECT module, count(*) AS pages FROM m GROUP BY module",
}

