"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

A logistic model over text metrics (see ``quality_rules.metrics``), fitted on a bounded sample of
labelled rows, gives each document's probability of good quality. Sites are a hierarchy: all
documents, host, path within host. Every level's rate is a beta-binomial posterior mean whose prior
is the level above: hosts shrink toward the global mean, paths toward their host's posterior, with
prior strengths estimated by the method of moments from the spread between sites, so a sparse site
says what its parents say. A document's score adds its path's log odds, relative to the global ones,
to its own; it is left out of its own site's counts.

Only counts, sums and sums of squares per (host, path) are shuffled, partially aggregated, in whole
millionths, so that they don't depend on the order of adding. A host with a third of all rows sends
one row per task.

Defined cases: null and empty texts are judged by their metrics (no words). Null hosts and paths are
sites of their own. Without labels of both kinds the evidence is even (0.5). Repeated rows are judged
alike and count as often as they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents, written
from corvane.llm.quality_rules import metrics
from corvane.llm.toxicity import held_out

#: Most labelled rows of each kind that the evidence model is fitted on: those with the smallest hash of their id.
SAMPLE = 5000
MICRO = 1_000_000
KEEP_FROM = 0.5
STRENGTH = (1.0, 1000.0)


def features() -> list[Column]:
    n = F.greatest(F.col("q_n_words"), F.lit(1))
    return [
        F.log1p(F.col("q_symbol_pm").cast("double")),
        F.col("q_n_repeat_words") / n,
        F.col("q_dup_line_pm") / 1000,
        F.col("q_stutter_pm") / 1000,
        F.least(F.col("q_word_chars") / n, F.lit(30.0)),
        F.log1p(n.cast("double")),
        F.log1p(1000 * F.col("q_marks") / F.greatest(F.col("q_word_chars"), F.lit(1))),
    ]


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """Metrics of every row, without its text."""
    t = F.coalesce(text_col, F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    base = base.withColumn("q_marks", F.char_length(t) - F.char_length(F.replace(F.replace(t, F.lit("!"), F.lit("")), F.lit("?"), F.lit(""))))
    m = metrics(base, "text")
    return written(m.select("doc_id", "host", "path", F.array(*features()).alias("x")), "quality-evidence")


def fit(rows: list[tuple[list[float], int]]) -> tuple[list[float], float]:
    """Ridge logistic regression on (features, label); weights and intercept in the features' own units."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return [0.0] * len(features()), 0.0
    x = np.array([r[0] for r in rows], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-6 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    own = w[1:] / scale
    return [round(float(v), 9) for v in own], round(float(w[0] - mean @ own), 9)


def evidence(rows: DataFrame, weights: list[float], base: float) -> DataFrame:
    """rows with column ``p``: the document's own probability in millionths, away from 0 and 1."""
    z = F.lit(base)
    for i, w in enumerate(weights):
        z = z + F.lit(w) * F.col("x")[i]
    return rows.withColumn("p", F.least(F.greatest(F.round(MICRO / (1 + F.exp(-z))), F.lit(100.0)), F.lit(MICRO - 100.0)).cast("long"))


def _strength(n: str, s: str) -> Column:
    """Prior strength of one level by the method of moments, from its sites' counts n and sums s (an aggregate)."""
    total, good = F.sum(n), F.sum(s) / MICRO
    m = good / total
    between = F.sum(F.col(n) * F.pow(F.col(s) / MICRO / F.col(n), 2)) / total - m * m
    noise = m * (1 - m) * F.count("*") / total
    k = m * (1 - m) / F.greatest(between - noise, F.lit(1e-9)) - 1
    return F.least(F.greatest(k, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def combine(judged: DataFrame) -> DataFrame:
    """judged (doc_id, host, path, p; read twice) with host_rate, path_rate and score."""
    sites = judged.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum("p").alias("ps"))
    hosts = sites.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    # One row: the global mean and the two strengths.
    top = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), _strength("hn", "hs").alias("hk")).crossJoin(F.broadcast(sites.agg(_strength("pn", "ps").alias("pk"))))
    s, h = sites.withColumnsRenamed({"host": "s_host", "path": "s_path"}), hosts.withColumnRenamed("host", "h_host")
    known = s.join(h, s.s_host.eqNullSafe(h.h_host)).join(F.broadcast(top))
    out = judged.join(known, judged.host.eqNullSafe(known.s_host) & judged.path.eqNullSafe(known.s_path))
    part = lambda c: (F.col(c) - F.col("p")) / MICRO  # noqa: E731  the site without this document
    mean = F.when(F.col("gn") > 1, part("gs") / (F.col("gn") - 1)).otherwise(F.lit(0.5))
    out = out.withColumn("g_rate", F.least(F.greatest(mean, F.lit(1e-4)), F.lit(1 - 1e-4)))
    out = out.withColumn("host_rate", (part("hs") + F.col("hk") * F.col("g_rate")) / (F.col("hn") - 1 + F.col("hk")))
    out = out.withColumn("path_rate", (part("ps") + F.col("pk") * F.col("host_rate")) / (F.col("pn") - 1 + F.col("pk")))
    odds = lambda c: F.log(c / (1 - c))
    z = odds(F.col("p") / MICRO) + odds(F.col("path_rate")) - odds(F.col("g_rate"))
    return out.withColumn("score", F.round(1 / (1 + F.exp(-z)), 6)).select("doc_id", "host", "path", F.round(F.col("p") / MICRO, 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), "score")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Every row's evidence, site rates, score (probability of good quality) and whether it is kept."""
    rows = measured(docs, id_col, text_col, host_col, path_col)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    sample = rows.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y").collect()  # of a repeated id the smallest row
    weights, base = fit(sorted((list(r.x), r.y) for r in sample))
    out = combine(evidence(rows, weights, base))
    return out.withColumn("kept", F.col("score") >= KEEP_FROM).withColumnRenamed("doc_id", id_col)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumns({"held_out": held_out(), "predicted": F.col("kept").cast("int")})


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLE: dict[str, str] = {}
