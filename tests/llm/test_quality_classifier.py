import math
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm.quality_classifier import STRENGTH, classify, combine, fit, op7_quality_classifier


def slow_combine(rows):
    """rows: (id, host, path, p in millionths)."""

    def strength(groups):
        n = [len(v) for v in groups.values()]
        mean = [sum(v) / len(v) for v in groups.values()]
        m = sum(a * b for a, b in zip(n, mean, strict=True)) / sum(n)
        between = sum(a * b * b for a, b in zip(n, mean, strict=True)) / sum(n) - m * m
        k = m * (1 - m) / max(between - m * (1 - m) * len(n) / sum(n), 1e-9) - 1
        return min(max(k, STRENGTH[0]), STRENGTH[1])

    paths, hosts, p = defaultdict(list), defaultdict(list), [r[3] / 1e6 for r in rows]
    for r in rows:
        paths[r[1], r[2]].append(r[3] / 1e6)
        hosts[r[1]].append(r[3] / 1e6)
    hk, pk = strength(hosts), strength(paths)
    out = {}
    for (d, h, q, _), own in zip(rows, p, strict=True):
        g = min(max((sum(p) - own) / (len(p) - 1), 1e-4), 1 - 1e-4)
        host = (sum(hosts[h]) - own + hk * g) / (len(hosts[h]) - 1 + hk)
        path = (sum(paths[h, q]) - own + pk * host) / (len(paths[h, q]) - 1 + pk)
        z = math.log(own / (1 - own)) + math.log(path / (1 - path)) - math.log(g / (1 - g))
        out[d] = 1 / (1 + math.exp(-z))
    return out


def test_combine(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b", "c"][int(rng.integers(4))], ["x", "y", None][int(rng.integers(3))], int(rng.integers(1000, 999000))) for i in range(300)]
    rows = [(i, h, q, min(p * (2 if h == "a" else 1), 999000)) for i, h, q, p in rows] + [(300, "rare", "x", 600000)]
    got = {r.doc_id: r.score for r in combine(spark.createDataFrame(rows, "doc_id long, host string, path string, p long")).collect()}
    want = slow_combine(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op7_quality_classifier(spark, d).collect()
    test = [(labels[r.doc_id], r.kept) for r in rows if r.held_out and r.doc_id in labels]
    good = [k for y, k in test if y]
    bad = [k for y, k in test if not y]
    print("kept of good", sum(good) / len(good), "of bad", sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.12


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, lang string, p int"
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classify(spark.createDataFrame([], schema), labels).count() == 0
    rows = [(1, None, None, None, 1), (2, "", "s", None, 1), (2, "", "s", None, 1), (3, "word " * 50_000, "s", "en", 1)]
    out = classify(spark.createDataFrame(rows, schema), labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert len(classify(spark.createDataFrame(rows[:1], schema), labels).collect()) == 1
    assert fit([]) == ([0.0] * 7, 0.0)
