import zlib

import numpy as np

from corvane.llm.toxicity import Model, op1_toxicity, score_documents, train, training_rows


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op1_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for k, r in got.items())
    test = [k for k in labels if got[k].held_out]
    y, s = np.array([labels[k] for k in test]), np.array([got[k].score for k in test])
    p = s >= 0.3
    print("auc", auc(y, s), "recall", (p & (y == 1)).sum() / y.sum(), "precision", (p & (y == 1)).sum() / max(1, p.sum()), "false positives", (p & (y == 0)).sum() / (y == 0).sum())
    assert auc(y, s) > 0.85 and (p & (y == 0)).sum() / (y == 0).sum() < 0.06


def test_edge_cases(spark):
    none = train([])
    assert none == Model(b"", b"", 0, [], [], [], 0.5)
    docs = spark.createDataFrame([(1, None, 1.0), (1, "", 0.0), (2, "x" * 200_000, 0.0)], "doc_id long, text string, score double")
    assert [r.score for r in score_documents(docs, none).collect()] == [0.5] * 3
    labels = spark.createDataFrame([(1, None, 9), (5, 1, 9), (None, 1, 9), (2, 1, 9)], "doc_id long, toxic int, t int")
    assert [y for _, y in training_rows(docs, labels)] == ([1] if zlib.crc32(b"2") % 4 != 2 else [])
    assert score_documents(docs.limit(0), none).count() == 0
    rows = [(f"good words here number {i} {i * 7} plain talk about things " * 3, 0) for i in range(300)] + [(f"good words {i} you awful rotten person talk " * 3, 1) for i in range(150)]
    model = train(rows)
    s = model.scorer()
    assert s("good words 3 rotten awful person you " * 2) > 0.5 > s("plain talk about things here")
    assert 0 <= s(None) == s("") <= 1 and 0 <= s("𝒳" * 100_000) <= 1
