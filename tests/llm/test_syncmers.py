import hashlib
import re

import numpy as np

from corvane.llm.syncmers import CHARS_UP_TO, WORDS_FROM, anchors, compare_edited, fingerprint, op4_syncmers


def edited(texts):
    """{id: edited text}, ascending id."""
    ids = sorted(texts)
    out = {}
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        q = len(t) // 4
        out[d] = t[: len(t) - q] + nxt[:q]
    return out


def slow_anchors(spark, units, k, s):
    """Positions of closed syncmers, with the engine's own hash of the s-mers."""
    if not units:
        return []
    if len(units) < k:
        return [0]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, units[i : i + s]) for i in range(len(units) - s + 1)], "i int, m array<string>")
    h = [r.h for r in frame.orderBy("i").select(F.xxhash64(*[F.xxhash64(F.col("m")[j]) for j in range(s)]).alias("h")).collect()]
    m = k - s + 1
    return [i for i in range(len(units) - k + 1) if min(h[i : i + m]) in (h[i], h[i + m - 1])]


def test_anchors(spark):
    texts = {1: "", 2: "ab", 3: "a short text of ten chars", 4: " ".join(f"w{i * i % 37}" for i in range(60)), 5: None, 6: " ".join(f"w{i * i % 101}" for i in range(300))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in anchors(docs).collect():
        got.setdefault((r.doc_id, r.unit), []).append(r.pos)
    for d, t in texts.items():
        words = re.findall(r"\S+", t or "")
        assert got.get((d, "word"), []) == (slow_anchors(spark, words, 4, 2) if len(words) >= WORDS_FROM else [])
        assert got.get((d, "char"), []) == (slow_anchors(spark, list(t or ""), 10, 4) if len(words) <= CHARS_UP_TO else [])


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want, rows = edited(texts), op4_syncmers(spark, d).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id]) and r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(seen.values())) > 0.99 * len(seen)
    near, nxt = [r.near_edited for r in rows], [r.near_next for r in rows]
    print(np.percentile(near, [0, 1, 5, 25, 50, 75, 100]), np.percentile(nxt, [0, 50, 95, 99, 100]))
    assert np.percentile(near, 5) > 0.3 and np.percentile(nxt, 95) < 0.2


def test_edge_cases(spark):
    schema = "doc_id long, text string, h string, n int, fp int"
    assert compare_edited(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, None, "", 1, 1), (3, "", "", 1, 1), (None, "null id", "", 1, 1), (9, "abcdefgh" * 5000, "", 1, 1), (9, "abcdefgh" * 5000, "", 1, 1), (11, "xyz1", "", 1, 1)]
    out = compare_edited(spark.createDataFrame(rows, schema)).select("*", fingerprint("fp").alias("f")).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_chars, r.edited[-3:], r.near_edited) for r in out)
    assert [g[:2] for g in got] == [(-1, 7), (3, 0), (7, 0), (9, 40000), (9, 40000), (11, 4)]
    assert got[1][3] == got[2][3] == 1.0 and got[-1][2] == "z1n"[-3:].replace("z1n", "yzn") and {r.f for r in out if not r.n_chars} == {""}
    one = compare_edited(spark.createDataFrame([(1, "abcdefghijkl")], "doc_id long, text string")).first()
    assert one.edited == "abcdefghiabc"
