import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import suffix_dedup as sd


def slow(rows):
    """{id: (kept bytes, spans)} by a table of all strings."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(d, least.get(s, d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        edge = np.diff(np.r_[0, gone.astype(np.int8)])
        spans = [int(x) for p in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) for x in p]
        out.setdefault(d, []).append((np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes(), spans))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["of", "the", "thing", "ation", "ér", "x\0y", "qu"]) * rng.randrange(1, 3)
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randrange(8, 60)) for _ in range(9)]
    rows = []
    for d in range(n):
        t = " ".join(rng.choice([rng.choice(passages), prose(rng.randrange(40))]) for _ in range(rng.randrange(5)))
        if rng.random() < 0.2 and rows:
            t = rng.choice(rows)[1]
        if rng.random() < 0.3 and len(t) > 10:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + rng.randrange(3) :]
        rows.append((d * 5 - 100, t))
    return [*rows, (5000, "ab" * 400), (5001, "z" * 300), (5002, "ab" * 300), (5003, "\0" * 120), (5004, "\0" * 60), (5005, "s" * 49), (5006, "s" * 49)]


@pytest.mark.parametrize(("shard_bytes", "hot"), [(1 << 20, 512), (6000, 512), (3000, 2)])
def test_same_as_brute_force(spark, monkeypatch, shard_bytes, hot):
    rows = made(shard_bytes)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(bytes(r.kept), list(r.spans))] for r in sd.repeats(docs, shard_bytes=shard_bytes, hot_shards=hot).collect()}
    want = slow(rows)
    assert got.keys() == want.keys()
    assert {k for k in got if got[k] != want[k]} == set()


@pytest.mark.parametrize("part", [500, 5000, 1 << 20])
def test_parts_are_merged(monkeypatch, part):
    monkeypatch.setattr(sd, "PART_BYTES", part)
    rng = random.Random(part)
    runs = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(50, 60))) + b"q" * rng.randrange(60) for _ in range(200)})
    ids = np.array([rng.randrange(1000) for _ in runs])
    want = {}
    for r, d in zip(runs, ids, strict=True):
        for i in range(len(r) - 49):
            want[r[i : i + 50]] = min(int(d), want.get(r[i : i + 50], 1 << 60))
    assert sd.least_ids(runs, ids).tolist() == [want[r[i : i + 50]] for r in runs for i in range(len(r) - 49)]


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"\0\0\0", b"ab\0\0\0\0\0\0\0\0", b"abracadabra" * 40, b"\xff" * 300, bytes(range(256)) * 3])
def test_suffix_array(text):
    t = np.frombuffer(text, np.uint8)
    sa = sd.larsson_sadakane(t)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    want = [0] * len(text)
    for k in range(1, len(text)):
        a, b = text[sa[k - 1] :], text[sa[k] :]
        want[k] = next((i for i in range(min(len(a), len(b), 50)) if a[i] != b[i]), min(len(a), len(b), 50))
    assert sd.kasai(t, sa).tolist() == want


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 4096)
    sd._tables.clear()
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    found = sd.blocks([long.encode(), b"short", long[3000:9000].encode()])
    seen = {0: 0, 2: 0}
    for b in found:
        start, n, _, part = b.runs()
        for d in seen:
            seen[d] += int(n[b.doc[part] == d].sum())
    sd._tables.clear()
    assert seen == {0: 20_000 - 49, 2: 6000 - 49}


def test_edge_cases(spark):
    schema = "doc_id long, text string, shard int, kept string"
    assert sd.repeats(spark.createDataFrame([], schema)).count() == 0
    t = "some passage of more than fifty bytes that is found in several rows"
    rows = [(1, None, 1, ""), (2, "", 1, ""), (3, t, 1, ""), (3, t, 1, ""), (None, t, 1, ""), (7, "x" + t, 1, "")]
    got = sorted(((r.doc_id or 0), bytes(r.kept).decode(), list(r.spans)) for r in sd.repeats(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, t, []), (1, "", []), (2, "", []), (3, t, []), (3, t, []), (7, "x", [1, 1 + len(t)])]


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {k: v[0] for k, v in slow(rows).items()}
    for r in sd.op3_suffix_dedup(spark, d).collect():
        kept, spans = want[r.doc_id]
        assert (r.kept_sha256, r.n_spans, r.n_removed, r.n_bytes) == (hashlib.sha256(kept).hexdigest(), len(spans) // 2, sum(spans[1::2]) - sum(spans[::2]), len(dict(rows)[r.doc_id].encode()))


def test_other_columns_as_they_are(spark):
    p = "a passage of more than fifty bytes that two documents share, word by word"
    docs = spark.sql(f"SELECT 2 AS doc_id, '{p}!' AS text, timestamp'2024-01-02 03:04:05.123456' AS shard, map(1, 'x') AS rest, 'k' AS `a.b` UNION ALL SELECT 1, '{p}', null, null, null")
    out = sd.remove_repeats(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.dtypes == docs.dtypes and got[2].text == "!" and got[1].text == p and got[2]["a.b"] == "k" and got[2].rest == {1: "x"} and got[2].shard.microsecond == 123456


def test_many_short_documents_cost_what_their_bytes_cost(spark):
    """The same bytes in 16,000 documents and in 40: marking takes no pass over a block for each of its documents."""
    line = [f"{i % 8000:06d} " + "abcdefghij " * 5 for i in range(16000)]
    few = ["".join(line[i : i + 400]) for i in range(0, len(line), 400)]
    took = []
    for texts in (few, few, line):  # the first one warms up
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()
        df.count()
        began = time.monotonic()
        rows = sd.repeats(df).select("doc_id", F.octet_length("kept").alias("n")).collect()
        took.append(time.monotonic() - began)
        assert len(rows) == len(texts)
    assert all(r.n == 0 or r.doc_id < 8000 for r in rows)
    assert took[2] < 3 * took[1] + 3, took
