"""Difference-cover dedup against a table of all windows."""

import random

import pytest

from corvane.llm import anchors as an


def slow(rows, size=13):
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def made(seed, n=150):
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(["of", "the", "thing\n", "ér", "x\0y", "\tqu", "Qu"]) for _ in range(k))
    passages = [prose(rng.randrange(8, 60)) for _ in range(9)]
    rows = []
    for d in range(n):
        t = " ".join(rng.choice([rng.choice(passages), prose(rng.randrange(40))]) for _ in range(rng.randrange(5)))
        if rng.random() < 0.2 and rows:
            t = rng.choice(rows)[1]
        rows.append((d * 5 - 100, t))
    return [*rows, (5000, "a " * 400), (5001, "a  " * 300), (5002, "b " * 13), (5003, "b " * 12), (5004, " ".join(["b"] * 13)), (5005, None), (5006, ""), (5006, " \n"), (7, prose(30)), (7, passages[0]), (None, passages[1]), (None, None)]


@pytest.mark.parametrize(("shard_bytes", "window", "period", "cover"), [(1 << 20, 13, 7, (0, 1, 3)), (3000, 13, 7, (0, 1, 3)), (2000, 5, 3, (0, 1)), (5000, 13, 13, (0, 1, 3, 9)), (4000, 4, 1, (0,))])
def test_same_as_brute_force(spark, shard_bytes, window, period, cover):
    rows = made(shard_bytes)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = an.repeats(docs, window=window, period=period, cover=cover, shard_bytes=shard_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()), key=repr) == slow(rows, window)


def test_cover_is_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for period, cover in ((7, (0, 1, 2)), (14, (0, 1, 2, 4, 8, 13))):
        with pytest.raises(ValueError):
            an.repeats(docs, period=period, cover=cover)


def test_long_texts_are_taken_in_parts(monkeypatch):
    text = (" ".join(random.Random(1).choice(["one", "three", "seventeen"]) for _ in range(500)) + "x" * 90).encode()
    whole = an.word_hashes(text)
    monkeypatch.setattr(an, "SCAN_BYTES", 40)
    assert (an.word_hashes(text) == whole).all() and len(whole) == 500


def test_other_columns_and_empty(spark):
    p = " ".join(f"w{i}" for i in range(20))
    docs = spark.sql(f"SELECT 2 AS doc_id, '{p} tail' AS text, timestamp'2024-01-02 03:04:05.123456' AS shard, map(1, 'x') AS rest, 'k' AS `a.b` UNION ALL SELECT 1, '{p}', null, null, null")
    out = an.remove_passages(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "tail" and got[1].text == p and got[2]["a.b"] == "k" and got[2].rest == {1: "x"} and got[2].shard.microsecond == 123456
    assert an.remove_passages(docs.limit(0)).count() == 0


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    import hashlib

    got = sorted(map(tuple, an.op11_substring_dedup(spark, d).collect()), key=repr)
    assert got == sorted(((a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in slow(rows)), key=repr)
