import re

import numpy as np
import pytest
import xxhash

from corvane.llm.simhash import ball_links, fingerprint, near_duplicates, op9_simhash, route_bits


def slow_fingerprint(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def slow_components(fps):
    """fps: {doc: fingerprint}; smallest reachable doc of each, by brute force."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(fps)
    f = np.array([fps[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = sorted((find(d), find(ids[j])))
            root[b] = a
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("text", [None, "", " \n\t", "A", "É A b", "One two  three\x0bfour ÀB five", "x " * 70000, "a\x1fb c\x85d e f g"])
def test_fingerprint(text):
    assert fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


@pytest.mark.parametrize("b", [2, 5, 9])
def test_ball_links(spark, b):
    from corvane.llm.components import components

    rng = np.random.default_rng(b)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)] + [0, 1, 2**64 - 1]
    for _ in range(500):
        x = fps[int(rng.integers(len(fps)))]
        for k in rng.integers(0, 64, int(rng.integers(1, 6))):
            x ^= 1 << int(k)
        fps.append(x)
    fps = dict(enumerate(dict.fromkeys(fps)))
    signed = {k: int(np.uint64(v).astype(np.int64)) for k, v in fps.items()}
    links = ball_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), b)
    comp = {r.node: r.root for r in components(links).collect()}
    want = slow_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({k: comp.get(v, v) for k, v in signed.items()}) == groups(want)


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp string, component_id int, u long"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, None, "", 1, 1), (5, "", "", 1, 1), (5, "", "", 1, 1), (9, "a b c d", None, None, None), (8, "A B C D", None, None, None)]
    got = sorted((r.doc_id, r.fp, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert [(d, c) for d, _, c in got] == [(3, 3), (5, 3), (5, 3), (8, 8), (9, 8)] and got[0][1] == 0


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: slow_fingerprint(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    comp = slow_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, d).collect()}
    assert got == {k: (f"{v:016x}", comp[k]) for k, v in want.items()}
    assert route_bits(1) == 2 and route_bits(300_000) == 7
