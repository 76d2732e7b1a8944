"""Orders and equal lines of line_dedup against plain sorts."""

import numpy as np
import pytest

from corvane.llm import line_dedup as ld


@pytest.mark.parametrize("far", [0, 1 << 62])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_lines_by_document_and_place(n, far):
    """One sort key, or two keys where ids are far apart; negative ids and large line numbers too."""
    rng = np.random.default_rng(n)
    doc = rng.integers(-9, 9, n) * (1 + far // 9)
    line = rng.choice(np.array([0, 1, 2, (1 << 32) - 1], np.uint32), n)
    order = ld._in_order(doc, line)
    assert sorted(order.tolist()) == list(range(n))
    assert list(zip(doc[order].tolist(), line[order].tolist(), strict=True)) == sorted(zip(doc.tolist(), line.tolist(), strict=True))


@pytest.mark.parametrize("n", [0, 1, 400])
def test_earliest_of_equal_lines(n):
    rng = np.random.default_rng(n)
    same, sig, size = (rng.integers(0, k, n).astype(np.uint64) for k in (60, 2, 2))
    doc, line = rng.integers(-3, 3, n), rng.integers(0, 9, n)
    first: dict = {}
    for i in range(n):
        what = (same[i], sig[i], size[i])
        first[what] = min(first.get(what, (9, 9)), (doc[i], line[i]))
    place, of = ld._alike(same, sig, size.astype(np.int64), doc, line)
    got = {i: (doc[f], line[f]) for i, f in zip(place.tolist(), of.tolist(), strict=True)}
    for i in range(n):
        assert got.get(i, (doc[i], line[i])) == first[same[i], sig[i], size[i]]
