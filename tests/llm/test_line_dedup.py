import random
import re

import numpy as np
import pytest

from corvane.llm import line_dedup as ld


def slow(rows):
    """{(doc, line)} to remove, by comparing each line with all earlier ones."""
    lines = sorted((d, i, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", x) if w)) for d, t in rows if t is not None and d is not None for i, x in enumerate(t.split("\n")))
    lines = [x for x in lines if x[2]]
    out = set()
    for k, (d, i, s) in enumerate(lines):
        for d0, i0, s0 in lines[:k]:
            if (d0, i0) != (d, i) and 5 * len(s & s0) >= 4 * len(s | s0):
                out.add((d, i))
                break
    return out


def made(seed, n, edits):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 20, 40]))] for _ in range(16)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((d * 7 + 3, "\n".join(lines)))
    return rows


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.d, r.l) for r in ld.removed_lines(docs).collect()}


def test_same_as_brute_force(spark):
    for seed, edits in ((1, 9), (2, 4)):
        rows = made(seed, 160, edits)
        assert removed(spark, rows) == slow(rows)


def test_second_round(spark, monkeypatch):
    """Without first candidates all is found by the second round."""
    rows = made(3, 120, 14)
    monkeypatch.setattr(ld, "FIRST", 0)
    assert removed(spark, rows) == slow(rows)


def test_hot_words_in_parts(spark, monkeypatch):
    """Words that count as hot are dealt into parts, with the same result; also in the second round."""
    rows = made(6, 140, 5)
    monkeypatch.setattr(ld, "HOT", 3)
    assert removed(spark, rows) == slow(rows)
    monkeypatch.setattr(ld, "FIRST", 1)
    assert removed(spark, rows) == slow(rows)


def test_hot_words_in_blocks(spark, monkeypatch):
    """Words with more parts are dealt by blocks of their lines' words, with the same result; also in the second round."""
    rows = made(6, 140, 5)
    monkeypatch.setattr(ld, "HOT", 1)
    monkeypatch.setattr(ld, "PARTS", 1)
    assert removed(spark, rows) == slow(rows)
    monkeypatch.setattr(ld, "PARTS", 12)
    assert removed(spark, rows) == slow(rows)
    monkeypatch.setattr(ld, "FIRST", 0)
    assert removed(spark, rows) == slow(rows)
    monkeypatch.setattr(ld, "SEEN", 2)
    assert removed(spark, rows) == slow(rows)


def test_similar_lines_share_a_block():
    """Any two lines of a Jaccard similarity of 0.8 have a block's key in common, at every length."""
    rng = random.Random(5)
    for n in [*range(1, 60), 140, 500]:
        for _ in range(12):
            base = [rng.getrandbits(64) for _ in range(n)]
            cut = rng.randrange(n // 5 + 1)
            other = base[cut:] + [rng.getrandbits(64) for _ in range(rng.randrange(n // 4 + 1))]
            both = len(set(base) & set(other))
            h = np.array(base + other, np.uint64)
            keys, place = ld.shares(h, np.array([0, n]), np.array([n, len(other)]), np.array([0, 1]))
            if 5 * both >= 4 * (n + len(other) - both):
                assert set(keys[place == 0].tolist()) & set(keys[place == 1].tolist())


def test_rows_of_a_hot_word_grow_with_its_lines(spark, monkeypatch):
    """A word in all lines: rows in proportion to the lines, no list with a large part of them, one row a task for equal lines."""
    monkeypatch.setattr(ld, "HOT", 8)

    def sent(n, text):
        docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string").coalesce(1)
        counts = spark.sparkContext.broadcast(ld.sketch(docs, "doc_id", "text", 1 << 16))
        rows = ld.prefix_rows(docs, counts, 4, "doc_id", "text").collect()
        r = ld.unpack([bytes(x.rows) for x in rows if not x.settled], ld.ROW)
        lists = np.unique((r["token"].astype(np.uint64) << np.uint64(16)) | r["part"], return_counts=True)[1]
        return len(r), int(lists.max()), sum(len(x.rows) for x in rows if x.settled) // ld.PLACE.itemsize

    rng = random.Random(1)
    few, many = (sent(n, lambda i: " ".join(["all", *(f"w{rng.randrange(9)}x" for _ in range(12))])) for n in (1000, 4000))
    assert many[0] < 5 * few[0] and many[1] < 4000 / 2
    # Equal lines of a task, in several blocks of text: one stands for them, with its three blocks.
    assert sent(900, lambda i: "all the same" + "\n" * 2000) == (3, 1, 899)
    turned = sent(9, lambda i: "all the same" + "\n" * 300_000)
    assert turned[1:] == (1, 8)


def test_words_of_any_blanks():
    """Hashes don't depend on where a long text is cut, nor on the words beside."""
    rng = random.Random(9)
    parts = ["x" * n for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 3000)] + [f"k{rng.randrange(50)}" for _ in range(400)]
    rng.shuffle(parts)
    data = "".join(w + rng.choice(["\t", "\r", " ", "\x0b", "\x0c", "\t\t"]) for w in parts).encode()
    whole = ld.words(data)[0].tolist()
    assert len({w: h for w, h in zip(parts, whole, strict=True)}) == len(set(whole)) and whole == [ld.words(w.encode())[0][0] for w in parts]
    before = ld.LONG_BLOCK
    try:
        ld.LONG_BLOCK = 100
        assert ld._long(1, data)[0].tolist() == whole
    finally:
        ld.LONG_BLOCK = before


def test_blocks_of_long_texts():
    import pyarrow as pa

    rng = random.Random(4)
    text = "\n".join(" ".join(f"word{rng.randrange(9999)}" for _ in range(rng.randrange(200))) for _ in range(8000))
    text += "y" * 100 + "\n" + "z " * 10
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3, None, 4], "b": ["alpha beta\n gamma", text, None, "no id", "gamma alpha"]})
    got = {}
    for h, d, n in ld.blocks(iter([batch])):
        for x, y, z in zip(h.tolist(), d.tolist(), n.tolist(), strict=True):
            got.setdefault((y, z), []).append(x)
    flat = {(2, i): x.split() for i, x in enumerate(text.split("\n")) if x.split()} | {(1, 0): ["alpha", "beta"], (1, 1): ["gamma"], (4, 0): ["gamma", "alpha"]}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in flat.items()}
    by_word = {}
    for k in flat:
        for w, h in zip(flat[k], got[k], strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_edge_cases(spark):
    schema = "doc_id long, text string, l int, d string, words string, removed_lines int, ld_gone int, `a.b` int"
    assert ld.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    line = "one two three four five"
    rows = [(1, None), (2, ""), (3, f"{line}\n\n{line}\nshort line"), (4, f"short line\n{line}\n\n"), (4, f"short line\n{line}"), (None, line), (9, "q" * 300_000 + "\n" + line)]
    docs = spark.createDataFrame([(d, t, 1, "", "", 7, 8, 9) for d, t in rows], schema)
    out = ld.dedup_lines(docs)
    assert out.columns == [*docs.columns, "removed_lines_"]
    got = sorted(((r.doc_id or 0), r.text or "-", r.removed_lines_, r.removed_lines, r.ld_gone, r["a.b"]) for r in out.collect())
    assert got == [(0, line, 0, 7, 8, 9), (1, "-", 0, 7, 8, 9), (2, "-", 0, 7, 8, 9), (3, f"{line}\n\nshort line", 1, 7, 8, 9), (4, "\n", 2, 7, 8, 9), (4, "-", 2, 7, 8, 9), (9, "q" * 300_000, 1, 7, 8, 9)]
    with pytest.raises(TypeError):
        ld.dedup_lines(spark.createDataFrame([("a", line)], "doc_id string, text string"))


def test_repeated_rows_of_one_id(spark):
    """Rows of one id and text in one block keep their lines; a repeat at another place still goes."""
    text = "only here one two three four\nonly here five six seven eight"
    again = "nowhere else a b c d e\nsome other words of this text\nnowhere else a b c d e"
    rows = [(7, text), (7, text), (8, again), (8, again), (9, "some other words of this text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.d, r.l) for r in ld.removed_lines(docs).collect()}
    assert got == slow(rows) == {(8, 2), (9, 0)}


def test_bloom(spark):
    rows = [(i * 3, i % 7) for i in range(2000)]
    bits = ld.bloom(spark.createDataFrame(rows, "d long, l long"))
    ref = ld._ref_of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert ld._in_bloom(bits, ref).all() and ld._in_bloom(bits, ld._mix(ref)).mean() < 0.05
