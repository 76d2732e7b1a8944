"""Tokenizer alignment against a plain loop over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment as al
from corvane.llm.common import written

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = {c: b for b, c in al.Encoder(public_tokenizers.path("byte_bpe_50k.json")).vocab.letters.items()}


def ranges(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens(text):
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    pa = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    pb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(pa) == b"".join(pb) == (" " + text).encode():
        return [], [], [], []
    return a, b, ranges(pa), ranges(pb)


def slow(rows):
    docs, linked, out = [], defaultdict(set), []
    for n, (d, text) in enumerate(rows):
        a, b, ra, rb = tokens(text)
        links, j = [], 0
        for i, (x, y) in enumerate(ra):
            while j and rb[j][0] > x:
                j -= 1
            while j < len(rb) and rb[j][0] < y:
                if rb[j][1] > x:
                    links.append((a[i], b[j]))
                j += 1
            j = max(0, j - 1)
        ends = sorted({y for _, y in ra} & {y for _, y in rb})
        groups = [(",".join(str(t) for t, (x, y) in zip(a, ra) if s < y <= e), ",".join(str(t) for t, (x, y) in zip(b, rb) if s < y <= e)) for s, e in zip([0, *ends], ends)]
        docs.append((d, a, b, links, ";".join("|".join(g) for g in groups), len(groups)))
        for p in set(links):
            linked[p].add(n)
    count = {p: len(x) for p, x in linked.items()}
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for d, a, b, links, groups, n in docs:
        out.append((d, len(a), len(b), n, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b \n\tc "), (5, "a\x00b <s> <0x0A> [UNK]"), (6, "has ▁ inside"), (7, "x<|endoftext|>y"), (8, "école ﬁ ΣΑΣ 漢字 👩‍👩‍👧 été"),
    (9, "same words here"), (9, "same words here"), (None, "same words"), (11, "z" * 3000), (12, "\r\n\r\n  "), (13, "word " * 4000), (14, "é"),
]
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize(("most", "partial"), [(2_000_000, 400_000), (40, 20), (0, 1)])
def test_same_as_a_loop(spark, most, partial):
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in ODD], "doc_id long, text string, pairs int, row int").repartition(3)
    table = written(al.aligned(docs, digest=True, partial=partial), "alignment")
    got = al.scored(table, written(al.pair_counts(table), "pairs"), most)
    assert sorted(map(tuple, got.select(*COLS).collect()), key=repr) == slow(ODD)


def test_texts_of_groups(spark):
    docs = spark.createDataFrame([(1, "tokens overlap"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in al.aligned(docs).where("row IS NOT NULL").collect()}
    assert got[2] == "" and hashlib.sha256(got[1].encode()).hexdigest() == slow([(1, "tokens overlap")])[0][-1]


def test_empty(spark):
    table = written(al.aligned(spark.createDataFrame([], "doc_id long, text string")), "alignment")
    assert al.scored(table, written(al.pair_counts(table), "pairs")).count() == 0


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = al.op12_tokenizer_alignment(spark, d)
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows)


def test_pieces_of_words_are_those_of_the_text(monkeypatch):
    """Pieces looked up by word are the model's for the whole text; words met before aren't encoded again."""
    sides = al.Sides((public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    assert sides.by_word
    monkeypatch.setattr(al, "WORDS", 40)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["a", "the", "ing", "é", "日本", "<s>", "\n", "\t", "<0x41>", "▁", "😀", "\0", "7", ".", " ", "é"]) for _ in range(rng.randrange(1, 5)))
    model, sent = sides.b, []

    class Counted:
        def encode(self, texts, **how):
            sent.extend(texts)
            return model.encode(texts, **how)

    sides.b = Counted()
    for _ in range(50):
        texts = [rng.choice([" ", " ", " ", " ", "  "]).join(word() for _ in range(rng.randrange(12))) for _ in range(8)]
        texts += ["", " ", " x", "x ", "the"]
        for t, a, b in zip(texts, *sides.encode(texts), strict=True):
            want = model.encode(t)
            fits = sides.bytes_b(np.array(want, np.uint32))[0] == (" " + t).encode() if t else False
            assert b.tolist() == (want if fits else [])
            assert a.tolist() == (A.encode(" " + t, add_special_tokens=False).ids if fits else [])
    monkeypatch.setattr(al, "WORDS", 300)
    sides.encode(["one two three"])
    sent.clear()
    sides.encode(["three one", "two one", "two four"])
    assert sent == ["four"]
