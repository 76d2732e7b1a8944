import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm.packing import SEQ_LEN, assign, op8_packing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def expected(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, crc=None):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        ids, at = expected(texts[d]), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part) if "ids_crc32" in p else bytes(p["ids"]) == part
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == SEQ_LEN or at & (at - 1) == 0


TEXTS = {
    0: "Hello  World", 1: None, 2: "", 3: "a<|endoftext|>b It's\tÉCOLE école  x ΣΑΣ 12 don't\n\n!!", 4: "word " * 9000, 5: "x" * 5000,
    6: " \n ", 7: "́abc ́ <|startoftext|>", 8: "İstanbul ﬁ \x1c a\x85b", 9: "word " * 4095,
}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(k, v, 1) for k, v in TEXTS.items()], "doc_id long, text string, ids int")
    check([r.asDict() for r in pack_documents(docs).collect()], TEXTS)


def test_empty_and_repeated(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").coalesce(1)
    assert sorted((r.offset, r.length) for r in pack_documents(twice).collect()) == [(0, 2), (2, 2)]


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    check([r.asDict() for r in op8_packing(spark, d).collect()], texts)


@pytest.mark.parametrize("seed", range(4))
def test_balance(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 3000, 700)]
    pieces = assign(lengths, SEQ_LEN, 1.0, 1 / 4096)
    cost = defaultdict(float)
    size = defaultdict(int)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 4096
        size[s] += n
    full = [cost[s] for s in size if size[s] == SEQ_LEN]
    assert sum(size.values()) == sum(lengths) and max(full) < 1.5 * np.mean(full)
