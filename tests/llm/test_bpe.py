import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm.bpe import Encoder, decode, encode, op5_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()

TEXTS = [None, "", " ", "  ", "a  b", "a   b \n c", "a \n", "a\n ", "a\n b", "trail ", "x<|endoftext|>y <|endoftext|>", "<|endoftext|><|endoftext|>", "don't 'tis we'LL they're 's 'sx", "ÀÉ ü\u00a0 \u00a0b", "12345 67a8 ½Ⅷ", "日本語 テキスト 🎉🎉", "\t\tif x:\n\t\t\treturn  1", "a" * 3000, "=" * 777 + " " * 300 + "z", "e\u0301 \u0301 \u200b", "\x00\x1c\x85"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: (r.ids, r.text) for r in decode(encode(docs)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == expected(t), t
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (None, [72])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id or 0, r.text) for r in decode(nulls).collect()) == [(0, LIBRARY.decode([72])), (1, ""), (2, "")]


def test_random_text():
    encoder, rng = Encoder(PATH), random.Random(5)
    alphabet = ["a", "b", "th", "er", "in", " ", " ", "  ", "\n", "'", "'s", "é", "🎉", "1", "00", "-", "==", "ing", "tion", "\u00a0"]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert memoryview(encoder(t)).cast("I").tolist() == expected(t)[0], t


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op5_bpe(spark, d).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for k, t in texts.items():
        ids, text = expected(t)
        assert rows[k].n_tokens == len(ids) and rows[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert rows[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
