"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

A piece of text is encoded left to right. One Aho-Corasick pass finds the longest token that starts
at each of its bytes. The longest one is taken if it may follow the token before it, else the next
shorter token that is its prefix, else the token before is taken back; a position found dead is not
entered again, so the work is linear in the piece. Two tokens are compatible if merging the bytes of
both gives just these two, which is read from the merges at their common border and remembered in a
table. The result is exactly that of applying the merges in order.

Texts are cut into pieces by the pattern of byte-level tokenizers. A blank that isn't within white space
always starts a piece, so a text without double or final blanks, or blanks between other white space, is looked
up blank by blank in bounded caches, and the pattern only runs on what isn't there. Added tokens are cut out first.

Decoding joins slices of one byte table at the tokens' offsets; bytes that aren't UTF-8 are replaced.

Defined cases: null and empty texts have no ids; ids that are null or empty decode to the empty
text. Repeated rows get equal results. Other columns are dropped. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import byte_letters, documents

# Fixed value: the pattern that byte-level tokenizers cut text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BEFORE_SPACE = tuple(" " + c for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LATIN_END = "\u0250"
CLOSING = ",.;:!?)"
CACHE_WORDS = 200_000
PAIRS = 400_000
CHUNK = 1 << 22  # bytes of text whose ids are turned into texts at once


class Vocabulary:
    """Tokens, merges and the added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        self.letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((a, b), r)
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = r, a, b


class Backtracker:
    """Exact BPE of single pieces."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab, self.pairs = vocab, {}
        self.automaton = ahocorasick.Automaton()
        # Latin-1 text stands for bytes. A token that its own merges don't give can't occur.
        one = {vocab.bytes[i]: i for i in range(len(vocab.bytes)) if len(vocab.bytes[i]) == 1}
        made = [i for i in range(len(vocab.bytes)) if vocab.rank[i] >= 0 and self.compatible(vocab.left[i], vocab.right[i], vocab.rank[i])]
        self.token = {b: i for b, i in one.items()} | {vocab.bytes[i]: i for i in made}
        self.length = [len(b) for b in vocab.bytes]
        for b, i in self.token.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.shorter = {}
        for b, i in self.token.items():
            self.shorter[i] = next((self.token[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.token), -1)

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether no merge over the border of a and b comes before ``limit`` and their own merges.

        Merges are undone from the last one back; of equal ranks the right-hand one is the later.
        """
        v = self.vocab
        while True:
            r = v.merged.get((a, b))
            if r is not None and r < limit:
                return False
            if v.rank[a] > v.rank[b]:
                limit, a = min(limit, v.rank[a]), v.right[a]
            elif v.rank[b] >= 0:
                limit, b = min(limit, v.rank[b] + 1), v.left[b]
            else:
                return True

    def __call__(self, piece: bytes) -> list[int]:
        whole = self.token.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (i, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = i  # matches come by their ends, so a start keeps its longest
        pairs, shorter, length = self.pairs, self.shorter, self.length
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                if at + length[token] not in dead:
                    if last < 0:
                        break
                    pair = last << 32 | token
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        ok = pairs[pair] = self.compatible(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                last, token = token, longest[at]
            else:
                dead.add(at)
                token = shorter[out.pop()]
                at -= length[last]
                last = out[-1] if out else -1


class Encoder:
    """Ids (native uint32) of whole texts."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import regex

        self.vocab = _once(Vocabulary, path)
        self.bpe = Backtracker(self.vocab)
        self.cut = regex.compile(PATTERN).findall
        self.within = regex.compile(r"\s \s").search
        self.added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.vocab.added, key=len, reverse=True)) + ")")
        # Most words are a single piece, which is only kept as a word.
        self.pieces = _Recent(self.piece, max(1, limit // 2))
        self.words = _Recent(self.word, limit + limit // 2)

    def piece(self, p: str) -> bytes:
        return array("I", self.bpe(p.encode())).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of a blank and what follows it up to the next."""
        latin = w.isascii() or max(w) < LATIN_END  # letters are the same to Python and to the pattern
        if latin and w.isalpha():  # one piece
            return self.piece(" " + w)
        if latin and w[-1:] in CLOSING and w[:-1].isalpha():  # a word and a piece of its own
            return self.words[w[:-1]] + self.pieces[w[-1]]
        first, *more = self.cut(" " + w)
        begin = self.words[first[1:]] if latin and first[1:].isalpha() else self.pieces[first]
        return begin + b"".join(map(self.pieces.__getitem__, more))

    def plain(self, text: str) -> bytes:
        piece = self.pieces.__getitem__
        if "  " in text or text[-1:] == " " or any(p in text for p in BEFORE_SPACE) and self.within(text):
            return b"".join(map(piece, self.cut(text)))
        first, *words = text.split(" ")
        return b"".join(map(piece, self.cut(first))) + b"".join(map(self.words.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        if not any(t in text for t in self.vocab.added):
            return self.plain(text)
        added = self.vocab.added
        return b"".join(array("I", [added[t]]).tobytes() if t in added else self.plain(t) for t in self.added.split(text))


class _Recent(dict):
    """A cache of two generations of ``limit`` entries: what is asked for again outlives the turn to a new one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


class Slices:
    """Joined slices of one table of bytes at the offsets of ids."""

    def __init__(self, parts: list[bytes]):
        self.size = np.fromiter(map(len, parts), np.int32, len(parts))
        self.offset = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's end lies in them."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends):
            return b"", ends
        kind = np.int32 if ends[-1] + len(self.table) < 1 << 31 else np.int64
        where = np.repeat((self.offset[ids] - (ends - sizes)).astype(kind), sizes)
        where += np.arange(ends[-1], dtype=kind)
        return self.table[where].tobytes(), ends


class Decoder:
    """Texts of ids: slices of one table of bytes at the tokens' offsets; and their decimal digits the same way."""

    def __init__(self, path: str):
        parts = _once(Vocabulary, path).bytes
        self.bytes = Slices(parts)
        self.digits = Slices([b"%d," % i for i in range(len(parts))])

    def __call__(self, ids: np.ndarray) -> str:
        return self.bytes(ids)[0].decode("utf-8", "replace")

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of the comma-joined ids and of the decoded text of each run of ``counts`` ids."""
        last = np.cumsum(counts)
        out = []
        for slices, closing in ((self.digits, 1), (self.bytes, 0)):
            data, ends = slices(ids)
            stop = np.concatenate([[0], ends])[last].tolist()
            parts = [data[a : max(a, b - closing)] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
            out.append(parts)
        return [hashlib.sha256(x).hexdigest() for x in out[0]], [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in out[1]]


_made: dict = {}


def _once(kind, path: str):
    """One vocabulary, encoder or decoder for a worker process."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids`` (array<int>) of every text, without added ids, truncation or padding."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, tokenizer)
        for b in batches:
            texts = b.column(1)
            for k in range(0, b.num_rows, 1000):
                coded = [encoder(texts[i].as_py() or "") for i in range(k, min(k + 1000, b.num_rows))]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(coded)), ids], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(of, f"doc_id {id_type}, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(coded: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, ``ids`` and ``text``: what the ids stand for, added tokens included."""
    id_type = coded.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, tokenizer)
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            texts = [decoder(x) for x in np.split(flat, ends[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select(id_col, ids_col).mapInArrow(of, f"doc_id {id_type}, ids array<int>, text string").withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, and SHA-256 of the comma-joined ids and of the text decoded from them: ``encode`` and
    ``decode`` in one pass, so that neither ids nor texts leave the task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _once(Encoder, tokenizer), _once(Decoder, tokenizer)
        for b in batches:
            texts, coded, held, begin = b.column(1), [], 0, 0
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                coded.append(encoder(text))
                held += len(text)
                if held > CHUNK or i == b.num_rows - 1:
                    counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                    ids_hash, text_hash = decoder.digests(np.frombuffer(b"".join(coded), np.uint32), counts)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(coded)), pa.array(counts), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    coded, held, begin = [], 0, i + 1

    return docs.select(id_col, text_col).mapInArrow(of, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", id_col)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
