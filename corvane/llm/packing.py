"""Cost-balanced packing of tokenized documents into sequences of bounded length.

Every input partition is read as a stream and packed in groups of about ``GROUP_TOKENS`` tokens, so
nothing is shuffled, a task's memory is one group, and any number of tasks can work side by side.
In a group, whole sequences' worth of a long document is cut off first. The rest of each document
is given, in descending order of its estimated cost (``LINEAR`` per token and ``QUADRATIC`` per
token pair), to the cheapest sequence that still holds it whole; if none does, it is cut over the
cheapest sequences with room. A group of T tokens opens ``T // seq_len`` sequences of ``seq_len``
and one for each power of two in the remainder, so that every sequence ends exactly full.

Token ids come from the tokenizers library. Words repeat, so each task keeps a bounded cache from a
blank-separated word to its ids; a word that isn't in it is encoded by the library. Cutting at a
blank or a line feed is exact for tokenizers that drop white space and never join over it
(``encode_words``); others are to be encoded whole (``words=False``).

Defined cases: null and empty texts are the end id alone. Repeated rows are packed as rows of their
own. Other columns are ignored. An empty table gives no pieces. Sequence ids are unique over all
tasks: the partition's number times 2^32 and a counter.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import byte_letters, documents

SEQ_LEN = 4096
GROUP_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
CACHE_WORDS = 500_000
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2


class _Words(dict):
    """Ids (little-endian uint32) by word; what is missing is encoded and kept.

    A word of letters below U+0130, where lower case and composition are plain, with full stops and
    commas after it, has the ids of its lower-case letters (one piece, given to the tokenizer's model)
    and then those of the punctuation (another piece). Any other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit
        self.model, self.letters = tokenizer.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        core = word.rstrip(".,")
        if core.isalpha() and max(core) < "\u0130":
            low = core.lower()
            ids = self.get(low)
            if ids is None:
                piece = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
                if len(low) < 64:
                    self[low] = ids
            if len(core) < len(word):
                ids += self[word[len(core) :]]
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts as the tokenizers library does, without truncation, padding or added ids."""

    def __init__(self, path: str, words: bool = True, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache, self.words = _Words(self.tokenizer, limit), words

    def __call__(self, text: str) -> bytes:
        if not self.words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


def assign(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group."""
    out, seq, rest = [], 0, []
    for d, n in enumerate(lengths):
        for k in range(n // seq_len):
            out.append((d, k * seq_len, seq_len, seq, 0))
            seq += 1
        if n % seq_len:
            rest.append((n % seq_len, d))
    total = sum(n for n, _ in rest)
    sizes = [seq_len] * (total // seq_len) + [1 << b for b in range((total % seq_len).bit_length() - 1, -1, -1) if total % seq_len >> b & 1]
    size = np.array(sizes, np.int64)
    room, cost = size.copy(), np.zeros(len(sizes))
    price = lambda n: linear * n + quadratic * n * n
    for n, d in sorted(rest, key=lambda x: (-price(x[0]), x[1])):
        start, end = lengths[d] - n, lengths[d]
        while start < end:
            fits = room >= end - start
            # A small sequence's cost counts by its size, else the smallest would always be cheapest.
            s = int(np.argmin(np.where(fits if fits.any() else room > 0, cost / size, np.inf)))
            part = min(end - start, int(room[s]))
            out.append((d, start, part, seq + s, int(size[s] - room[s])))
            room[s] -= part
            cost[s] += price(part)
            start += part
    return out


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text", words: bool = True, group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Pack all documents; one row per piece with its ids (little-endian uint32) as bytes.

    Column id_col keeps its type and name. start counts the document's ids before the piece.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    name = "doc_id"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer, words), np.array([end_id], "<u4").tobytes()
        task, seq = TaskContext.get().partitionId() << 32, 0
        ids, coded, held = [], [], 0
        schema = None

        def emit() -> pa.RecordBatch:
            nonlocal seq, ids, coded, held
            rows = assign([len(c) // 4 for c in coded], seq_len, linear, quadratic)
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[d] for d in cols[0]], schema.field(0).type),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array([len(coded[d]) // 4 for d in cols[0]], pa.int64()),
                    pa.array(np.array(cols[3], np.int64) + (task + seq)),
                    pa.array(cols[4], pa.int64()),
                    pa.array([coded[d][4 * a : 4 * (a + n)] for d, a, n, _, _ in rows], pa.binary()),
                ],
                names=[name, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            seq += max(cols[3]) + 1
            ids, coded, held = [], [], 0
            return out

        for batch in batches:
            schema = batch.schema
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                c = encode(texts[i].as_py() or "") + end
                ids.append(doc)
                coded.append(c)
                held += len(c) // 4
                if held >= group_tokens:
                    yield emit()
        if coded:
            yield emit()

    out = docs.select(id_col, text_col).mapInArrow(pieces, f"{name} {id_type}, {PIECES}")
    return out.withColumnRenamed(name, id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
