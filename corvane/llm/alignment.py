"""Alignment of two tokenizers' tokens over the same bytes.

Texts are encoded by a byte-level BPE (A) and by a piece model (B); a token stands for a range of the
text's bytes. Everything after encoding is done on flat Arrow columns of many documents at once:

1. A list's values and parent indices give each token's document; cumulative sums of the tokens' sizes
   give their ends. Both sides of a document cover the same bytes, so one running total over all documents
   of a chunk is a key that no two documents share.
2. A full hash join of both sides on that key has one row for each place where a token ends. Rows with
   both sides end a group. Filled backwards, a row names the A and the B token over the bytes before it;
   each overlapping pair of tokens is met in exactly one row, so the rows are the links.
3. Table.group_by counts each document's links by id pair, then the chunk's documents by id pair. Tasks add
   these partial counts up and write them beside the documents' rows; Spark merges them.
4. Documents are scored by the merged counts. The most frequent pairs, ``BROADCAST`` of them at most, are
   sent to all tasks; links of other pairs are joined with the rest of the table by Spark. These pairs are
   rare by choice, so no key of that join is hot.

Texts are encoded once: the table of documents is written into the shared folder and read for the scores.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from a space and the text,
have no tokens (zeros, no groups). Special tokens' strings in texts are plain text. Repeated rows are
documents of their own; null ids are kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bpe import Encoder, Slices, _once
from corvane.llm.common import documents, written

BYTE_TOKENIZER, PIECE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 18  # characters of texts that are aligned at once
WORDS = 300_000  # words whose pieces a task remembers
PARTIAL = 400_000  # id pairs that a task adds up before it writes their counts
BROADCAST = 2_000_000
KEY = 1 << 32  # a pair is A's id times this plus B's id

COLUMNS = "row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>, part_pairs array<long>, part_docs array<long>"


class Sides:
    """Both encoders and what their tokens stand for."""

    def __init__(self, paths: tuple[str, str]):
        import sentencepiece

        self.a = _once(Encoder, paths[0])
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Slices(self.a.vocab.bytes), Slices(b)
        na, nb = len(self.a.vocab.bytes), len(b)
        #: Decimal ids with what follows them: A within its group, A at its end, B within, B at its end.
        self.digits = Slices([*(b"%d," % i for i in range(na)), *(b"%d|" % i for i in range(na)), *(b"%d," % i for i in range(nb)), *(b"%d;" % i for i in range(nb))])
        self.na, self.nb = na, nb
        #: Whether pieces begin with their blank, if any, and so never go beyond a word (only blanks in a row may be a piece too),
        #: and the model puts a blank before a text.
        self.by_word = not any("▁" in p[1:] and p.strip("▁") for p in pieces) and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b")
        self.words: dict[str, bytes] = {}

    def pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of B. Texts with single blanks between words are looked up word by word; each word gets the blank before it from the model."""
        split = [t.split(" ") if self.by_word and t and "  " not in t and t[0] != " " != t[-1] else None for t in texts]
        wanted, known = {w for s in split if s for w in s}, self.words
        new = [w for w in wanted if w not in known]
        if len(known) + len(new) > WORDS:
            known = self.words = {w: known[w] for w in wanted if w in known}
        whole = [t for t, s in zip(texts, split, strict=True) if s is None]
        coded = [array("I", ids).tobytes() for ids in self.b.encode(new + whole, num_threads=1)]
        known.update(zip(new, coded[: len(new)], strict=True))
        rest = iter(coded[len(new) :])
        return [np.frombuffer(b"".join(map(known.__getitem__, s)) if s else next(rest), np.uint32) for s in split]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for texts that aren't covered byte by byte."""
        none = np.empty(0, np.uint32)
        a = [np.frombuffer(self.a.plain(" " + t), np.uint32) if t else none for t in texts]
        b = self.pieces(texts)
        raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        whole = b"".join(raw)
        if self.bytes_a(np.concatenate(a))[0] != whole or self.bytes_b(np.concatenate(b))[0] != whole or not _same_sizes(self, a, b, raw):
            for i, r in enumerate(raw):
                if self.bytes_a(a[i])[0] != r or self.bytes_b(b[i])[0] != r:
                    a[i] = b[i] = none
        return a, b


def _same_sizes(sides: Sides, a: list[np.ndarray], b: list[np.ndarray], raw: list[bytes]) -> bool:
    """Whether each document's tokens have as many bytes as the document."""
    want = np.fromiter(map(len, raw), np.int64, len(raw))
    for ids, size in ((a, sides.bytes_a.size), (b, sides.bytes_b.size)):
        total = np.r_[0, np.cumsum(size[np.concatenate(ids)], dtype=np.int64)]
        at = np.cumsum([0, *map(len, ids)])
        if (np.diff(total[at]) != want).any():
            return False
    return True


def _listed(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))


def align(sides: Sides, a: list[np.ndarray], b: list[np.ndarray]) -> dict:
    """Groups and links of a chunk of documents: group sizes of both sides, links by document and pair, and counts."""
    lists = {"a": _listed(a), "b": _listed(b)}
    tables = {}
    for side, slices in (("a", sides.bytes_a), ("b", sides.bytes_b)):
        ids = lists[side].flatten().cast(pa.int64())
        ends = pc.cumulative_sum(pa.array(slices.size).take(ids).cast(pa.int64()))
        tables[side] = pa.table({"end": ends, side: ids, f"doc_{side}": pc.list_parent_indices(lists[side]).cast(pa.int64())})
    places = tables["a"].join(tables["b"], "end", join_type="full outer", use_threads=False).sort_by("end")
    valid = {side: pc.is_valid(places.column(side)).to_numpy() for side in tables}
    both = valid["a"] & valid["b"]
    docs = places.column("doc_a").filter(pa.array(both))
    links = pa.table({"doc": pc.fill_null_backward(places.column("doc_a").combine_chunks()), "pair": pc.add(pc.multiply(pc.fill_null_backward(places.column("a").combine_chunks()), KEY), pc.fill_null_backward(places.column("b").combine_chunks()))})
    times = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    n = len(a)
    return {
        "last": {side: both[valid[side]] for side in tables},  # whether a token ends its group
        "n_groups": np.bincount(docs.to_numpy(), minlength=n),
        "n_links": np.bincount(links.column("doc").to_numpy(), minlength=n),
        "times": times,
        "partial": times.group_by("pair").aggregate([([], "count_all")]).rename_columns(["pair", "docs"]),
    }


def group_texts(sides: Sides, a: list[np.ndarray], b: list[np.ndarray], found: dict) -> list[bytes]:
    """Each document's groups as a text: ``a1,a2|b1;a3|b2,b3``."""
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    last_a, last_b = found["last"]["a"], found["last"]["b"]
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_a, n_b = np.diff(np.flatnonzero(last_a), prepend=-1), np.diff(np.flatnonzero(last_b), prepend=-1)
    text = np.empty(len(ids_a) + len(ids_b), np.int64)
    text[np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[of_a]] = ids_a + sides.na * last_a
    text[np.arange(len(ids_b)) + np.cumsum(n_a)[of_b]] = ids_b + 2 * sides.na + sides.nb * last_b
    data, at = sides.digits(text)
    stop = np.r_[0, at][np.cumsum([0, *(len(x) + len(y) for x, y in zip(a, b, strict=True))])].tolist()
    return [data[i : max(i, j - 1)] for i, j in zip(stop[:-1], stop[1:], strict=True)]


def aligned(docs: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, partial: int = PARTIAL) -> DataFrame:
    """Documents' rows (``row``: a number of its own; id, counts, groups, links by pair) and rows of partial counts (``row`` null).

    groups is the text of ``group_texts``, or with ``digest`` its SHA-256 (empty without tokens).
    """
    paths = (byte_tokenizer, piece_tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")]

    def said(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest() if digest and text else text.decode()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, row, held = _once(Sides, paths), TaskContext.get().partitionId() << 40, []
        none = pa.nulls
        for batch in batches:
            texts, i = batch.column(1), 0
            while i < batch.num_rows:
                part, size = [], 0
                while i + len(part) < batch.num_rows and (not part or size < CHUNK):
                    part.append(texts[i + len(part)].as_py() or "")
                    size += len(part[-1])
                a, b = sides.encode(part)
                found = align(sides, a, b)
                cut = np.searchsorted(found["times"].column("doc").to_numpy(), np.arange(len(part) + 1)).astype(np.int32)
                counts = [pa.array(found[c], pa.int64()) for c in ("n_groups", "n_links")]
                lists = [pa.ListArray.from_arrays(cut, found["times"].column(c).combine_chunks().cast(t)) for c, t in (("pair", pa.int64()), ("count_all", pa.int32()))]
                lengths = [pa.array(list(map(len, x)), pa.int64()) for x in (a, b)]
                groups = pa.array([said(x) for x in group_texts(sides, a, b, found)], pa.string())
                rows = pa.array(np.arange(row, row + len(part)))
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(i, len(part)), *lengths, *counts, groups, *lists, *[none(len(part), pa.list_(pa.int64()))] * 2], names=names)
                row, i = row + len(part), i + len(part)
                held.append(found["partial"])
                if sum(t.num_rows for t in held) > 2 * partial:
                    held = [_merged(held)]
                    if held[0].num_rows > partial:
                        yield _partial(held.pop(), batch.schema.field(0).type, names)
        if held:
            yield _partial(_merged(held), batch.schema.field(0).type, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(of, COLUMNS.format(id=id_type))


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair").aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])


def _partial(table: pa.Table, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """One row that holds a task's counts."""
    lists = [pa.array([table.column(c).to_numpy()], pa.list_(pa.int64())) for c in ("pair", "docs")]
    types = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), *lists], names=names)


def pair_counts(table: DataFrame) -> DataFrame:
    """``pair``, ``docs`` (how many documents link it) and ``best`` (no pair of its A id is in more), from ``aligned``'s rows."""
    parts = table.where("row IS NULL").select(F.explode(F.arrays_zip("part_pairs", "part_docs")).alias("p"))
    counts = parts.groupBy(F.col("p.part_pairs").alias("pair")).agg(F.sum("p.part_docs").alias("docs")).withColumn("a", F.shiftrightunsigned("pair", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(table: DataFrame, counts: DataFrame, most: int = BROADCAST) -> DataFrame:
    """Documents' rows of ``aligned`` with ``n_best`` and ``count_sum``; counts: ``pair_counts``, written."""
    spark = table.sparkSession
    by_size = {r.e: r.n for r in counts.groupBy(F.floor(F.log2("docs")).alias("e")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    floor, left = 63, most
    while floor >= 0 and by_size.get(floor, 0) <= left:
        left -= by_size.get(floor, 0)
        floor -= 1
    least = 1 << floor + 1  # pairs in as many documents or more are broadcast, ``most`` of them at most
    frequent = counts.where(F.col("docs") >= least).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast([frequent.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best")])
    rest = floor >= 0
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = known.value
        for b in batches:
            lists = b.column("pairs")
            flat, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy()
            doc = pc.list_parent_indices(lists).to_numpy()
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            sums = []
            for value in (best, docs):
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, doc[hit], value[at[hit]].astype(np.int64) * times[hit])
                sums.append(pa.array(total))
            cut = np.r_[0, np.cumsum(np.bincount(doc[~hit], minlength=b.num_rows))].astype(np.int32)
            other = [pa.ListArray.from_arrays(cut, pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *sums, *other], names=[*names, "n_best", "count_sum", "pairs", "times"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in names)
    out = table.where("row IS NOT NULL").select(*names, "pairs", "times").mapInArrow(of, f"{shape}, n_best long, count_sum long, pairs array<long>, times array<int>")
    if rest:
        links = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
        found = links.join(counts.where(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("docs") * F.col("times")).alias("s"))
        out = out.join(found, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    return out.select(*names, "n_best", "count_sum")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    table = written(aligned(documents(spark, sf_dir), *paths, digest=True), "alignment")
    out = scored(table, written(pair_counts(table), "alignment-pairs"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLE: dict[str, str] = {}
