"""Removal of repeated passages of words by difference-cover anchors.

A word is removed if a window of ``WINDOW`` (13) words that covers it also starts, with the same words,
in a document with a smaller id, both as they are in the input.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions i and j there is a d < PERIOD
such that (i + d) and (j + d) both lie in the cover, modulo the period. So of two equal windows, wherever
they lie in their documents, some ``WINDOW - PERIOD + 1`` words begin at a cover position of both.

1. Documents are grouped into shards of a few MB. A shard hashes these shorter strings (anchors) at
   cover positions only, three of seven, and sends each distinct one once (4 bytes), by bucket of hashes.
2. Buckets tell each shard, with one bit an anchor, which of them occur in another document.
3. Shards extend the shared anchors to the windows that hold them, and send each distinct window's
   64-bit hash once with the smallest id that has it, by a second hash, so bucket and hash tell windows apart.
4. Buckets find each window's smallest id and reply with one bit: whether it is smaller than the shard's own.
5. Shards mark the words of those windows, and of the ones that a smaller id of the same shard has.

All five steps are one plan; the texts are shuffled once and read from that shuffle three times. A
passage is sent once per shard, however many documents hold it, so no key gathers rows of its copies.

Defined cases: a null text counts as empty (no words). Rows without an id keep all their words and are
no source; rows with equal ids don't remove from each other. Repeated rows get equal results. An empty
table gives no rows. Other columns, whatever their names, are carried by ``remove_passages`` as they are.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import documents
from corvane.llm.line_dedup import words
from corvane.llm.suffix_dedup import _by_bucket, _keys, _pack, _table, _unpack

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
SHARD_BYTES = 4 << 20
SCAN_BYTES = 4 << 20  # of a text that are turned into words at once
BITS = [pa.int64(), pa.int64(), pa.binary()]
_BLANKS = b" \t\n\x0b\x0c\r"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word; long texts are cut at a blank and taken in turn."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SCAN_BYTES)
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        out.append(words(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def windows(h: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each ``size`` words in a row, put together from those of 1, 2, 4... words."""
    n, k, done, out = len(h) - size + 1, 1, 0, None
    if n <= 0:
        return np.empty(0, np.uint64)
    while True:
        if size & k:
            part = h[done : done + n]
            out = part if out is None else _mix(out * np.uint64(seed) + part)
            done += k
        if done == size:
            return out
        h, k = _mix(h[:-k] * np.uint64(seed) + h[k:]), 2 * k


class Shard:
    """Words of a shard's documents, in a fixed order of the documents."""

    def __init__(self, table: pa.Table, window: int, period: int, cover: tuple):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        self.order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        hashes = [word_hashes(texts[i].encode("utf-8", "surrogatepass")) for i in self.order]
        size = np.fromiter(map(len, hashes), np.int64, len(hashes))
        self.begin = np.cumsum(size) - size
        self.h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.h)) - np.repeat(self.begin, size)
        self.window, self.period, self.cover = window, period, np.isin(np.arange(period), cover)

    def inside(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each place on lie in one document."""
        return self.doc[: len(self.doc) - size + 1] == self.doc[size - 1 :] if len(self.doc) >= size else np.empty(0, bool)

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and key of each anchor."""
        size = self.window - self.period + 1
        ok = self.inside(size)
        at = np.flatnonzero(ok & self.cover[self.place[: len(ok)] % self.period])
        return at, _keys(windows(self.h, size)[at], buckets)

    def candidates(self, at: np.ndarray, shared: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash and bucket of the windows that hold a shared anchor."""
        ok = self.inside(self.window)
        seen = np.zeros(len(self.h) + 1, np.int64)
        seen[at[shared] + 1] = 1
        seen = np.cumsum(seen)
        first = np.flatnonzero(ok)
        first = first[seen[first + self.period] > seen[first]]
        to = windows(self.h, self.window, 0xD6E8FEB86659FD93)[first] % np.uint64(buckets)
        return first, windows(self.h, self.window)[first], to.astype(np.int64)


def _distinct(shard: Shard, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, whether each occurs in two documents, and each occurrence's place among them."""
    if not len(keys):
        return keys, np.empty(0, bool), np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], shard.ids[shard.doc[at[order]]]
    head = np.r_[True, k[1:] != k[:-1]]
    first = np.flatnonzero(head)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(head) - 1
    return k[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), of


def _told(reply: pa.Table, kind: int) -> dict[int, bytes]:
    some = reply.filter(pc.equal(reply.column("kind"), kind))
    return dict(zip(some.column("bucket").to_pylist(), some.column("bits").to_pylist(), strict=True))


def _candidates(shard: Shard, reply: pa.Table, buckets: int):
    """Windows of the shared anchors, and their distinct (bucket, smallest id, hash) in order.

    Returns place, class of each; and the classes' bucket, smallest id and hash.
    """
    at, keys = shard.anchors(buckets)
    distinct, _, of = _distinct(shard, at, keys)
    shared = np.zeros(len(distinct), bool)
    told = _told(reply, 0)
    bucket, ends = _by_bucket(distinct)
    for b, i, j in zip(bucket.tolist(), ends[:-1], ends[1:], strict=True):
        if b in told:
            shared[i:j] = _unpack(told[b], int(j - i))
    first, h, to = shard.candidates(at, shared[of], buckets)
    doc = shard.ids[shard.doc[first]]
    order = np.lexsort((doc, h, to))
    hs, ts = h[order], to[order]
    head = np.r_[True, (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])] if len(order) else np.empty(0, bool)
    one = order[head]
    least = doc[one]
    rank = np.lexsort((h[one], least, to[one]))  # by bucket, then id: an id is sent once for its windows
    place = np.empty(len(one), np.int64)
    place[rank] = np.arange(len(one))
    cls = np.empty(len(order), np.int64)
    cls[order] = place[np.cumsum(head) - 1]
    one = one[rank]
    return first, cls, to[one], doc[one], h[one]


def _plan(docs: DataFrame, shards: int, buckets: int, window: int, period: int, cover: tuple, schema: T.StructType) -> DataFrame:
    """docs: doc_id long, text string, shard, rest. Per row: doc_id, n_words, kept, spans, rest."""

    def anchors(key, table):
        shard = Shard(table, window, period, cover)
        at, keys = shard.anchors(buckets)
        distinct, twice, _ = _distinct(shard, at, keys)
        bucket, ends = _by_bucket(distinct)
        rows = [(int(b), key[0].as_py(), (distinct[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), _pack(twice[i:j])) for b, i, j in zip(bucket, ends[:-1], ends[1:], strict=True)]
        return _table(rows, ["bucket", "shard", "keys", "twice"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def shared(key, table):
        lists = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        size = [len(x) for x in lists]
        twice = np.concatenate([_unpack(b, n) for b, n in zip(table.column("twice").to_pylist(), size, strict=True)])
        _, of, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        more = np.bincount(of, twice, len(n)) > 0
        parts = np.split(((n > 1) | more)[of], np.cumsum(size)[:-1])
        return _table([(s, key[0].as_py(), _pack(x)) for s, x in zip(table.column("shard").to_pylist(), parts, strict=True) if x.any()], ["shard", "bucket", "bits"], BITS)

    def extended(key, table, reply):
        names, types = ["bucket", "shard", "ids", "counts", "hashes"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not table.num_rows or not reply.num_rows:
            return _table([], names, types)
        _, _, to, least, h = _candidates(Shard(table, window, period, cover), reply.append_column("kind", pa.repeat(pa.scalar(0), reply.num_rows)), buckets)
        rows = []
        bucket, ends = np.unique(to, return_index=True)
        ends = np.append(ends, len(to))
        for b, i, j in zip(bucket.tolist(), ends[:-1], ends[1:], strict=True):
            ids, counts = np.unique(least[i:j], return_counts=True)
            rows.append((b, key[0].as_py(), ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), h[i:j].astype("<u8").tobytes()))
        return _table(rows, names, types)

    def smaller(key, table):
        lists = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        of_ids = [np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4")) for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        h, ids = np.concatenate(lists), np.concatenate(of_ids)
        order = np.argsort(h)
        first = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(h))))
        parts = np.split(least < ids, np.cumsum([len(x) for x in lists])[:-1])
        return _table([(s, key[0].as_py(), _pack(x)) for s, x in zip(table.column("shard").to_pylist(), parts, strict=True) if x.any()], ["shard", "bucket", "bits"], BITS)

    def cut(key, table, reply):
        shard = Shard(table, window, period, cover)
        gone: dict[int, np.ndarray] = {}
        if reply.num_rows:
            first, cls, to, least, _ = _candidates(shard, reply, buckets)
            low = np.zeros(len(to), bool)
            for b, bits in _told(reply, 1).items():
                i, j = np.searchsorted(to, [b, b + 1])
                low[i:j] = _unpack(bits, int(j - i))
            doc = shard.doc[first]
            hit = first[low[cls] | (least[cls] < shard.ids[doc])] if len(first) else first
            marks = np.zeros(len(shard.h) + 1, np.int64)
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + window, -1)
            covered = np.cumsum(marks[:-1]) > 0
            for d in np.unique(shard.doc[hit]).tolist():
                end = shard.begin[d + 1] if d + 1 < len(shard.begin) else len(shard.h)
                gone[shard.order[d]] = covered[shard.begin[d] : end]
        n, removed, kept, spans = [], [], [], []
        for i, text in enumerate(table.column("text").to_pylist()):
            w = text.encode("utf-8", "surrogatepass").split()
            g = gone.get(i)
            n.append(len(w))
            removed.append(0 if g is None else int(g.sum()))
            kept.append(b" ".join(w if g is None else compress(w, (~g).tolist())))
            spans.append([] if g is None else np.flatnonzero(np.diff(np.r_[0, g.astype(np.int8), 0])).tolist())
        return pa.table([table.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64())), table.column("rest")], names=["doc_id", "n_words", "n_removed", "kept", "spans", "rest"])

    told = "shard long, bucket long, bits binary"
    by_shard = docs.groupBy("shard")
    first = by_shard.applyInArrow(anchors, "bucket long, shard long, keys binary, twice binary").groupBy("bucket").applyInArrow(shared, told)
    second = by_shard.cogroup(first.groupBy("shard")).applyInArrow(extended, "bucket long, shard long, ids binary, counts binary, hashes binary")
    last = second.groupBy("bucket").applyInArrow(smaller, told)
    both = first.withColumn("kind", F.lit(0)).union(last.withColumn("kind", F.lit(1)))
    return by_shard.cogroup(both.groupBy("shard")).applyInArrow(cut, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), window: int = WINDOW, period: int = PERIOD, cover: tuple = COVER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row's ``doc_id`` (a long), ``n_words``, ``n_removed``, ``kept`` (the remaining words' bytes, joined by one
    space), ``spans`` (removed words: begin, end, begin, end...) and ``rest`` (a structure of the columns ``carry``).
    """
    if not 0 < period <= window or not {(a - b) % period for a in cover for b in cover} == set(range(period)):
        raise ValueError("the cover must have every difference modulo a period that fits the window")
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("int")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), rest.alias("rest"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    kinds = {"doc_id": T.LongType(), "n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.BinaryType(), "spans": T.ArrayType(T.LongType())}
    schema = T.StructType([*(T.StructField(n, k) for n, k in kinds.items()), base.schema["rest"]])
    base = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(shards)))
    return _plan(base, shards, max(4, shards // 2), window, period, tuple(cover), schema)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated words taken out of their texts, the rest joined by one space; other columns as they are."""
    carry = [c for c in docs.columns if c != text_col]
    out = repeats(docs, id_col, text_col, carry, **options)
    made = {c: F.col(f"rest.c{i}") for i, c in enumerate(carry)} | {text_col: F.col("kept").cast("string")}
    return out.select(*[made[c].alias(c) for c in docs.columns])


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLE = {
    "op11_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
        m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
        g AS (SELECT DISTINCT doc_id, i + o AS i FROM p JOIN m USING (k), range({WINDOW}) AS r(o) WHERE least < doc_id),
        s AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM s ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
}
