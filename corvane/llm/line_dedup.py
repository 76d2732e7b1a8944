"""Line deduplication by an exact set-similarity join (prefix, length and positional filters).

A line's tokens are its distinct words between blanks. A line is removed if an earlier line (in order
of document id, then line number) has a Jaccard similarity of ``SIMILARITY`` or more with it, both as
they are in the input. Lines without a word stay.

1. Rarity: words are counted in a sketch over all rows, graded to a byte each; it has a counter for
   every ``TEXT_PER_COUNTER`` bytes of text, ``COUNTERS`` (64 MB) at most, so it is broadcast. (count,
   hash) is one global order of all words, whatever collides.
2. Each line's words are sorted, rarest first. Two similar lines share a word among their first
   n - ceil(0.8 n) + 1, so only these are sent, with the line's length, the word's position and 128
   parity bits. A word counted once can't be shared and isn't sent. Tasks send packed arrays,
   one row per bucket of words; exact repeats within a block are settled before, those of lines with
   a hot word (counted more than ``HOT`` times) within a task, as far as ``SEEN`` lines are remembered.
   A hot word is dealt into up to ``PARTS`` parts: each of its lines is the later one in one of them only.
   Beyond that its lines are dealt by the words they have: words are divided by hash into one block more
   than similar lines of that length can differ by, so such lines have all words of some block in common,
   and meet there. So a line sends no more than a constant number of rows for a word, however often it is counted.
3. Within a word, later lines are compared with earlier ones of the neighbouring length classes:
   signatures (each differing bit is a differing word), then lengths and positions. A line gets at most
   ``FIRST`` candidates per word; if a word had more and none of the line's is confirmed, a second round
   compares the line with all that have the word.
4. Candidates' word sets (of lines that a Bloom filter lets through) are joined and the Jaccard
   similarity is computed exactly.

So groups of g near copies cost in proportion to g, and no pair that decides a removal is lost.

Defined cases: null texts stay null and have no lines. Rows with equal ids stand for one document;
their lines at equal places don't remove each other. Rows without an id are passed through. An empty
table stays empty. ``dedup_lines`` keeps all columns as they are, whatever their names; its count is
named ``removed_lines``, with underscores after it while the input has that name. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import documents, free_name, written

SIMILARITY = (4, 5)  # as a fraction, for exact whole-number arithmetic
COUNTERS = 1 << 26
TEXT_PER_COUNTER = 64
CHUNK = 1 << 20  # counters or bits that one task adds up
BLOCK = 1 << 19
LONG_BLOCK = 1 << 22
LONG_WORD = 256
FIRST = 4
HOT = 1 << 17
PARTS = 8
SEEN = 1 << 18
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 64
BLOOM_BYTES = 1 << 25

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BLANKS = [b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word between blanks, and the places of the line feeds."""
    padded = data + bytes(8)
    b = np.frombuffer(padded, np.uint8, len(data))
    blank = (b == 32) | (b - np.uint8(9) < 5)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(b) and not blank[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(b))
    start, size = edge[::2], edge[1::2] - edge[::2]
    # Words are taken eight bytes at a time; what lies beyond a word's end is masked.
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = _mix(_mix(size.astype(np.uint64) * _ODD) ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG_WORD:
        h[more] = _mix(h[more] ^ (eight[start[more] + at] & _MASK[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return h, start, np.flatnonzero(b == 10)


def _passed(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the marks lie at or before each of the places ``at``; both ascend."""
    return np.cumsum(np.bincount(np.searchsorted(at, marks), minlength=len(at) + 1))[: len(at)]


def _utf8(texts: pa.Array) -> list:
    """The bytes of each text as views into Arrow's buffer; None for null."""
    if not len(texts) or texts.buffers()[2] is None:
        return [None if n else b"" for n in texts.is_null().to_pylist()]
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2])
    parts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return [p if ok else None for p, ok in zip(parts, texts.is_valid().to_pylist(), strict=True)] if texts.null_count else parts


def blocks(batches: Iterator[pa.RecordBatch], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of whole texts in blocks: hash, document id, line number. All words of a line are in one block.

    wanted: a function from document ids to the ones to read; others are passed over.
    """

    def made(docs, parts):
        h, start, feeds = words(b"\n".join(parts))
        begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        part = _passed(begin[1:], start)
        return h, np.array(docs, np.int64)[part], _passed(feeds, start) - np.searchsorted(feeds, begin)[part]

    docs, parts, held = [], [], 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        if wanted is not None:
            ok = wanted(np.array([d or 0 for d in ids], np.int64)).tolist()
            ids = [d if x else None for d, x in zip(ids, ok, strict=True)]
        for doc, data in zip(ids, _utf8(batch.column(1)), strict=True):
            if doc is None or not data:
                continue
            if docs and held + len(data) > BLOCK:
                yield made(docs, parts)
                docs, parts, held = [], [], 0
            if len(data) > BLOCK:
                yield _long(doc, bytes(data))
                continue
            docs.append(doc)
            parts.append(data)
            held += len(data) + 1
    if docs:
        yield made(docs, parts)


def _long(doc: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a long text, read in parts that end at blanks."""
    hs, lines, first, at = [], [], 0, 0
    while at < len(data):
        end = at + LONG_BLOCK
        while end < len(data):
            cut = max(data.rfind(c, at, end) for c in _BLANKS)
            if cut >= at:
                end = cut + 1
                break
            end += LONG_BLOCK
        h, start, feeds = words(data[at:end])
        hs.append(h)
        lines.append(_passed(feeds, start) + first)
        first += len(feeds)
        at = end
    h = np.concatenate(hs)
    return h, np.full(len(h), doc, np.int64), np.concatenate(lines)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0


def counters_for(size: int) -> int:
    """Counters of a sketch of texts of so many bytes: a power of two, ``COUNTERS`` at most."""
    return min(COUNTERS, max(1 << 16, 1 << (size // TEXT_PER_COUNTER).bit_length()))


def sketch(docs: DataFrame, id_col: str, text_col: str, counters: int, read=blocks) -> np.ndarray:
    """Counts of all words by the low bits of their hash, graded to a byte each (see ``_grade``).

    read: what makes blocks of hashes of the batches, as ``blocks`` does.
    """
    each = min(counters, CHUNK)
    chunks = counters // each

    def count(batches):
        held, n = [], 0

        def emit():
            slot, c = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(slot, np.arange(chunks + 1) * each)
            rows = [(k, slot[a:b], c[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array([(s - k * each).astype("<u4").tobytes() for k, s, _ in rows], pa.binary()), pa.array([x.astype("<u4").tobytes() for _, _, x in rows], pa.binary())], names=["chunk", "slots", "counts"])

        for h, _, _ in read(batches):
            held.append((h & np.uint64(counters - 1)).astype(np.uint32))
            n += len(h)
            if n > 1 << 22:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    def add(batches):  # the partial sketches of this partition's chunks, one table for each chunk
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s, c in zip(*(b.column(i) for i in range(3)), strict=True):
                t = total.setdefault(k.as_py(), np.zeros(each, np.int64))
                t[np.frombuffer(s.as_buffer(), "<u4")] += np.frombuffer(c.as_buffer(), "<u4")
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_grade(t).tobytes()], pa.binary())], names=["chunk", "grades"])

    schema = "chunk int, slots binary, counts binary"
    partial = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(count, schema)
    out = np.zeros(counters, np.uint8)  # a byte for each counter comes to the driver
    for r in partial.repartition(chunks, "chunk").mapInArrow(add, "chunk int, grades binary").collect():
        out[r.chunk * each : (r.chunk + 1) * each] = np.frombuffer(r.grades, np.uint8)
    return out


def _grade(n: np.ndarray) -> np.ndarray:
    """A count in one byte: itself up to 32, above eight steps for each doubling."""
    return np.where(n <= 32, n, np.minimum(255, 32 + np.floor(8 * np.log2(np.maximum(n, 32) / 32)))).astype(np.uint8)


#: The most that a graded count can stand for.
_AT_MOST = np.array([g if g < 32 else 32 * 2 ** ((g - 31) / 8) for g in range(256)])


def line_sets(h: np.ndarray, doc: np.ndarray, line: np.ndarray, counts: np.ndarray):
    """Distinct words of each line, rarest first: hash, count, line index; and per line: doc, line, start, n."""
    if not len(h):
        e = np.empty(0, np.int64)
        return h, e, e, e, e, e, e
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]
    key = np.cumsum(fresh) - 1
    c = counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]
    # One sort key: line, count, upper half of the hash. Only if two hashes agree in that half is all of it sorted.
    whole = (key.astype(np.uint64) << np.uint64(40)) | (c.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    order = np.argsort(whole)
    whole = whole[order]
    if key[-1] >= 1 << 24 or ((whole[1:] == whole[:-1]) & (h[order[1:]] != h[order[:-1]])).any():
        order = np.lexsort((h, c, key))
    h, key, c = h[order], key[order], c[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])]
    h, key, c = h[keep], key[keep], c[keep]
    n = np.bincount(key, minlength=int(fresh.sum()))
    start = np.cumsum(n) - n
    first = np.flatnonzero(fresh)
    return h, c, key, doc[first], line[first], start, n


def _prefix(n: np.ndarray) -> np.ndarray:
    p, q = SIMILARITY
    return n - -(-p * n // q) + 1


def _kind(n: np.ndarray) -> np.ndarray:
    """Length class: classes of similar lines differ by one at most, as the base is over 5 / 4."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.26)).astype(np.int64)


def _blocks_of(kind: np.ndarray) -> np.ndarray:
    """Blocks for pairs of lines of a length class or the one below: one more than the words by which they can differ."""
    p, q = SIMILARITY
    return ((q - p) * 2 * np.ceil(1.26 ** (kind + 1.0)) // (p + q)).astype(np.int64) + 1


def shares(h: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks of the lines ``at``, for their length class and the next: key, place in ``at``.

    Two similar lines have a key in common; a key stands for all words of a line that fall into one block.
    """
    keys, places = [], []
    size = n[at]
    word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at], size)
    w = _mix(h[word] + _ODD)
    for above in (0, 1):
        kind = _kind(size) + above
        count = _blocks_of(kind)
        begin = np.cumsum(count) - count
        place = np.repeat(np.arange(len(at)), count)
        block = np.arange(count.sum()) - begin[place]
        total = _mix((kind[place] << 32 | block).astype(np.uint64) + np.uint64(1))
        np.add.at(total, np.repeat(begin, size) + (w % np.repeat(count, size).astype(np.uint64)).astype(np.int64), _mix(w))
        keys.append(_mix(total))
        places.append(place)
    return np.concatenate(keys), np.concatenate(places)


def _signature(h: np.ndarray, start: np.ndarray, half: int) -> np.ndarray:
    """One half of a line's 128 parity bits: a word flips one bit, so two lines differ by at least as many words as bits."""
    bit = np.left_shift(np.uint64(1), h >> np.uint64(58))
    return np.bitwise_xor.reduceat(np.where((h >> np.uint64(57)) & np.uint64(1) == half, bit, np.uint64(0)), start)


ROW = np.dtype([("token", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("same", "<u4"), ("sig", "<u8"), ("sig2", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("part", "<u2"), ("parts", "<u2")])
PLACE = np.dtype([("doc", "<i8"), ("line", "<u4")])
MADE = np.dtype([("d", "<i8"), ("l", "<i8"), ("d0", "<i8"), ("l0", "<i8"), ("s", "<i4")])


def pack(r: np.ndarray) -> bytes:
    """Rows as bytes, field after field, so that they compress well."""
    return b"".join(r[f].tobytes() for f in r.dtype.names)


def unpack(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    out, at = np.zeros(sum(len(p) for p in parts) // kind.itemsize, kind), 0
    for p in parts:
        n, begin = len(p) // kind.itemsize, 0
        for f in kind.names:
            out[f][at : at + n] = np.frombuffer(p, kind[f], n, begin)
            begin += n * kind[f].itemsize
        at += n
    return out


def _in_order(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Places of lines by document, then line; lines alike in both in any order."""
    if len(doc) and int(doc.max()) - int(doc.min()) < 1 << 31:  # one sort key
        return np.argsort((doc - doc.min()) << 32 | line.astype(np.int64))
    return np.lexsort((line, doc))


def _alike(same: np.ndarray, sig: np.ndarray, n: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of lines that have equal ones (in all of same, sig and n), and of the earliest of each one's equals."""
    order = np.argsort(same)
    equal = same[order[1:]] == same[order[:-1]]
    o = order[(np.r_[False, equal] | np.r_[equal, False])[: len(order)]]  # most lines have a sum of their own
    o = o[np.lexsort((line[o], doc[o], n[o], sig[o], same[o]))]
    if not len(o):
        return o, o
    alike = np.r_[False, (same[o[1:]] == same[o[:-1]]) & (sig[o[1:]] == sig[o[:-1]]) & (n[o[1:]] == n[o[:-1]])]
    return o, o[np.maximum.accumulate(np.where(alike, 0, np.arange(len(o))))]


def _ref_of(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return _mix(doc.astype(np.uint64) * _ODD + line.astype(np.uint64))


def _ref(r: np.ndarray) -> np.ndarray:
    return _ref_of(r["doc"], r["line"])


def _in_parts(k, t, at, parts, some):
    """Rows of some words dealt into parts, one for each part: line, word, its position, part, number of parts."""
    k, t, at, parts = k[some], t[some], at[some], parts[some]
    copy = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return *(np.repeat(x, parts) for x in (k, t, at)), copy, np.repeat(parts, parts)


def _in_blocks(k, t, at, some, h, start, n):
    """Rows of some words dealt by blocks, one for each block of their line: as ``_in_parts``, with the block's key and 0 parts."""
    k, t, at = k[some], t[some], at[some]
    lines, of = np.unique(k, return_inverse=True)
    keys, place = shares(h, start, n, lines)
    order = np.argsort(place, kind="stable")
    keys, each = keys[order], np.bincount(place, minlength=len(lines))
    begin, count = (np.cumsum(each) - each)[of], each[of]
    i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    return *(np.repeat(x, count) for x in (k, t, at)), (keys[i] >> np.uint64(1)).astype(np.int64), np.zeros(len(i), np.int64)


def prefix_rows(docs: DataFrame, counts, n_buckets: int, id_col: str, text_col: str, tokens=None) -> DataFrame:
    """Packed prefix rows by bucket of their word; and exact repeats settled within a block: bucket, settled, rows.

    tokens: a broadcast Bloom table of words; only their rows are sent.
    """

    def send(batches):
        table = counts.value
        seen: dict[tuple[int, int], tuple[int, int]] = {}  # the earliest of equal lines with a hot word that this task has had
        for h, doc, line in blocks(batches):
            if tokens is not None and len(h):  # lines with one of the words only
                fresh = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])
                some = np.logical_or.reduceat(_in_bloom(tokens.value, _mix(h & np.uint64(0xFFFFFFFF))), fresh)
                some = np.repeat(some, np.diff(np.append(fresh, len(h))))
                h, doc, line = h[some], doc[some], line[some]
            h, c, key, ldoc, lline, start, n = line_sets(h, doc, line, table)
            if not len(h):
                continue
            sig, sig2, same = _signature(h, start, 0), _signature(h, start, 1), np.add.reduceat(_mix(h), start)
            # Exact repeats within the block: the earliest line stands for them. The same place in another row of its document is no repeat.
            o, first = _alike(same, sig, n, ldoc, lline)
            again = np.zeros(len(n), bool)
            again[o] = (ldoc[o] != ldoc[first]) | (lline[o] != lline[first])
            pos = np.arange(len(h)) - start[key]
            use = ~again[key] & (pos < _prefix(n)[key]) & (c > 1)
            earlier = []  # places that the task took for the earliest of their lines until now
            for i in np.unique(key[use & (_AT_MOST[c] > HOT)]).tolist():
                what, place = (int(same[i]), int(sig[i]) ^ int(n[i])), (int(ldoc[i]), int(lline[i]))
                known = seen.get(what)
                if known is None or place < known:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[what] = place
                    if known is not None:
                        earlier.append(known)
                elif place > known:
                    again[i] = True
            use &= ~again[key]
            gone = np.zeros(int(again.sum()) + len(earlier), PLACE)
            gone["doc"][: len(gone) - len(earlier)], gone["line"][: len(gone) - len(earlier)] = ldoc[again], lline[again]
            for i, place in enumerate(earlier, len(gone) - len(earlier)):
                gone[i] = place
            if tokens is not None:
                use &= _in_bloom(tokens.value, _mix(h & np.uint64(0xFFFFFFFF)))
            k, t, at = key[use], h[use], pos[use]
            parts = np.ceil(_AT_MOST[c[use]] / HOT).astype(np.int64)
            k, t, at, copy, parts = (np.concatenate(x) for x in zip(_in_parts(k, t, at, parts, parts <= PARTS), _in_blocks(k, t, at, parts > PARTS, h, start, n), strict=True))
            out = np.zeros(len(k), ROW)
            out["token"], out["n"], out["pos"], out["same"] = t & np.uint64(0xFFFFFFFF), n[k], at, same[k] >> np.uint64(32)
            out["sig"], out["sig2"], out["doc"], out["line"], out["part"], out["parts"] = sig[k], sig2[k], ldoc[k], lline[k], copy & 0xFFFF, parts
            bucket = (np.where(copy == 0, t >> np.uint64(32), _mix(t + copy.astype(np.uint64)) >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            ids, at = np.unique(bucket, return_index=True)
            rows = [(int(b), False, pack(p)) for b, p in zip(ids, np.split(out, at[1:]), strict=True)] if len(out) else []
            if len(gone):
                rows.append((int(gone["doc"][0] % n_buckets), True, pack(gone)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "settled", "rows"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(send, "bucket int, settled boolean, rows binary")


def compare(r: np.ndarray, first: int, only: np.ndarray | None = None) -> np.ndarray:
    """Candidates (later line, earlier line, state) among the prefix rows of one bucket.

    state 0: exact repeat; 1: candidate; 2: more than ``first`` candidates for the word in the place of the earlier line.
    only: whether each row may be the later line.
    """
    p, q = SIMILARITY
    mine = (r["parts"] == 0) | (_ref(r) % np.maximum(r["parts"], 1).astype(np.uint64) == r["part"])
    if only is not None:
        mine &= only
    order = _in_order(r["doc"], r["line"])
    r, mine = r[order], mine[order]
    lists = (r["token"].astype(np.uint64) << np.uint64(16)) | r["part"]  # lines are compared within a word, and a part or block of it
    alike = _mix(r["sig"] ^ _mix(lists ^ (r["same"].astype(np.uint64) << np.uint64(32)) * _ODD) ^ (r["n"].astype(np.uint64) * _ODD))
    order = np.argsort(alike)  # repeats of a line side by side
    head = np.flatnonzero(np.r_[True, alike[order[1:]] != alike[order[:-1]]][: len(r)])
    source = np.empty(len(r), np.int64)  # the earliest of each row's repeats
    source[order] = np.repeat(np.minimum.reduceat(order, head) if len(r) else order, np.diff(np.append(head, len(r))))
    twin = source != np.arange(len(r))
    # A repeat is told by its line's rarest word only.
    some = np.flatnonzero(twin & (r["pos"] == 0))
    some = some[(r["doc"][some] != r["doc"][source[some]]) | (r["line"][some] != r["line"][source[some]])]
    repeats = np.zeros(len(some), MADE)
    repeats["d"], repeats["l"] = r["doc"][some], r["line"][some]
    stay = np.flatnonzero(~twin)
    r, mine, lists = r[stay], mine[stay], lists[stay]
    # By word, length class and place.
    kind = _kind(r["n"])
    both = (np.unique(lists, return_inverse=True)[1] << 7 | kind) * max(1, len(r)) + np.arange(len(r))
    order = np.argsort(both)
    r, mine, both = r[order], mine[order], both[order]
    rank, group = order.astype(np.int64), both // max(1, len(r))  # rank: places in the order of lines
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(r)])
    size = np.diff(np.append(head, len(r)))
    n, pos, sig, sig2 = r["n"].astype(np.int64), r["pos"].astype(np.int64), r["sig"], r["sig2"]
    most = n // 4  # words by which similar lines differ
    found = np.zeros(len(r), np.int64)
    late, early, state = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, bool)]  # pairs by their places in r
    for beside in (0, -1, 1):
        at = np.searchsorted(group[head], group[head] + beside)  # the class beside each one
        at[at == len(head)] = 0
        begin, count = np.repeat(head[at], size), np.zeros(len(r), np.int64)
        there = np.flatnonzero(mine & np.repeat(group[head[at]] == group[head] + beside, size))
        count[there] = np.searchsorted(both, (group[there] + beside) * max(1, len(r)) + rank[there]) - begin[there]
        active = np.flatnonzero(mine & (count > 0) & (found <= first))
        step = 0
        while len(active):
            i, j = active, begin[active] + step
            near = np.bitwise_count(sig[i] ^ sig[j]) <= most[i]
            i, j = i[near], j[near]
            a, b = n[i], n[j]
            need = -(-(a + b) * p // (p + q))
            ok = (q * np.minimum(a, b) >= p * np.maximum(a, b)) & (1 + np.minimum(a - pos[i] - 1, b - pos[j] - 1) >= need - np.minimum(pos[i], pos[j]))
            ok &= (np.bitwise_count(sig[i] ^ sig[j]).astype(np.int64) + np.bitwise_count(sig2[i] ^ sig2[j]) <= a + b - 2 * need) & ((r["doc"][i] != r["doc"][j]) | (r["line"][i] != r["line"][j]))
            i, j = i[ok], j[ok]
            found[i] += 1
            late.append(i.astype(np.int32))
            early.append(j.astype(np.int32))
            state.append(found[i] > first)
            step += 1
            active = active[(count[active] > step) & (found[active] <= first)]
    i, j, more = (np.concatenate(x) for x in (late, early, state))
    made = np.zeros(len(i), MADE)
    made["d"], made["l"], made["s"] = r["doc"][i], r["line"][i], np.where(more, 2, 1)
    made["d0"] = np.where(more, r["token"][i], r["doc"][j])  # of state 2 the word is told instead of an earlier line
    made["l0"] = np.where(more, 0, r["line"][j])
    return np.concatenate([repeats, made])


PAIRS = "d long, l long, d0 long, l0 long, s int"


def candidates(rows: DataFrame, first: int, only=None) -> DataFrame:
    """Candidate and settled pairs of all buckets. only: a broadcast Bloom table of the lines to compare."""

    def of(key, table):
        parts, settled = table.column("rows").to_pylist(), table.column("settled").to_pylist()
        gone = unpack([p for p, s in zip(parts, settled, strict=True) if s], PLACE)
        packed = unpack([p for p, s in zip(parts, settled, strict=True) if not s], ROW)
        m = compare(packed, first, None if only is None else _in_bloom(only.value, _ref(packed)))
        none = np.zeros(len(gone), np.int64)
        ends = {"d": gone["doc"], "l": gone["line"].astype(np.int64), "d0": none, "l0": none, "s": none.astype(np.int32)}
        return pa.table({k: np.concatenate([m[k], ends[k]]) for k in ends})

    return rows.groupBy("bucket").applyInArrow(of, PAIRS)


def _in_bloom(bits: np.ndarray, ref: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ref), bool)
    for k in (0, 17, 34):
        at = (ref >> np.uint64(k)) & np.uint64(len(bits) * 8 - 1)
        ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def bloom(refs: DataFrame) -> np.ndarray:
    """Bloom filter over rows (d, l): two bytes for each row, ``BLOOM_BYTES`` (32 MB) at most."""
    size = min(BLOOM_BYTES, max(1 << 10, 1 << (2 * refs.count()).bit_length()))
    each = min(size * 8, CHUNK)
    chunks = size * 8 // each

    def mark(batches):
        for b in batches:
            ref = _ref_of(b.column(0).to_numpy(), b.column(1).to_numpy())
            at = np.unique(np.concatenate([(ref >> np.uint64(k)) & np.uint64(size * 8 - 1) for k in (0, 17, 34)])).astype(np.int64)
            cut = np.searchsorted(at, np.arange(chunks + 1) * each)
            rows = [(k, at[x:y] - k * each) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x.astype("<u4").tobytes() for _, x in rows], pa.binary())], names=["chunk", "bits"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(k, np.zeros(each, bool))[np.frombuffer(x, "<u4")] = True
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(size, np.uint8)
    schema = "chunk int, bits binary"
    for r in refs.select("d", "l").mapInArrow(mark, schema).repartition(chunks, "chunk").mapInArrow(merge, schema).collect():
        at = r.chunk * each // 8
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def sets_of(docs: DataFrame, counts, wanted, id_col: str, text_col: str) -> DataFrame:
    """Word sets of the lines that the Bloom filter lets through: d, l, words."""

    def of(batches):
        for h, doc, line in blocks(batches, lambda d: _in_bloom(wanted.value, _ref_of(d, np.full(len(d), -1)))):
            if not len(h):
                continue
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])
            ok = np.repeat(_in_bloom(wanted.value, _ref_of(doc[first], line[first])), np.diff(np.append(first, len(h))))
            h, c, key, ldoc, lline, start, n = line_sets(h[ok], doc[ok], line[ok], counts.value)
            if len(h):
                ends = np.append(start, len(h)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ldoc, pa.int64()), pa.array(lline, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["d", "l", "words"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(of, "d long, l long, words array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, counts, id_col: str, text_col: str) -> DataFrame:
    """Later lines (d, l) of the pairs (d, l, d0, l0, votes) whose Jaccard similarity is high enough.

    A line's pair with most votes (words that tell it) is checked first; the others of a line only if that
    one isn't similar.
    """
    spark = docs.sparkSession
    p, q = SIMILARITY
    ends = pairs.select("d", "l").union(pairs.select("d0", "l0")).distinct()
    ends = written(ends.union(ends.select("d", F.lit(-1).cast("long")).distinct()), "line-ends")  # and their documents
    wanted = spark.sparkContext.broadcast(bloom(ends))
    sets = written(sets_of(docs, counts, wanted, id_col, text_col), "line-sets")

    def similar(some: DataFrame) -> DataFrame:
        both = some.select("d", "l", "d0", "l0").join(sets.toDF("d0", "l0", "b"), ["d0", "l0"]).join(sets.withColumnRenamed("words", "a"), ["d", "l"])
        common = F.size(F.array_intersect("a", "b"))
        return both.where(q * common >= p * (F.size("a") + F.size("b") - common)).select("d", "l")

    best = pairs.groupBy("d", "l").agg(F.max_by(F.struct("d0", "l0"), F.struct("votes", -F.col("d0"), -F.col("l0"))).alias("e")).select("d", "l", "e.d0", "e.l0")
    first = written(similar(best).distinct(), "lines-similar")
    return first.union(similar(pairs.join(first, ["d", "l"], "left_anti")).distinct())


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to remove: d (document id), l (line number from 0)."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    size = text_bytes(docs, text_col)
    counts = spark.sparkContext.broadcast(sketch(docs, id_col, text_col, counters_for(size)))
    n_buckets = max(LEAST_BUCKETS, size // 30 // BUCKET_ROWS + 1)
    found = written(candidates(prefix_rows(docs, counts, n_buckets, id_col, text_col), FIRST), "line-candidates")
    settled = found.where("s = 0").select("d", "l").distinct()
    votes = F.count("*").alias("votes")
    near = written(found.where("s > 0").join(settled, ["d", "l"], "left_anti").groupBy("d", "l", "d0", "l0", "s").agg(votes), "line-near")
    pairs = near.where("s = 1").drop("s")
    gone = written(settled.union(_verified(pairs, docs, counts, id_col, text_col)), "lines-gone")
    # Lines with words that had more candidates, none of them confirmed: compared with all that have the word.
    open_ = written(near.where("s = 2").join(gone, ["d", "l"], "left_anti"), "lines-open")
    if not open_.limit(1).count():
        return gone
    only = spark.sparkContext.broadcast(bloom(open_))
    tokens = spark.sparkContext.broadcast(bloom(open_.select(F.lit(0).cast("long").alias("d"), F.col("d0").alias("l")).distinct()))
    more = candidates(prefix_rows(docs, counts, n_buckets, id_col, text_col, tokens).where("not settled"), 1 << 40, only)
    pairs = written(more.where("s = 1").groupBy("d", "l", "d0", "l0").agg(votes), "lines-more")
    return gone.union(_verified(pairs, docs, counts, id_col, text_col))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of their texts, and column ``removed_lines`` (a count)."""
    lines = removed_lines(docs, id_col, text_col)
    id_, gone_, hit_ = (free_name(n, docs.columns) for n in ("ld_id", "ld_gone", "ld_hit"))
    count = free_name("removed_lines", docs.columns)
    gone = written(lines.groupBy(F.col("d").alias(id_)).agg(F.collect_set(F.col("l").cast("int")).alias(gone_)), "lines-by-document")
    hit = docs.sparkSession.sparkContext.broadcast(bloom(gone.select(F.col(id_).alias("d"), F.lit(0).cast("long").alias("l"))))

    @F.arrow_udf("boolean")
    def may_have(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        return pa.array(known & _in_bloom(hit.value, _ref_of(ids, np.zeros(len(ids), np.int64))))

    every = [F.col(f"`{c}`") for c in docs.columns]
    # Only documents that the Bloom filter lets through are shuffled with their texts, at every size: lists of lines grow with the input.
    marked = docs.withColumn(hit_, may_have(F.col(f"`{id_col}`").cast("long")))
    out = marked.where(F.col(hit_)).join(gone.hint("shuffle_merge"), F.col(f"`{id_col}`") == F.col(id_), "left")
    left = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.array_contains(gone_, i))
    kept = F.when(F.col(gone_).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n"))
    taken = F.when(F.col(gone_).isNull(), 0).otherwise(F.size(gone_)).cast("long").alias(count)
    out = out.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], taken)
    return out.union(marked.where(~F.col(hit_)).select(*every, F.lit(0).cast("long")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", F.col("removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: SQL of the kept texts over a table ``docs0``: the same join, with words ordered by document frequency.
LINES_SQL = """
l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs0 WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, unnest(ls) AS tx, generate_subscripts(ls, 1) - 1 AS line FROM l0),
l2 AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(tx, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS ws FROM l1),
l3 AS (SELECT ws, min((doc_id, line)) AS fst, row_number() OVER (ORDER BY ws) AS cls FROM l2 WHERE len(ws) >= 1 GROUP BY ws),
l4 AS (SELECT cls, len(ws) AS n, unnest(ws) AS w FROM l3),
l5 AS (SELECT *, count(*) OVER (PARTITION BY w) AS df FROM l4),
l6 AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY df, w) AS pos FROM l5),
l7 AS (SELECT cls, n, w FROM l6 WHERE df > 1 AND pos <= n - ceil(0.8::DECIMAL(9,1) * n) + 1),
l8 AS (SELECT DISTINCT a.cls AS c1, b.cls AS c2 FROM l7 a JOIN l7 b USING (w) WHERE a.cls <> b.cls AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
l9 AS (SELECT c1, x.fst, y.fst AS other FROM l8 JOIN l3 x ON x.cls = c1 JOIN l3 y ON y.cls = c2
       WHERE y.fst < x.fst AND 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (len(x.ws) + len(y.ws))),
l10 AS (SELECT doc_id, line FROM l2 JOIN l3 USING (ws) WHERE (doc_id, line) <> fst OR cls IN (SELECT c1 FROM l9)),
l11 AS (SELECT l1.doc_id, string_agg(tx, chr(10) ORDER BY l1.line) FILTER (WHERE l10.line IS NULL) AS kept, count(*) AS n_lines, count(l10.line) AS n_removed
        FROM l1 LEFT JOIN l10 ON l1.doc_id = l10.doc_id AND l1.line = l10.line GROUP BY l1.doc_id)
"""
ORACLE = {"op6_line_dedup": "WITH docs0 AS (SELECT * FROM documents)," + LINES_SQL + "SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs0 d LEFT JOIN l11 USING (doc_id)"}
QUERIES = {"op6_line_dedup": op6_line_dedup}
