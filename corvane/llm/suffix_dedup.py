"""Removal of repeated byte strings by suffix arrays.

A byte is removed if a string of ``LENGTH`` (50) bytes that covers it also starts in a document with a
smaller id, both as they are in the input. The work is spread by content:

1. Every 50-byte string is owned by the smallest hash of its 24-byte strings, so equal strings have
   equal owners wherever they are. Documents are grouped into shards of a few MB; each sends its
   distinct owners (4 bytes each), by bucket of owners.
2. Buckets tell each shard which of its owners occur in another document (one bit), and which occur
   in very many shards.
3. Shards send the runs of bytes whose strings have such an owner: each distinct run once, with the
   smallest id that has it. Strings whose owner is in very many shards go singly, by their own hash,
   so no bucket gathers them all.
4. Buckets build suffix arrays over their runs, in parts of bounded size: Larsson-Sadakane refinement
   in numpy (only groups that aren't settled are sorted again, by rank pairs at doubled distance),
   then Kasai's common prefixes (only irreducible ones are compared, the others follow). Suffixes
   with common prefixes of 50 bytes or more are one string; parts are merged by binary search in the
   sorted strings. The reply is one bit a string: whether a smaller id has it.
5. Shards mark the strings' bytes and cut the texts.

All five steps are one plan; the texts are shuffled once and read from that shuffle three times. A
copied passage is sent once per shard and kept once per bucket, however many documents hold it.

Defined cases: a null text counts as empty. Rows without an id are passed whole and are no source;
rows with equal ids don't remove from each other. Other columns are ignored by ``repeats``. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import documents

LENGTH, K = 50, 24
SPAN = LENGTH - K + 1  # 24-byte strings in a string
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 18
PART_BYTES = 2 << 20
RUN = 64
STRIDE = 32
HOT_SHARDS = 512

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_tables: dict[str, np.ndarray] = {}


def _powers(which: str) -> np.ndarray:
    if which not in _tables:
        out = np.full(BLOCK_BYTES + 1, _BASE if which == "up" else pow(_BASE, -1, 1 << 64), np.uint64)
        out[0] = 1
        _tables[which] = np.cumprod(out)
    return _tables[which]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Block:
    """Texts, or overlapping parts of long ones, side by side."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        """parts: (document's place in the shard, offset in its text, bytes)."""
        self.raw = b"".join(p[2] for p in parts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        size = np.array([len(p[2]) for p in parts], np.int64)
        self.begin = np.cumsum(size) - size
        self.doc, self.offset, self.size = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64), size
        n = len(self.bytes)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.bytes] * _powers("up")[:n])])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.total[start + size] - self.total[start]) * _powers("down")[start])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of strings with one owner: first string's position, strings, owner, part."""
        n = len(self.bytes) - LENGTH + 1
        e = np.empty(0, np.int64)
        if n <= 0:
            return e, e, e.astype(np.uint64), e
        k = len(self.bytes) - K + 1
        m = _mix((self.total[K:] - self.total[:k]) * _powers("down")[:k])
        for d in (1, 2, 4, 8):
            m = np.minimum(m[:-d], m[d:])
        m = np.minimum(m[: n], m[SPAN - 16 : SPAN - 16 + n])
        valid = np.zeros(n, bool)
        for a, size in zip(self.begin.tolist(), self.size.tolist(), strict=True):
            if size >= LENGTH:
                valid[a : a + size - LENGTH + 1] = True
        edge = np.r_[True, (m[1:] != m[:-1]) | (valid[1:] != valid[:-1])]
        starts_part = np.zeros(n, bool)
        starts_part[self.begin[self.begin < n]] = True
        at = np.flatnonzero(edge | starts_part)
        long = np.diff(np.append(at, n))
        keep = valid[at]
        at, long = at[keep], long[keep]
        pieces = -(-long // RUN)  # a run of equal owners may be long in periodic text
        if (pieces > 1).any():
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            whole = np.repeat(long, pieces)
            at = np.repeat(at, pieces) + step * RUN
            long = np.minimum(RUN, whole - step * RUN)
        return at, long, m[at], np.searchsorted(self.begin, at, "right") - 1


def blocks(texts: list[bytes]):
    parts, held = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        step = BLOCK_BYTES // 2
        for a in range(0, max(1, len(t) - LENGTH + 1), step):
            part = t[a : a + step + LENGTH - 1]
            if held + len(part) > BLOCK_BYTES and parts:
                yield Block(parts)
                parts, held = [], 0
            parts.append((i, a, part))
            held += len(part)
    if parts:
        yield Block(parts)


def _order(table: pa.Table) -> list[int]:
    """A shard's rows in an order of their own (id, text), those without an id last; rows that are equal in both are alike here."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))


def _shard(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and bytes of a shard's documents that have an id."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = [i for i in _order(table) if ids[i] is not None]
    return [ids[i] for i in order], [texts[i].encode("utf-8", "surrogatepass") for i in order]


def _keys(owner: np.ndarray, buckets: int) -> np.ndarray:
    return (((owner >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (owner & np.uint64(0xFFFFFFFF))


def _by_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted keys, and where each begins (with the end)."""
    ids, at = np.unique(keys >> np.uint64(32), return_index=True)
    return ids.astype(np.int64), np.append(at, len(keys))


def _scan(texts: list[bytes], buckets: int) -> list[tuple]:
    """Per block: the block and its runs' start, strings, owner key and part."""
    out = []
    for b in blocks(texts):
        start, n, owner, part = b.runs()
        out.append((b, start, n, _keys(owner, buckets), part))
    return out


def _owners(ids: list, scanned: list[tuple]):
    """Distinct owner keys of a shard, sorted; and whether each is in two documents of the shard."""
    doc = np.array(ids, np.int64)
    if not scanned:
        return np.empty(0, np.uint64), np.empty(0, bool)
    k = np.concatenate([f[3] for f in scanned])
    d = np.concatenate([doc[f[0].doc[f[4]]] for f in scanned])
    order = np.argsort(k)
    k, d = k[order], d[order]
    if not len(k):
        return np.empty(0, np.uint64), np.empty(0, bool)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)


def _pack(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unpack(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _replied(table: pa.Table, n_of: dict[int, int]) -> dict[int, tuple]:
    cols = [table.column(c).to_pylist() for c in ("bucket", "bits", "hot")]
    return {b: (_unpack(x, n_of[b]), _unpack(y, n_of[b]) if y else None) for b, x, y in zip(*cols, strict=True)}


def _pieces(ids: list, texts: list[bytes], buckets: int, reply: pa.Table):
    """What a shard sends of its shared runs: per block (block, position, strings, class), and the classes.

    Classes (distinct runs) are sorted by bucket and hash: bucket key, smallest id, strings, and the
    (block, position) where the class is found first.
    """
    scanned = _scan(texts, buckets)
    keys, of = np.unique(np.concatenate([f[3] for f in scanned]) if scanned else np.empty(0, np.uint64), return_inverse=True)
    bucket, at = _by_bucket(keys)
    n_of = {int(b): int(at[i + 1] - at[i]) for i, b in enumerate(bucket)}
    shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    told = _replied(reply, n_of)
    for i, b in enumerate(bucket):
        if int(b) in told:
            shared[at[i] : at[i + 1]], hot[at[i] : at[i + 1]] = told[int(b)]
    doc = np.array(ids, np.int64)
    found, done = [], 0
    for b, start, n, key, part in scanned:
        i = of[done : done + len(key)]
        done += len(key)
        use = shared[i]
        single = use & hot[i]
        plain = use & ~single
        reps = n[single]
        s1 = np.repeat(start[single], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        start = np.concatenate([start[plain], s1])
        n1 = np.concatenate([n[plain], np.ones(len(s1), np.int64)])
        part = np.concatenate([part[plain], np.repeat(part[single], reps)])
        content = b.hash(start, n1 + LENGTH - 1) ^ n1.astype(np.uint64)
        to = np.concatenate([key[plain] >> np.uint64(32), (content[plain.sum() :] >> np.uint64(20)) % np.uint64(buckets)])
        found.append((b, start, n1, part, content, to, doc[b.doc[part]]))
    return found


def _classes(found):
    """Distinct (bucket, content) of the pieces: order of the classes, class of each piece, and firsts."""
    content = np.concatenate([f[4] for f in found])
    to = np.concatenate([f[5] for f in found])
    ids = np.concatenate([f[6] for f in found])
    order = np.lexsort((ids, content, to))
    c, t = content[order], to[order]
    head = np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])]
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(head) - 1
    first = order[head]
    return cls, first, t[head].astype(np.int64), ids[first]


def _eights(text: np.ndarray, n: int) -> np.ndarray:
    """The eight letters from each of the first n places on as one number; zeros follow the text."""
    x = np.zeros(n + 8, np.uint8)
    x[: len(text)] = text
    for bits, kind in ((8, np.uint16), (16, np.uint32), (32, np.uint64)):
        k = bits // 8
        x = (x[:-k].astype(kind) << kind(bits)) | x[k:]
    return x[:n]


def larsson_sadakane(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes (uint8).

    Ranks start from 8-byte prefixes and are refined by the rank 8, 16, 32... places on, sorting only
    the suffixes whose rank isn't settled yet.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    key = _eights(text, n)
    sa = np.argsort(key)
    # Zero padding equals zero bytes: the last 7 suffixes are put before longer ones by length below.
    k = key[sa]
    head = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, n))
    group = np.repeat(first, size)
    rank[sa] = group
    # Suffixes shorter than 8 are told from others with the same padded key by their length.
    step = 1 if (size[np.searchsorted(first, rank[max(0, n - 7) : n])] > 1).any() else 8
    if step == 1:  # only with zero bytes near the end: refine from single bytes
        key = text.astype(np.int64)
        sa = np.argsort(key)
        k = key[sa]
        head = np.r_[True, k[1:] != k[:-1]]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, n))
        group = np.repeat(first, size)
        rank[sa] = group
    todo = np.flatnonzero(np.repeat(size, size) > 1)  # places in sa of unsettled groups
    h = step
    while len(todo):
        suffix, g = sa[todo], group[todo]
        nxt = rank[np.minimum(suffix + h, n)]
        pair = g * (n + 2) + nxt + 1
        order = np.argsort(pair)
        suffix, pair = suffix[order], pair[order]
        sa[todo] = suffix
        head = np.r_[True, pair[1:] != pair[:-1]]
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(todo)))
        new = np.repeat(todo[begin], size)
        rank[suffix] = new
        group[todo] = new
        todo = todo[np.repeat(size, size) > 1]
        h *= 2
    return sa


def kasai(text: np.ndarray, sa: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in sa, up to ``most``.

    By Kasai's lemma a suffix's common prefix is one shorter than its left neighbour's in the text if
    the same letter stands before both suffixes; so only the others are compared.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    left = np.empty_like(text)
    left[1:], left[0] = text[:-1], 0
    follows = (i > 0) & (before > 0) & (left == left[before])
    # Comparing stops at most + STRIDE letters, so every STRIDE-th suffix in a row that follows is compared too.
    anchor = np.maximum.accumulate(np.where(follows, 0, i))
    at = np.flatnonzero(~follows | ((i - anchor) % STRIDE == 0))
    other, length = before[at], np.zeros(len(at), np.int64)
    key = _eights(text, n + most + STRIDE)
    live = np.flatnonzero(other >= 0)
    for k in range(0, most + STRIDE, 8):  # eight letters at a time
        x = key[at[live] + k] ^ key[other[live] + k]
        same = np.full(len(x), 8, np.int64)
        apart = np.flatnonzero(x)
        same[apart] = sum((x[apart] < (np.uint64(1) << np.uint64(64 - 8 * j))).astype(np.int64) for j in range(1, 8))
        length[live] += same
        live = live[x == 0]
        if not len(live):
            break
    length = np.minimum(length, n - np.maximum(at, other))  # not beyond the end
    length[other < 0] = 0
    counts = np.diff(np.append(at, n))
    plcp = np.repeat(length, counts) - (i - np.repeat(at, counts))
    return np.minimum(plcp, most)[sa]


def _strings(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The strings at the given positions as sortable items; a final 1 keeps their zero bytes."""
    out = np.ones((len(start), LENGTH + 1), np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start]
    return out.view(f"S{LENGTH + 1}").ravel()


def least_ids(runs: list[bytes], ids: np.ndarray) -> np.ndarray:
    """For distinct runs with their smallest ids: of each of their strings in turn, the smallest id that has it."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    counts = sizes - LENGTH + 1
    ends = np.cumsum(sizes)
    parts, a = [], 0
    while a < len(runs):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_BYTES, "right")))
        parts.append((a, b))
        a = b
    found, merged, known = [], None, None
    for a, b in parts:
        data = np.frombuffer(b"".join(runs[a:b]), np.uint8)
        size, n = sizes[a:b], counts[a:b]
        begin = np.cumsum(size) - size
        start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        is_start = np.full(len(data), -1, np.int64)
        is_start[start] = np.arange(len(start))
        owner = np.repeat(ids[a:b], n)
        sa = larsson_sadakane(data)
        same = kasai(data, sa) >= LENGTH
        group = np.cumsum(~same) - 1
        use = is_start[sa] >= 0
        pos, group = is_start[sa[use]], group[use]
        fresh = np.r_[True, group[1:] != group[:-1]]
        head = np.flatnonzero(fresh)
        least = np.minimum.reduceat(owner[pos], head)
        of = np.empty(len(start), np.int64)
        of[pos] = np.cumsum(fresh) - 1
        if len(parts) == 1:
            return least[of]
        items = _strings(data, start[pos[head]])
        found.append((items, of))
        if merged is None:
            merged, known = items, least
            continue
        at = np.searchsorted(merged, items)
        hit = at < len(merged)
        hit[hit] = merged[at[hit]] == items[hit]
        known[at[hit]] = np.minimum(known[at[hit]], least[hit])
        merged, known = np.insert(merged, at[~hit], items[~hit]), np.insert(known, at[~hit], least[~hit])
    return np.concatenate([known[np.searchsorted(merged, items)][of] for items, of in found])


def _plan(docs: DataFrame, shards: int, buckets: int, hot_shards: int) -> DataFrame:
    """docs: doc_id long, text string, rest, shard. Per document: doc_id, kept bytes, removed spans, rest."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("whole", T.BinaryType()), T.StructField("spans", longs), docs.schema["rest"]])

    def owners(key, table):
        ids, texts = _shard(table)
        keys, twice = _owners(ids, _scan(texts, buckets))
        bucket, at = _by_bucket(keys)
        rows = [(int(b), key[0].as_py(), (keys[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), _pack(twice[i:j])) for b, i, j in zip(bucket, at[:-1], at[1:], strict=True)]
        return _table(rows, ["bucket", "shard", "keys", "twice"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def shared(key, table):
        shard, lists = table.column("shard").to_pylist(), [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        size = [len(x) for x in lists]
        every = np.concatenate(lists)
        twice = np.concatenate([_unpack(b, n) for b, n in zip(table.column("twice").to_pylist(), size, strict=True)])
        _, of, n = np.unique(every, return_inverse=True, return_counts=True)
        more = np.bincount(of, twice, len(n)) > 0
        ok, hot = ((n > 1) | more)[of], (n > hot_shards)[of]
        cut = np.cumsum(size)[:-1]
        rows = [(s, key[0].as_py(), _pack(x), _pack(y)) for s, x, y in zip(shard, np.split(ok, cut), np.split(hot, cut), strict=True) if x.any()]
        return _table(rows, ["shard", "bucket", "bits", "hot"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def runs(key, table, reply):
        names, types = ["bucket", "shard", "sizes", "ids", "data"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not table.num_rows or not reply.num_rows:
            return _table([], names, types)
        ids, texts = _shard(table)
        found = _pieces(ids, texts, buckets, reply)
        found = [f for f in found if len(f[1])]
        if not found:
            return _table([], names, types)
        _, first, to, least = _classes(found)
        block_end = np.cumsum([len(f[1]) for f in found])
        which = np.searchsorted(block_end, first, "right")
        begin = np.concatenate([f[1] for f in found])[first]
        size = np.concatenate([f[2] for f in found])[first] + LENGTH - 1
        raw = [f[0].raw for f in found]
        data = [raw[w][a:z] for w, a, z in zip(which.tolist(), begin.tolist(), (begin + size).tolist(), strict=True)]
        bucket, at = np.unique(to, return_index=True)
        at = np.append(at, len(to))
        rows = [(int(b), key[0].as_py(), size[i:j].astype("<u2").tobytes(), least[i:j].astype("<i8").tobytes(), b"".join(data[i:j])) for b, i, j in zip(bucket, at[:-1], at[1:], strict=True)]
        return _table(rows, names, types)

    def smaller(key, table):
        shard = table.column("shard").to_pylist()
        place: dict[bytes, int] = {}
        sent = []
        for size, ids, data in zip(*(table.column(c).to_pylist() for c in ("sizes", "ids", "data")), strict=True):
            ends = np.cumsum(np.frombuffer(size, "<u2").astype(np.int64))
            runs = [data[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            sent.append((np.array([place.setdefault(r, len(place)) for r in runs], np.int64), np.frombuffer(ids, "<i8")))
        least = np.full(len(place), np.iinfo(np.int64).max)
        for own, ids in sent:
            np.minimum.at(least, own, ids)
        runs = list(place)
        n = np.fromiter(map(len, runs), np.int64, len(runs)) - LENGTH + 1
        at = np.cumsum(n) - n
        found = least_ids(runs, least)
        rows = []
        for s, (own, ids) in zip(shard, sent, strict=True):
            k = n[own]
            bits = found[np.repeat(at[own], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)] < np.repeat(ids, k)
            if bits.any():
                rows.append((s, key[0].as_py(), _pack(bits), None))
        return _table(rows, ["shard", "bucket", "bits", "hot"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def cut(key, table, reply):
        names, types = ["doc_id", "kept", "whole", "spans"], [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        order = _order(table)
        all_ids, all_texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        all_ids, all_texts = [all_ids[i] for i in order], [all_texts[i].encode("utf-8", "surrogatepass") for i in order]
        ids = [d for d in all_ids if d is not None]  # those without come last
        texts = all_texts[: len(ids)]
        said = [(b, x) for b, x, kind in zip(*(reply.column(c).to_pylist() for c in ("bucket", "bits", "kind")), strict=True) if kind == 1]
        first_reply = reply.filter(pc.equal(reply.column("kind"), 0))
        found = [f for f in _pieces(ids, texts, buckets, first_reply) if len(f[1])] if first_reply.num_rows else []
        if not found:
            return _table([(d, t, None, []) for d, t in zip(all_ids, all_texts, strict=True)], names, types).append_column("rest", table.column("rest").take(pa.array(order, pa.int64())))
        cls, first, to, least = _classes(found)
        n_all = np.concatenate([f[2] for f in found])
        n_cls = n_all[first]
        at = np.cumsum(n_cls) - n_cls
        low = np.zeros(int(n_cls.sum()), bool)  # a smaller id elsewhere, by string of each class
        begin = np.searchsorted(to, [b for b, _ in said])
        end = np.searchsorted(to, [b for b, _ in said], "right")
        for (b, x), i, j in zip(said, begin, end, strict=True):
            if j > i:
                a, z = at[i], at[j - 1] + n_cls[j - 1]
                low[a:z] = _unpack(x, int(z - a))
        # All texts one after another, each with a zero byte behind it, so that no span goes from one into the next.
        flat = b"\0".join([*texts, b""])
        letters = np.frombuffer(flat, np.uint8)
        place = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts = np.zeros(len(flat), bool)
        k = 0
        for b, start, n, part, _, _, doc in found:
            c = cls[k : k + len(start)]
            k += len(start)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = low[np.repeat(at[c], n) + inner] | np.repeat(least[c] < doc, n)
            moved = start + (place[b.doc[part]] + b.offset[part] - b.begin[part])
            starts[(np.repeat(moved, n) + inner)[hit]] = True
        gone = np.cumsum(starts, dtype=np.int32)
        gone[LENGTH:] -= gone[:-LENGTH].copy()
        gone = gone > 0
        left = np.cumsum(np.r_[0, ~gone])[place].tolist()
        kept_bytes = letters[~gone].tobytes()
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))  # begin, end, begin, end...
        of = np.searchsorted(place, edge, "right") - 1
        inside = (edge - place[of]).tolist()
        cut_at = np.searchsorted(edge, place).tolist()
        # Characters that a span cuts into: their other bytes go too.
        into = set(of[(letters[edge] & 0xC0) == 0x80].tolist())
        rows = []
        for i, (d, t) in enumerate(zip(all_ids, all_texts, strict=True)):
            if i >= len(ids) or cut_at[i] == cut_at[i + 1]:
                rows.append((d, t, None, []))
                continue
            whole = None
            if i in into:
                a, z = int(place[i]), int(place[i + 1]) - 1
                begin = np.flatnonzero((letters[a:z] & 0xC0) != 0x80)
                part_gone = np.repeat(np.logical_or.reduceat(gone[a:z], begin), np.diff(np.r_[begin, z - a]))
                whole = letters[a:z][~part_gone].tobytes()
            rows.append((d, kept_bytes[left[i] : left[i + 1] - 1], whole, inside[cut_at[i] : cut_at[i + 1]]))
        return _table(rows, names, types).append_column("rest", table.column("rest").take(pa.array(order, pa.int64())))

    told = "shard long, bucket long, bits binary, hot binary"
    by_shard = docs.groupBy("shard")
    sent = by_shard.applyInArrow(owners, "bucket long, shard long, keys binary, twice binary")
    first = sent.groupBy("bucket").applyInArrow(shared, told)
    second = by_shard.cogroup(first.groupBy("shard")).applyInArrow(runs, "bucket long, shard long, sizes binary, ids binary, data binary")
    last = second.groupBy("bucket").applyInArrow(smaller, told)
    both = first.withColumn("kind", F.lit(0)).union(last.withColumn("kind", F.lit(1)))
    return by_shard.cogroup(both.groupBy("shard")).applyInArrow(cut, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), shard_bytes: int = SHARD_BYTES, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """Every row's id_col, ``kept`` (the remaining bytes), ``whole`` (the remaining whole characters' bytes,
    where a span cuts into a character; else null), ``spans`` (begin, end, begin, end... in bytes)
    and ``rest`` (a structure of the columns ``carry``, as they are; null without any)."""
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("int")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), rest.alias("rest"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    base = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(shards)))
    return _plan(base, shards, max(4, shards), hot_shards).withColumnRenamed("doc_id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of their texts; a character that is cut into is dropped.

    The other columns travel with their row as they are, so texts aren't joined again. Null texts become empty.
    Ids are whole numbers (strings of digits are read as such); columns may have any names.
    """
    carry = [c for c in docs.columns if c != text_col]
    out = repeats(docs, id_col, text_col, carry)
    made = {c: F.col(f"rest.c{i}") for i, c in enumerate(carry)} | {text_col: F.coalesce("whole", "kept").cast("string")}
    return out.select(*[made[c].alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(documents(spark, sf_dir))
    removed = F.expr("CASE WHEN size(spans) = 0 THEN 0L ELSE aggregate(transform(sequence(0, size(spans) div 2 - 1), i -> get(spans, 2 * i + 1) - get(spans, 2 * i)), 0L, (a, x) -> a + x) END")
    out = out.withColumn("n_removed", removed)
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", F.expr("cast(size(spans) div 2 as long)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE: dict[str, str] = {}
