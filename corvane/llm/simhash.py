"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits share a variant that is within 2 bits of one and 1 bit of the other.
So every fingerprint has all its variants within 2 bits (2,081) looked up among the variants within
1 bit (65) of all fingerprints; who meets there is linked, and the links are verified.

Variants are shuffled by ``route`` bits of their own. A fingerprint's variants fall into few routes
(its own, and those that differ from it in 1 or 2 route bits), so the fingerprint is sent once to
each of them and its variants are written out there, in blocks; the shuffle carries about
1 + b + b(b-1)/2 rows per fingerprint for b route bits instead of 2,081. b follows the number of
fingerprints, so a route's work stays bounded.

Only distinct fingerprints take part: copies collapse before the shuffle, and all fingerprints that
meet at a variant are linked to its smallest close one (which is within 3 bits of each of them), so
a group of g near copies gives links in proportion to g, not all pairs.

Defined cases: a null or empty text, or one without a word, has fingerprint zero, linked like any
other. Repeated rows get equal results. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents, written
from corvane.llm.components import components

BITS = 64
RADIUS = 3
SEED = 42
SHINGLE = 3
ROUTE_FINGERPRINTS = 4096  # fingerprints of its own that a route should have at most, about
BLOCK = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of whole-text word shingles, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        h = np.array([digest(flat[i:j], SEED) for i, j in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id_col and column ``fp`` (signed 64-bit) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))], pa.int64())], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(of, f"doc_id {id_type}, fp long").withColumnRenamed("doc_id", id_col)


def _masks(low: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` bits among the lowest ``low``."""
    one = np.left_shift(np.uint64(1), np.arange(low, dtype=np.uint64))
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2:
        i, j = np.triu_indices(low, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def route_links(route: int, fps: np.ndarray, away: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, c) with a met at a variant in this route whose smallest close fingerprint is c."""
    low = BITS - b
    # The fingerprints moved into the route: flipped route bits are the first part of the variant's mask.
    base = (fps & np.uint64((1 << low) - 1)) | np.uint64(route << low)
    keys, owners = [], []
    for spare in (0, 1):
        own = away == 1 - spare
        masks = _masks(low, spare)
        keys.append((base[own][:, None] ^ masks).ravel())
        owners.append(np.repeat(fps[own], len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    if not len(key):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(first)
    index, close = key[at], owner[at]
    held = [_links(owner, close[np.cumsum(first) - 1])]
    # A table of 2^22 marks turns most variants away before the binary search.
    shift, mix = np.uint64(42), np.uint64(0x9E3779B97F4A7C15)
    marks = np.zeros(1 << 22, bool)
    marks[(index * mix) >> shift] = True
    for spare in (0, 1, 2):
        own, masks = away == 2 - spare, _masks(low, spare)
        some, from_ = base[own], fps[own]
        step = max(1, BLOCK // len(masks))
        for i in range(0, len(some), step):
            probe = some[i : i + step, None] ^ masks
            hit = np.flatnonzero(marks[(probe.ravel() * mix) >> shift])
            v = probe.ravel()[hit]
            p = np.minimum(np.searchsorted(index, v), len(index) - 1)
            ok = index[p] == v
            held.append(_links(from_[i + hit[ok] // len(masks)], close[p[ok]]))
            if sum(len(x) for x in held) > 1 << 21:
                held = [np.unique(np.concatenate(held), axis=0)]
    out = np.unique(np.concatenate(held), axis=0)
    return out[:, 0], out[:, 1]


def _links(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    keep = a != c
    return np.unique(np.stack([a[keep], c[keep]], axis=1), axis=0)


def route_bits(n: int, each: int = ROUTE_FINGERPRINTS) -> int:
    return int(min(24, max(2, int(np.ceil(np.log2(max(1, n / each)))))))


def ball_links(distinct: DataFrame, b: int) -> DataFrame:
    """Verified links ``u``, ``v`` that join all fingerprints (column ``fp``, distinct) within 3 bits."""
    flips = [(0, 0), *[(1 << i, 1) for i in range(b)], *[((1 << i) | (1 << j), 2) for i in range(b) for j in range(i)]]
    sent = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("away")) for m, d in flips])).alias("s"))
    sent = sent.select(F.shiftrightunsigned("fp", BITS - b).bitwiseXOR(F.col("s.m").cast("long")).alias("route"), "fp", F.col("s.away").alias("away"))

    def links(key, table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        u, v = route_links(int(key[0].as_py()), fps, table.column("away").to_numpy(), b)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    found = sent.groupBy("route").applyInArrow(links, "u long, v long")
    return found.where(f"bit_count(u ^ v) <= {RADIUS}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Every row's fingerprint and component: id_col, ``fp``, ``component_id`` (smallest id reachable)."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    b = route_bits(least.count())
    comp = components(ball_links(least.select("fp"), b))
    grouped = least.join(comp, least.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
