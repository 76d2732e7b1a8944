"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

An entry is a canonical prefix, ``host/path...`` in lower-case host letters. It fits a url if the
entry's host is the url's host or a parent domain of it and the url's path starts with the entry's
path. The longest fitting entry decides; a url that no entry fits gets the default verdict.

A url's candidate keys are its host suffixes times the path prefixes of the lengths that occur in
the list. The Bloom filter is a table of 256-bit blocks (four 64-bit words, one bit in each), built
with ``bit_or`` and so mergeable. Its size is known from the list's count: up to ``BROADCAST_BYTES``
it is broadcast, beyond that it is joined by block id. Keys that pass go to a hash join with the
list, which removes the false positives, so the result is exact for any filter size.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits nothing and gets
the default verdict. Repeated rows are judged alike. Entries that repeat count once; of two verdicts
for the same entry ``block`` wins. An empty list gives every url the default. Other columns of the
pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
WORDS = 4
BROADCAST_BYTES = 32 << 20

# The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n_blocks))


def _words(key: Column) -> list[Column]:
    """The bit that the key has in each word of its block."""
    h = F.xxhash64(key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(WORDS)]


def bloom_blocks(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter of column ``key``: one row per non-empty block; and the number of blocks."""
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(_words(F.col("key")))])
    return bits.groupBy("block").agg(*[F.expr(f"bit_or(w{j})").alias(f"w{j}") for j in range(WORDS)]), n_blocks


def bloom_pass(keys: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``keys`` whose column ``key`` may be in the filter."""
    small = n_blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES
    probe = keys.withColumn("block", _block(F.col("key"), n_blocks))
    hit = [F.col(f"w{j}").bitwiseAND(w) == w for j, w in enumerate(_words(F.col("key")))]
    joined = probe.join(F.broadcast(blocks) if small else blocks, "block")
    for h in hit:
        joined = joined.where(h)
    return joined.select(keys.columns)


def filter_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url. entries: columns ``rule`` (canonical prefix) and ``verdict``.

    Returns id_col, host, path, rule (null if none fits), verdict.
    """
    if id_col.lower() in ("host", "path", "rule", "verdict"):
        raise ValueError(f"an id column can't be named {id_col}: the result has a column of that name")
    listed = entries.where("rule is not null and instr(rule, '/') > 0").groupBy(F.col("rule").alias("key")).agg(F.max("verdict").alias("verdict"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    host, path = split_url("url")
    urls = urls.select("id", host.alias("host"), path.alias("path"))
    none = lambda rows: rows.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_keys = listed.count()
    if not n_keys:
        return none(urls).withColumnRenamed("id", id_col)
    blocks, n_blocks = bloom_blocks(listed.select("key"), n_keys)
    # What has no host or path can't fit a rule; it is many rows of one key, and isn't joined.
    whole = (F.col("host") != "") & (F.col("path") != "")
    shapes = urls.where(whole).select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 10000), '.'))")
    # One row with the lengths of the rules' paths; a url meets those up to its own path's.
    lengths = listed.agg(F.array_sort(F.collect_set(F.expr("length(key) - instr(key, '/') + 1"))).alias("lengths"))
    keys = (
        shapes.crossJoin(F.broadcast(lengths))
        .withColumn("n", F.explode(F.expr("filter(lengths, n -> n <= length(path))")))
        .withColumn("suffix", F.explode(suffixes))
        .select("host", "path", F.expr("concat(suffix, substring(path, 1, n))").alias("key"))
    )
    possible = bloom_pass(keys, blocks, n_blocks)
    exact = possible.join(listed, "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("verdict"))).alias("best"))
    judged = urls.where(whole).join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.union(none(urls.where(~whole))).withColumnRenamed("id", id_col)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, spark.createDataFrame(RULES, "rule string, verdict string"))


ORACLE = {
    "op2_url_filter": """
WITH r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
s AS (SELECT row_number() OVER () AS n, page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT n, page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
f AS (SELECT u.n, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
      FROM u JOIN r ON (u.host = split_part(r.rule, '/', 1) OR ends_with(u.host, '.' || split_part(r.rule, '/', 1)))
                   AND starts_with(u.path, substr(r.rule, strpos(r.rule, '/')))
      GROUP BY u.n)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON u.n = f.n
""",
}
QUERIES = {"op2_url_filter": op2_url_filter}
