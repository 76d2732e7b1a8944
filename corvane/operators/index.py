"""The code index: symbols, references, dependencies and file states kept up to date from scans of files.

An update compares a scan's listing with the kept file states, extracts the new and changed files only,
and sets or deletes their groups of rows in all tables of a ``Store`` in one version. Files that a scan
no longer has are found by an anti join and deleted. So a crash leaves the last whole index, and an update
that is run again changes nothing.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import extract, symbols
from corvane.sources.store import BUCKETS, COMPACT_EVERY, Change, Store, Table

HASHED_BYTES = 50 << 20
SYMBOLS = "file string, symbol string, kind string, lang string, qualified_name string, scope string, scope_depth int, line_start int, line_end int, signature string, return_type string, parameters array<string>, decorators array<string>, bases array<string>, relation_targets array<string>, attributes array<string>"
REFERENCES = "file string, source_symbol string, target_symbol string, relation string, line int, source string, confidence double"
DEPENDENCIES = "edge_from string, edge_to string, edge_type string, weight double"
STATES = "path string, mtime long, size long, content_hash string, lang string"
SCAN = "scan long, path string, mtime long, size long, lang string, text string"


def index_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    """The index's four tables in a folder."""
    return Store(spark, root, {"symbols": Table("file", SYMBOLS, buckets), "references": Table("file", REFERENCES, buckets), "dependencies": Table("edge_from", DEPENDENCIES, buckets), "states": Table("path", STATES, buckets)})


def content_hash(text: str = "text", size: str = "size", mtime: str = "mtime", path: str = "path"):
    """SHA-256 of a file's content; of a large one's path, size and time, so that it isn't read for it."""
    large = F.sha2(F.concat_ws(":", path, F.col(size).cast("string"), F.col(mtime).cast("string")), 256)
    return F.when(F.col(size) > HASHED_BYTES, large).otherwise(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def changed_files(files: DataFrame, states: DataFrame, full: bool = False) -> DataFrame:
    """Files (path, mtime, size, ...) that are new or whose time or size differs from the kept state; all of them if ``full``."""
    if full:
        return files
    kept = states.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_kept"))
    same = F.col("_kept") & F.col("_mtime").eqNullSafe(F.col("mtime")) & F.col("_size").eqNullSafe(F.col("size"))
    return files.join(kept, "path", "left").where(~F.coalesce(same, F.lit(False))).select(files.columns)


def removed_files(files: DataFrame, states: DataFrame) -> DataFrame:
    """Kept paths that the listing doesn't have."""
    return states.select("path").join(files.select("path"), "path", "left_anti")


def relations_of(rows: DataFrame) -> dict[str, DataFrame]:
    """Extracted rows as the index's tables."""
    return {
        "symbols": rows.where("relation = 'symbol'").select("file", "symbol", "kind", "lang", "qualified_name", "scope", "scope_depth", "line_start", "line_end", "signature", "return_type", "parameters", "decorators", "bases", "relation_targets", "attributes"),
        "references": rows.where("relation = 'reference'").select("file", F.col("file").alias("source_symbol"), F.col("target").alias("target_symbol"), F.col("edge_type").alias("relation"), F.col("line_start").alias("line"), F.when(F.col("lang") == "python", "semantic").otherwise("text").alias("source"), "confidence"),
        "dependencies": rows.where("relation = 'dependency'").select(F.col("file").alias("edge_from"), F.col("target").alias("edge_to"), "edge_type", F.lit(1.0).alias("weight")),
    }


def update(store: Store, files: DataFrame, full: bool = False, compact_every: int = COMPACT_EVERY, app: str | None = None, batch: int = 0) -> dict[str, Any]:
    """Brings the index up to a whole scan (path, mtime, size, lang, text; a path once); what was done.

    app, batch: a batch that was committed before is passed over. Texts of unchanged files aren't read beyond
    the scan. The result has counts only; the files are in the tables.
    """
    if app is not None and store.done(app, batch):
        return {"version": store.version(), "skipped": True, "changed": 0, "removed": 0, "compacted": False, "pending": store.pending()}
    spark = store.spark
    states = store.read("states")
    aside = f"data/aside-{uuid.uuid4().hex}"  # removed below; else by retire()
    changed = changed_files(files, states, full)
    changed.select("path", "mtime", "size", "lang", content_hash().alias("content_hash")).write.parquet(f"{store.root}/{aside}/states")
    new = spark.read.parquet(f"{store.root}/{aside}/states")
    n_changed = new.count()
    gone = removed_files(files, states)
    gone.write.parquet(f"{store.root}/{aside}/gone")
    gone = spark.read.schema("path string").parquet(f"{store.root}/{aside}/gone")
    n_gone = gone.count()
    if n_changed or n_gone or app is not None:
        changes = {"states": Change(rows=new, gone=gone)}
        if n_changed:
            extract.extract_files(changed).write.parquet(f"{store.root}/{aside}/rows")
            rows = spark.read.parquet(f"{store.root}/{aside}/rows")
        for name, key in (("symbols", "file"), ("references", "file"), ("dependencies", "edge_from")):
            keys, off = new.select(F.col("path").alias(key)), gone.select(F.col("path").alias(key))
            changes[name] = Change(rows=relations_of(rows)[name] if n_changed else None, keys=keys, gone=off)
        store.commit(changes, app, batch)
    store.files.remove(aside)
    compacted = store.compact(compact_every) is not None
    return {"version": store.version(), "skipped": False, "changed": n_changed, "removed": n_gone, "compacted": compacted, "pending": store.pending()}


def test_ownership(store: Store) -> DataFrame:
    """Which sources the index's test files own, as of its last version."""
    return symbols.ownership(store.read("states").select("path"), store.read("dependencies"))


def manifest(store: Store) -> DataFrame:
    """One row of counts: version, files, source_bytes, symbols, references, dependencies, pending (changes since the base)."""
    state = store.read("states").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes"))
    counts = [store.read(t).agg(F.count("*").alias(t)) for t in ("symbols", "references", "dependencies")]
    for c in counts:
        state = state.crossJoin(F.broadcast(c))  # one row each
    return state.select(F.lit(store.version()).alias("version"), "*", F.lit(max(store.pending().values())).alias("pending"))


def follow(scans: DataFrame, store: Store, name: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keeps the index up to a stream of scans (``SCAN``): a batch's latest scan is the whole listing at that time.

    Takes what is there and ends; started again with the same name and checkpoint it goes on behind it.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        last = rows.agg(F.max("scan")).first()[0]
        if last is not None:
            update(store, rows.where(F.col("scan") == last).drop("scan"), compact_every=compact_every, app=name, batch=batch)

    return scans.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
