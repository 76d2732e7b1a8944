"""File scans, JSON Lines relations and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.state import merge_on_read, needs_compaction

# Folders that content search leaves out.
EXCLUDED_DIRS = [".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache"]
# Languages by file ending.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".go": "go", ".rs": "rust"}


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression; ``*`` and ``?`` also match a slash."""
    out = "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "/_-" else f"\\{c}") for c in pattern)
    return f"^(?:{out})$"


def matches_any(path: str | Column, globs: list[str]) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    hit = F.lit(False)
    for g in globs:
        hit = hit | p.rlike(glob_regex(g))
    return hit


def language(path: str | Column) -> Column:
    """Language of a path by its ending; null if it isn't known."""
    ending = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ending]


def normalized_path(path: str | Column) -> Column:
    """Slashes forward, blanks trimmed, one leading ``./`` taken off."""
    return F.regexp_replace(F.trim(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))), r"^\./", "")


def scan_files(spark: SparkSession, root: str, include: list[str] = ("*",), exclude: list[str] = (), max_mb: float = 2.0, max_files: int | None = None, known_only: bool = True) -> DataFrame:
    """Source files under root: path (relative), size, modified, lang, content_hash, text; in order of path.

    Name, size and language are checked on the scan's metadata, before any content is decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = raw.withColumn("path", F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/").split("/")[-1]) + "/", ""))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    keep = matches_any("path", list(include)) & ~matches_any("path", list(exclude)) & (F.col("length") <= int(max_mb * (1 << 20))) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED_DIRS]))
    if known_only:
        keep = keep & language("path").isNotNull()
    out = files.where(keep).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), language("path").alias("lang"), F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    out = out.orderBy("path")
    return out.limit(max_files) if max_files else out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file or folder; blank and malformed lines and other values than objects are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).na.drop("all")


def count_lines(spark: SparkSession, path: str) -> int:
    """Physical lines, malformed ones too."""
    return spark.read.text(path).count()


def write_table(df: DataFrame, path: str) -> None:
    """Replaces a table; readers see the old or the new one, by the committer."""
    df.write.mode("overwrite").parquet(path)


def append_ops(df: DataFrame, path: str) -> None:
    """Appends delta operations (the relation's columns, ``op`` and ``seq``)."""
    df.write.mode("append").parquet(path)


def read_relation(spark: SparkSession, base: str, ops: str | None, key: str) -> DataFrame:
    """A relation as of its last operation, in order of key."""
    rows = spark.read.parquet(base)
    return (merge_on_read(rows, spark.read.parquet(ops), key, "seq") if ops else rows).orderBy(key)


def compact(spark: SparkSession, base: str, ops: str, key: str, every: int = 200) -> str | None:
    """Writes a new base beside the old one once enough operations wait; returns its path, or None."""
    if not needs_compaction(spark.read.parquet(ops).select(key, "seq").distinct().count(), every):
        return None
    path = f"{base.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    write_table(merge_on_read(spark.read.parquet(base), spark.read.parquet(ops), key, "seq"), path)
    return path


def write_documents(df: DataFrame, path: str) -> None:
    """Each row as one JSON document, a line each."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
