"""Source files of a folder by a Python data source: folders are listed by tasks, contents are read last.

``corvane_files`` lists files (path, size, mtime, lang) under a folder. Its splits are subtrees, found by
listing folders breadth first until there are enough of them. Excluded folders aren't opened. Filters on
``path``, ``size`` and ``lang`` reach the listing. ``with_text`` then opens the files that are left, each
one in the task that has its row, so nothing is read of a file that any rule or join has dropped.

Any file system that pyarrow reaches by its URI will do; a plain path must be one that all machines see.
Folders' links are followed by none of this. An empty or missing folder gives no rows.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from corvane.sources.files import EXCLUDED_DIRS, LANGUAGES

LISTING = "path string, size long, mtime long, lang string"
SPLITS = 64
# Ways to choose files; ``auto`` falls back to all files if the patterns choose none.
MODES = ("auto", "configured", "git", "all")


@dataclass
class Subtree(InputPartition):
    """Folders to list with all below them, and files found on the way to them."""

    folders: list[str]
    files: list[tuple]


def _fs(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class FileReader(DataSourceReader):
    """Lists the files under a root that fit the rules."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.include, self.exclude = json.loads(options.get("include", "[]")), json.loads(options.get("exclude", "[]"))
        self.dirs = set(json.loads(options.get("excludeDirs", json.dumps(EXCLUDED_DIRS))))
        self.most = int(options.get("maxBytes", 1 << 62))
        self.languages = json.loads(options.get("languages", json.dumps(LANGUAGES)))
        self.splits = int(options.get("splits", SPLITS))
        self.prefix, self.paths, self.wanted = "", None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("path",):
                if isinstance(f, StringStartsWith):
                    self.prefix = max(self.prefix, f.value, key=len)
                else:
                    given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.paths = given if self.paths is None else self.paths & given
            elif isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("size",):
                self.most = min(self.most, f.value)
            elif isinstance(f, EqualTo | In) and f.attribute == ("lang",):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = given if self.wanted is None else self.wanted & given
            yield f  # Spark checks all of them again

    def _below(self, rel: str) -> bool:
        """Whether anything wanted may lie in a folder."""
        at = f"{rel}/"
        if self.paths is not None and not any(p.startswith(at) for p in self.paths):
            return False
        return at.startswith(self.prefix) or self.prefix.startswith(at)

    def _kept(self, rel: str, size: int) -> str | None:
        """The file's language if it is wanted."""
        name = rel.rsplit("/", 1)[-1]
        lang = self.languages.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name else None
        if lang is None or size > self.most or not rel.startswith(self.prefix) or (self.paths is not None and rel not in self.paths) or (self.wanted is not None and lang not in self.wanted):
            return None
        if self.include and not any(fnmatch.fnmatch(rel, g) for g in self.include) or any(fnmatch.fnmatch(rel, g) for g in self.exclude):
            return None
        return lang

    def _list(self, fs: Any, base: str, rel: str) -> tuple[list[str], list[tuple]]:
        """Folders in a folder that may have something, and its files that fit."""
        from pyarrow import fs as pafs

        folders, files = [], []
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/{rel}".rstrip("/"), allow_not_found=True)):
            path = f"{rel}/{info.base_name}".lstrip("/")
            if info.type == pafs.FileType.Directory:
                if info.base_name not in self.dirs and self._below(path) and not self._is_link(fs, info.path):
                    folders.append(path)
            elif info.type == pafs.FileType.File and (lang := self._kept(path, info.size)):
                files.append((path, info.size, int(info.mtime_ns or 0), lang))
        return sorted(folders), files

    @staticmethod
    def _is_link(fs: Any, path: str) -> bool:
        import os

        return type(fs).__name__ == "LocalFileSystem" and os.path.islink(path)

    def partitions(self) -> list[InputPartition]:
        fs, base = _fs(self.root)
        level, files = [""], []
        while level and len(level) < self.splits:
            deeper = []
            for rel in level:
                more, found = self._list(fs, base, rel)
                deeper += more
                files += found
            level = deeper
        n = max(1, min(self.splits, len(level)))
        return [Subtree(level[i::n], files if i == 0 else []) for i in range(n)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        yield from partition.files
        fs, base = _fs(self.root)
        todo = list(partition.folders)
        while todo:
            more, found = self._list(fs, base, todo.pop())
            todo += more
            yield from found


class FileScan(DataSource):
    """Options: path, include and exclude (JSON lists of globs), excludeDirs, languages (JSON), maxBytes, splits."""

    @classmethod
    def name(cls) -> str:
        return "corvane_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: Any) -> FileReader:
        return FileReader(self.options)


def list_files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_mb: float = 2.0, mode: str = "auto", candidates: DataFrame | None = None, languages: dict[str, str] | None = None, most: int | None = None, splits: int = SPLITS) -> DataFrame:
    """Source files under a root: path (relative), size, mtime (nanoseconds), lang.

    mode: ``configured`` takes what the patterns choose; ``auto`` takes all source files if they choose none;
    ``all`` ignores include; ``git`` takes only the paths of ``candidates`` (path), nothing without them.
    ``most`` keeps the first so many paths in order; only their rows are sorted, no content.
    """
    if mode not in MODES:
        mode = "auto"
    spark.dataSource.register(FileScan)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"exclude": json.dumps(list(exclude)), "maxBytes": str(int(max_mb * (1 << 20))), "splits": str(splits)}
    if languages is not None:
        options["languages"] = json.dumps(languages)

    def scan(globs: list[str]) -> DataFrame:
        out = spark.read.format("corvane_files").options(**options, include=json.dumps(globs)).load(root)
        if mode == "git" or (mode == "auto" and candidates is not None):
            named = candidates.select("path").distinct() if candidates is not None else spark.createDataFrame([], "path string")
            out = out.join(named, "path", "left_semi")
        return out

    globs = [] if mode == "all" else [g for g in include if g.strip()]
    out = scan(globs)
    if mode == "auto" and globs and not out.limit(1).count():
        out = scan([])
    return out.orderBy("path").limit(most) if most else out


def with_text(listing: DataFrame, root: str) -> DataFrame:
    """listing with ``text``: each file's content as UTF-8, what isn't replaced; null if it is gone by now."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root.rstrip("/"))
        for b in batches:
            for k in range(b.num_rows):
                try:
                    with fs.open_input_stream(f"{base}/{b.column('path')[k].as_py()}") as f:
                        text = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    text = None
                yield b.slice(k, 1).append_column("text", pa.array([text], pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInArrow(of, f"{schema}, text string")


def write_files(rows: DataFrame, root: str, mode: str = "overwrite") -> DataFrame:
    """Writes each row's ``text`` to its ``path`` below root: path, size, status, once the result is read.

    mode: ``overwrite``, ``skip`` (a file that is there stays: status ``kept``) or ``error`` (it fails). A file is written aside
    and moved, so readers see all of it or none; a task that runs again writes the same files. A path must be relative,
    without ``..``; null texts are written as empty files.
    """
    if mode not in ("overwrite", "skip", "error"):
        raise ValueError("mode must be overwrite, skip or error")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pafs

        fs, base = _fs(root.rstrip("/"))
        for b in batches:
            sizes, said = [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path below the root: {path}")
                to, data = f"{base}/{path}", (text or "").encode("utf-8", "surrogatepass")
                found = fs.get_file_info(to)
                if found.type != pafs.FileType.NotFound and mode != "overwrite":
                    if mode == "error":
                        raise FileExistsError(to)
                    sizes.append(found.size)
                    said.append("kept")
                    continue
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                aside = f"{to}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(aside) as f:
                    f.write(data)
                fs.move(aside, to)
                sizes.append(len(data))
                said.append("written")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(sizes, pa.int64()), pa.array(said, pa.string())], names=["path", "size", "status"])

    return rows.select("path", "text").mapInArrow(of, "path string, size long, status string")
