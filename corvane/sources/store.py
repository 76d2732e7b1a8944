"""Keyed tables in versions: groups of rows are set and deleted by key, readers see one whole version.

A store is a folder with ``data/`` (Parquet folders that are never changed once written) and ``commits/``
(one small file a version). A version names, for each of the store's tables, a base and the changes since.
Writers put rows aside first and then try to create the next version's file, which only one can; the
others read the new version and try again, so no writer's rows are lost. Readers of a version aren't
disturbed, and what a crashed writer left aside is never named by a version.

* A change keeps the rows of whole groups (``set``) or marks of gone keys (``delete``) under the version's
  number; readers merge base and changes, the last change of a key wins.
* ``compact`` writes a table's merged rows as a new base and drops the changes it holds; changes that came
  meanwhile stay.
* A base is partitioned by ``_bucket``, a hash of the key. Reading some keys prunes the other buckets.
* All tables change in one commit. A commit may carry a batch number, so a batch that is run again after
  a failure changes nothing.

Keys aren't null: rows without one are left out. The columns ``_op``, ``_seq`` and ``_bucket`` are the store's.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.state import merge_on_read

BUCKETS = 16
COMPACT_EVERY = 200


@dataclass(frozen=True)
class Table:
    """Key column, schema (DDL) and number of buckets of a table."""

    key: str
    schema: str
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Change:
    """Groups to set, by all their rows; keys that are set (those without rows become empty); and keys that go."""

    rows: DataFrame | None = None
    keys: DataFrame | None = None
    gone: DataFrame | None = None


class Files:
    """The few calls to the file system that commits need; any scheme that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.path(root)).toString()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age_ms(self, name: str, now: int) -> int:
        return now - self.fs.getFileStatus(self.path(f"{self.root}/{name}")).getModificationTime()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Creates the file with its whole text, unless it is there: then False."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        out = self.fs.create(self.path(aside), True)
        out.write(text.encode())
        out.close()
        to = f"{self.root}/{name}"
        self.fs.mkdirs(self.path(to).getParent())
        if urlparse(self.root).scheme == "file":  # a rename would replace the file
            source = urlparse(aside).path
            try:
                os.link(source, urlparse(to).path)
                return True
            except FileExistsError:
                return False
            finally:
                self.remove(aside.removeprefix(f"{self.root}/"))
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.gateway.new_array(options, 1)
        none[0] = options.valueOf("NONE")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(to).toUri(), self.conf).rename(self.path(aside), self.path(to), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self.remove(aside.removeprefix(f"{self.root}/"))
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


class Store:
    """Versioned keyed tables in a folder; see the module."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.tables, self.files = spark, tables, Files(spark, root)
        self.root = self.files.root

    # versions

    def state(self, version: int | None = None) -> dict:
        """What a version names; the last one unless given. Version 0 is empty."""
        names = self.files.names("commits")
        if version is None:
            version = int(names[-1].split(".")[0]) if names else 0
        if not version:
            return {"version": 0, "tables": {t: {"base": None, "changes": []} for t in self.tables}, "batches": {}}
        return json.loads(self.files.read(f"commits/{version:020d}.json"))

    def version(self) -> int:
        return self.state()["version"]

    def done(self, app: str, batch: int) -> bool:
        """Whether the batch of an application, or a later one, has been committed."""
        return self.state()["batches"].get(app, -1) >= batch

    def pending(self, version: int | None = None) -> dict[str, int]:
        """Changes of keys since the base, by table."""
        return {t: sum(c["keys"] for c in x["changes"]) for t, x in self.state(version)["tables"].items()}

    def _switch(self, edit: Callable[[dict], dict | None]) -> int | None:
        while True:
            state = self.state()
            new = edit(json.loads(json.dumps(state)))
            if new is None:
                return None
            new["version"] = state["version"] + 1
            if self.files.create(f"commits/{new['version']:020d}.json", json.dumps(new)):
                return new["version"]

    # reading

    def _full(self, table: str) -> T.StructType:
        return self.spark.createDataFrame([], self.tables[table].schema).schema

    def read(self, table: str, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """A table's rows in a version; with ``keys`` (a frame with the key column) those keys' rows only, from their buckets only."""
        return self._merged(table, self.state(version), keys)

    def _merged(self, table: str, state: dict, keys: DataFrame | None = None) -> DataFrame:
        t, found = self.tables[table], state["tables"][table]
        schema = self._full(table)
        columns = [f.name for f in schema]
        stored = T.StructType([*schema, T.StructField("_bucket", T.IntegerType())])
        wanted = None
        if keys is not None:
            keys = keys.select(t.key).where(F.col(t.key).isNotNull()).distinct()
            wanted = [r[0] for r in keys.select(t.bucket()).distinct().collect()]  # as many as buckets at most
        in_buckets = F.lit(True) if wanted is None else F.col("_bucket").isin(wanted)
        base = self.spark.read.schema(stored).parquet(f"{self.root}/{found['base']}").where(in_buckets) if found["base"] else self.spark.createDataFrame([], stored)
        rows = base.select(columns)
        if found["changes"]:
            marked = T.StructType([*stored, T.StructField("_op", T.StringType())])
            parts = [self.spark.read.schema(marked).parquet(f"{self.root}/{c['path']}").where(in_buckets).withColumn("_seq", F.lit(c["version"])) for c in found["changes"]]
            ops = parts[0]
            for p in parts[1:]:
                ops = ops.union(p)
            rows = merge_on_read(rows, ops, t.key, "_seq", "_op")
        return rows if keys is None else rows.join(keys, t.key, "left_semi").select(columns)

    # writing

    def _aside(self, table: str, change: Change) -> dict | None:
        """Writes a change's rows and marks; what a version says of them."""
        t = self.tables[table]
        schema = self._full(table)
        columns = [f.name for f in schema]
        marks = []
        if change.rows is not None:
            marks.append(change.rows.select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit("set").alias("_op")))
        without = [d.select(F.col(t.key)) for d in (change.keys, change.gone) if d is not None]
        if without:
            every = without[0].union(without[1]) if len(without) == 2 else without[0]
            if change.rows is not None:
                every = every.join(change.rows.select(t.key), t.key, "left_anti")
            marks.append(every.distinct().select(*[(F.col(c) if c == t.key else F.lit(None)).cast(schema[c].dataType).alias(c) for c in columns], F.lit("delete").alias("_op")))
        if not marks:
            return None
        out = marks[0].union(marks[1]) if len(marks) == 2 else marks[0]
        path = f"data/{table}-{uuid.uuid4().hex}"
        out.where(F.col(t.key).isNotNull()).select(*columns, t.bucket().alias("_bucket"), "_op").write.parquet(f"{self.root}/{path}")
        keys = self.spark.read.schema(schema).parquet(f"{self.root}/{path}").select(F.count_distinct(t.key)).first()[0]
        return {"path": path, "keys": keys} if keys else None

    def commit(self, changes: dict[str, Change], app: str | None = None, batch: int = 0) -> int | None:
        """Applies changes to tables in one version; its number, or None if the batch was committed before or nothing changes."""
        if app is not None and self.done(app, batch):
            return None
        made = {t: found for t, c in changes.items() if (found := self._aside(t, c))}
        if not made and app is None:
            return None

        def add(state: dict) -> dict | None:
            if app is not None:
                if state["batches"].get(app, -1) >= batch:
                    return None
                state["batches"][app] = batch
            for t, found in made.items():
                state["tables"][t]["changes"].append(found | {"version": state["version"] + 1})
            return state

        return self._switch(add)

    def upsert(self, table: str, rows: DataFrame) -> int | None:
        return self.commit({table: Change(rows=rows)})

    def delete(self, table: str, keys: DataFrame) -> int | None:
        return self.commit({table: Change(gone=keys)})

    def compact(self, every: int = 1) -> int | None:
        """Writes new bases of all tables if one of them has ``every`` or more changed keys; the version, or None."""
        state = self.state()
        if max(self.pending(state["version"]).values(), default=0) < max(1, every):
            return None
        bases = {}
        for name, t in self.tables.items():
            if state["tables"][name]["changes"]:
                bases[name] = f"data/{name}-{uuid.uuid4().hex}"
                rows = self._merged(name, state).withColumn("_bucket", t.bucket())
                rows.repartition(t.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{bases[name]}")

        def swap(now: dict) -> dict | None:
            for name, base in bases.items():
                if now["tables"][name]["base"] != state["tables"][name]["base"]:
                    return None  # another one has compacted; the rows are the same
                now["tables"][name] = {"base": base, "changes": [c for c in now["tables"][name]["changes"] if c["version"] > state["version"]]}
            return now

        return self._switch(swap)

    def retire(self, keep: int = 2, grace_seconds: int = 3600) -> list[str]:
        """Deletes data that the last ``keep`` versions don't name and that is older than the grace (for writers still at work), and earlier versions' files; what was deleted."""
        last = self.version()
        named, gone = set(), []
        for v in range(max(1, last - keep + 1), last + 1):
            for x in self.state(v)["tables"].values():
                named |= {x["base"], *(c["path"] for c in x["changes"])}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for name in self.files.names("data"):
            if f"data/{name}" not in named and self.files.age_ms(f"data/{name}", now) >= grace_seconds * 1000:
                gone.append(f"data/{name}")
        gone += [f"commits/{n}" for n in self.files.names("commits") if int(n.split(".")[0]) <= last - keep]
        for name in gone:
            self.files.remove(name)
        return gone
