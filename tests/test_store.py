"""Versioned keyed tables: merges, atomic switches, concurrent writers, crashes, pruning."""

import re
import threading

import pytest

from corvane.sources import store as st

SCHEMA = "k string, v long"


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, f"file://{tmp_path}/store", {"a": st.Table("k", SCHEMA, 4), "b": st.Table("k", SCHEMA, 4)})


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_set_and_delete_by_group(spark, store):
    assert found(store.read("a")) == [] and store.version() == 0
    store.upsert("a", rows(spark, ("x", 1), ("x", 2), ("y", 3), (None, 4)))
    store.upsert("a", rows(spark, ("x", 5)))
    assert found(store.read("a")) == [("x", 5), ("y", 3)]
    store.delete("a", rows(spark, ("y", 0), ("z", 0)))
    assert found(store.read("a")) == [("x", 5)] and found(store.read("a", version=1)) == [("x", 1), ("x", 2), ("y", 3)]
    # A set key without rows is an empty group; a key that is set and gone at once is set.
    store.commit({"a": st.Change(rows=rows(spark, ("w", 1)), keys=rows(spark, ("x", 0), ("w", 0)), gone=rows(spark, ("w", 0)))})
    assert found(store.read("a")) == [("w", 1)]


def test_compaction_clears_what_waits(spark, store):
    store.upsert("a", rows(spark, ("x", 1), ("y", 2)))
    store.delete("a", rows(spark, ("x", 0)))
    assert store.pending() == {"a": 3, "b": 0} and store.compact(every=4) is None
    assert store.compact(every=3) == 3 and store.pending() == {"a": 0, "b": 0}
    assert store.compact() is None and store.version() == 3
    assert found(store.read("a")) == [("y", 2)]
    store.upsert("a", rows(spark, ("y", 7)))
    assert found(store.read("a")) == [("y", 7)]


def test_changes_during_a_compaction_stay(spark, store, monkeypatch):
    store.upsert("a", rows(spark, ("x", 1)))
    create, once = store.files.create, []

    def late(name, text):  # another writer commits between the write and the switch
        if not once:
            once.append(1)
            st.Store(spark, store.root, store.tables).upsert("a", rows(spark, ("y", 2), ("x", 3)))
        return create(name, text)

    monkeypatch.setattr(store.files, "create", late)
    assert store.compact() == 3
    assert store.pending()["a"] == 2 and found(store.read("a")) == [("x", 3), ("y", 2)]


def test_crash_between_write_and_switch(spark, store, monkeypatch):
    store.upsert("a", rows(spark, ("x", 1)))
    monkeypatch.setattr(store.files, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    for act in (lambda: store.upsert("a", rows(spark, ("x", 2))), store.compact):
        with pytest.raises(OSError):
            act()
    again = st.Store(spark, store.root, store.tables)
    assert again.version() == 1 and found(again.read("a")) == [("x", 1)]
    assert len(again.retire(keep=1, grace_seconds=0)) == 2  # the two folders that no version names
    assert found(again.read("a")) == [("x", 1)]


def test_writers_at_once_lose_nothing(spark, store):
    def write(i):
        st.Store(spark, store.root, store.tables).upsert("a", rows(spark, (f"k{i}", i)))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found(store.read("a")) == [(f"k{i}", i) for i in range(6)] and store.version() == 6


def test_tables_change_together_and_batches_once(spark, store):
    change = {"a": st.Change(rows=rows(spark, ("x", 1))), "b": st.Change(rows=rows(spark, ("y", 1)))}
    assert store.commit(change, "app", 0) == 1 and store.commit(change, "app", 0) is None
    assert store.version() == 1 and store.done("app", 0) and not store.done("app", 1)
    assert store.commit({}, "app", 1) == 2  # an empty batch is remembered


def test_keys_prune_buckets(spark, store):
    store.upsert("a", spark.range(200).selectExpr("concat('k', id) AS k", "id AS v"))
    store.compact()
    store.upsert("a", rows(spark, ("k7", 70), ("k8", 80)))
    keys = rows(spark, ("k7", 0), ("k7", 0), ("none", 0), (None, 0))
    some = store.read("a", keys)
    assert found(some) == found(store.read("a").join(keys.select("k").distinct(), "k", "left_semi")) == [("k7", 70)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    wanted = {r[0] for r in keys.where("k IS NOT NULL").select(store.tables["a"].bucket()).collect()}
    assert len(wanted) < 4
    said = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S).group(1)
    assert all(str(b) in said for b in wanted) and "_bucket" in said


def test_retire_keeps_what_readers_see(spark, store):
    for i in range(4):
        store.upsert("a", rows(spark, ("x", i)))
    old = store.read("a", version=3)
    store.compact()
    assert store.retire(keep=3, grace_seconds=0) and found(old) == [("x", 2)]
    store.retire(keep=1, grace_seconds=0)
    assert found(store.read("a")) == [("x", 3)] and len(store.files.names("data")) == 1
