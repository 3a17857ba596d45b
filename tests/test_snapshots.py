"""Loads of several tables as one snapshot: whole or not at all, in touched buckets only, with references held."""

import json
import os

import pytest

from ledgerlark.operators import snapshots
from ledgerlark.operators.snapshots import Change, Store
from ledgerlark.sources import files
from ledgerlark.streaming import inbox
from tests.test_documents import DOC


@pytest.fixture
def docs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    return files.canonical(spark, str(tmp_path / "in"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def read(store, name, schema, version=None):
    return sorted(map(tuple, store.table(name, schema, version).collect()), key=repr)


def test_merge_and_old_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    first = rows(spark, (1, "a"), (2, "b"), (None, "n"))
    kind = first.schema
    assert read(store, "t", kind) == []
    assert store.load({"t": Change(first, ["k"], True)}) == 1
    assert store.load({"t": Change(rows(spark, (2, None), (3, "c"), (None, "m")), ["k"], True), "u": Change(rows(spark, (1, "x")), ["k"], False)}) == 2
    assert store.load({"u": Change(rows(spark, (1, "y"), (5, "z")), ["k"], False)}) == 3
    assert read(store, "t", kind) == sorted([(1, "a"), (2, None), (3, "c"), (None, "m")], key=repr)
    assert read(store, "u", kind) == [(1, "x"), (5, "z")]
    assert read(store, "t", kind, 1) == sorted([(1, "a"), (2, "b"), (None, "n")], key=repr) and read(store, "u", kind, 1) == []
    store.expire(keep=1)
    assert store.versions() == [3] and len(read(store, "t", kind)) == 4 and len(read(store, "u", kind)) == 2
    with pytest.raises(ValueError, match="keys"):
        store.load({"t": Change(first, ["v"], True)})


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root = tmp_path / "s"
    store = Store(spark, str(root), buckets=16)
    big = spark.range(20_000).selectExpr("id AS k", "string(id) AS v")
    store.load({"t": Change(big, ["k"], True)})
    before = {p: os.stat(p).st_mtime_ns for p in map(str, root.glob("data/**/*.parquet"))}
    store.load({"t": Change(rows(spark, (7, "new")), ["k"], True)})
    after = {p: os.stat(p).st_mtime_ns for p in map(str, root.glob("data/**/*.parquet"))}
    assert before.items() <= after.items() and len({os.path.dirname(p) for p in after.keys() - before.keys()}) == 1
    assert store.table("t", big.schema).count() == 20_000 and store.table("t", big.schema).filter("k = 7").first().v == "new"
    again = store.table("t", big.schema)
    store.load({"t": Change(rows(spark, (7, "new")), ["k"], True)})
    assert store.table("t", big.schema).exceptAll(again).count() == 0


@pytest.mark.parametrize("step", [0, 4, 8, 9, 10])
def test_a_load_that_breaks_off_shows_nothing(spark, tmp_path, docs, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    inbox.loaded_together(docs.limit(0), store)
    kinds = {name: change.rows.schema for name, change in inbox.changes_of(docs).items()}
    calls, merged, commit = [0], Store._merged, Store._commit

    def merging(self, *args):
        if calls[0] == step:
            raise OSError("lost")
        calls[0] += 1
        return merged(self, *args)

    def committing(self, *args):
        if step == 9:
            raise OSError("lost")
        return commit(self, *args)

    monkeypatch.setattr(Store, "_merged", merging)
    monkeypatch.setattr(Store, "_commit", committing)
    if step < 10:
        with pytest.raises(OSError):
            inbox.loaded_together(docs, store)
        assert all(read(store, name, kind) == [] for name, kind in kinds.items()) and store.versions() == [1]
    else:
        inbox.loaded_together(docs, store)
        assert all(read(store, name, kind) for name, kind in kinds.items())


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path / "s"), buckets=2) for _ in range(2))
    merged = one._merged
    monkeypatch.setattr(one, "_merged", lambda *a: (two.load({"t": Change(rows(spark, (9, "other")), ["k"], True)}), merged(*a))[1])
    with pytest.raises(snapshots.Conflict):
        one.load({"t": Change(rows(spark, (1, "a")), ["k"], True)})
    assert read(two, "t", rows(spark, (1, "a")).schema) == [(9, "other")]


def test_references(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    parents = Change(rows(spark, (1, "a"), (2, "b")), ["k"], True)
    child = lambda *ks: Change(spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "id long, parent long"), ["id"], True, [(["parent"], "p")])
    with pytest.raises(snapshots.Broken, match="not there"):
        store.load({"c": child(1)})
    store.load({"p": parents, "c": child(1, 2, None)})
    with pytest.raises(snapshots.Broken, match="lacks"):
        store.load({"c": child(1, 3)})
    assert store.load({"c": child(2), "p": Change(rows(spark, (3, "c")), ["k"], True)}) == 2
    assert store.load({"c": child(3)}) == 3


def test_inbox_fills_the_store(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    inbox.watched_together(store, str(tmp_path / "in"), str(tmp_path / "at")).awaitTermination()
    assert store.versions() == [1] and store.table("series", inbox.changes_of(docs)["series"].rows.schema).count() == 1
