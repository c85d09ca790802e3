"""Snapshots of collections: several writers, a writer that stops, earlier versions."""

import threading

import pytest
from pyspark.sql import functions as F

from larkspur.operators import index
from larkspur.snapshots import Conflict, SnapshotLog

ROWS = "id string, text string, metadata map<string,string>, embedding array<double>"


def some(spark, ids, text):
    return spark.createDataFrame([(i, text, {"k": "v"}, [1.0, 0.0]) for i in ids], ROWS)


def held(c, name, version=None):
    return {r["id"]: r["text"] for r in c.get(name, version).collect()}


def test_log(spark, tmp_path):
    log = SnapshotLog(spark, f"file://{tmp_path}/log")
    assert log.versions() == [] and log.latest() is None
    log.commit(0, {"a": 1})
    log.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        log.commit(1, {"a": 3})
    assert log.versions() == [0, 1] and log.read(1) == {"a": "é"}
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")) == [f"{v:020d}.json" for v in (0, 1)]


def test_two_writers_lose_no_row(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    index.Collections(spark, root, buckets=4).create("c")
    errors = []

    def write(who):
        try:
            for i in range(3):
                index.Collections(spark, root).upsert("c", some(spark, [f"{who}-{i}-{j}" for j in range(10)] + ["both"], who))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in writers]
    [t.join() for t in writers]
    c = index.Collections(spark, root)
    got = held(c, "c")
    assert not errors and len(got) == 61 and got["both"] in "ab"
    assert c.history("c") == [(0, "create"), *[(i, "upsert") for i in range(1, 7)]]


def test_a_rival_between_write_and_commit(spark, tmp_path, monkeypatch):
    """Another writer commits after this one has written its files: where both touched a bucket it merges again, else it takes the other's bucket over."""
    root = f"file://{tmp_path}/store"
    a, b = index.Collections(spark, root, buckets=1), index.Collections(spark, root)
    a.upsert("c", some(spark, ["x"], "first"))
    commit, did = SnapshotLog.commit, []

    def slow(self, version, content):
        if not did:
            did.append(1)
            b.upsert("c", some(spark, ["y"], "rival"))
        commit(self, version, content)

    monkeypatch.setattr(SnapshotLog, "commit", slow)
    a.upsert("c", some(spark, ["z"], "late"))
    assert held(a, "c") == {"x": "first", "y": "rival", "z": "late"} and len(a.history("c")) == 4


def test_a_stopped_writer_changes_nothing(spark, tmp_path, monkeypatch):
    c = index.Collections(spark, f"file://{tmp_path}/store", buckets=4)
    c.upsert("c", some(spark, ["a", "b"], "old"))
    commit = SnapshotLog.commit

    def stop(self, version, content):
        raise KeyboardInterrupt

    monkeypatch.setattr(SnapshotLog, "commit", stop)
    with pytest.raises(KeyboardInterrupt):
        c.upsert("c", some(spark, ["b", "d"], "new"))
    monkeypatch.setattr(SnapshotLog, "commit", commit)
    assert held(c, "c") == {"a": "old", "b": "old"}
    assert c.vacuum("c") > 0 and held(c, "c") == {"a": "old", "b": "old"}
    assert c.upsert("c", some(spark, ["b", "d"], "new")) == 2 and held(c, "c") == {"a": "old", "b": "new", "d": "new"}


def test_versions_and_removal(spark, tmp_path):
    c = index.Collections(spark, f"file://{tmp_path}/store", buckets=8)
    c.upsert("c", some(spark, ["a", "b", "c"], "one"))
    c.upsert("c", some(spark, ["b"], "two"))
    c.remove_ids("c", spark.createDataFrame([("a",), ("unknown",), (None,)], "id string"))
    assert held(c, "c") == {"b": "two", "c": "one"} and held(c, "c", 1) == dict.fromkeys("abc", "one") and held(c, "c", 0) == {}
    assert [o for _, o in c.history("c")] == ["create", "upsert", "upsert", "remove"]
    assert c.upsert("c", some(spark, [], "none")) == 0 and len(c.history("c")) == 4
    reader = c.get("c")
    c.vacuum("c")
    assert {r["id"] for r in reader.collect()} == {"b", "c"} and c.upsert("c", some(spark, ["b"], "x").withColumn("extra", F.lit(1))) == 1
    # a writer with another number of buckets uses the collection's own
    assert index.Collections(spark, f"file://{tmp_path}/store", buckets=99).upsert("c", some(spark, ["c"], "y")) == 1 and held(c, "c") == {"b": "x", "c": "y"}
