"""Stateful streams against tables, with rows out of order, late rows and restarts."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from larkspur.streaming import state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """A folder of JSON files that a query reads, restarted for every batch."""

    def __init__(self, spark, tmp, schema, operator):
        self.spark, self.tmp, self.schema, self.operator, self.n = spark, tmp, schema, operator, 0
        (tmp / "in").mkdir()

    def batch(self, rows):
        """Add a file, start the query from its checkpoint, let it do what there is, stop it."""
        (self.tmp / "in" / f"{self.n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(f"file://{self.tmp}/in")
        query = self.operator(stream).writeStream.format("parquet").option("checkpointLocation", f"file://{self.tmp}/state").outputMode(
            "append").trigger(availableNow=True).start(f"file://{self.tmp}/out")
        assert query.awaitTermination(120)

    def rows(self):
        return self.spark.read.parquet(f"file://{self.tmp}/out").collect()


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat()


def test_cache_is_the_tables(spark, tmp_path):
    rng = random.Random(4)
    schema = "key long, ts timestamp, seq long, op string, value string, ttl_s double"
    ops = [{"key": rng.randrange(3), "ts": at(rng.randrange(0, 900)), "seq": i, "op": rng.choice(["set", "get", "get", "get", "delete"]), "value": f"v{i}", "ttl_s": rng.choice([None, 20.0, 90.0])} for i in range(160)]
    ops.sort(key=lambda r: r["ts"])
    # out of order by a minute at most, within the delay
    shuffled = [r for i in range(0, 160, 20) for r in rng.sample(ops[i : i + 20], 20)]
    feed = Feed(spark, tmp_path, schema, lambda s: state.ttl_cache(s, 60, "5 minutes"))
    for i in range(0, 160, 40):
        feed.batch(shuffled[i : i + 40])
    feed.batch([{"key": 9, "ts": at(5000), "seq": 900, "op": "get"}])  # moves the watermark on
    feed.batch([{"key": 0, "ts": at(10), "seq": 901, "op": "get"}, {"key": 9, "ts": at(9000), "seq": 902, "op": "get"}])
    feed.batch([{"key": 9, "ts": at(9900), "seq": 903, "op": "get"}])
    got = feed.rows()
    table = spark.createDataFrame([(r["key"], datetime.fromisoformat(r["ts"]), r["seq"], r["op"], r["value"], r["ttl_s"]) for r in ops], schema)
    want = {(r.key, r.at, r.seq): (r.kind, r.value) for r in state.cache_answers(table, 60).collect()}
    answers = {(r.key, r.at, r.seq): (r.kind, r.value) for r in got if r.kind in ("hit", "miss", "expired") and r.key < 9}
    plain = {}
    swept = 0
    for key in range(3):
        entry = None
        for r in sorted((r for r in ops if r["key"] == key), key=lambda r: (r["ts"], r["seq"])):
            t = int(datetime.fromisoformat(r["ts"]).timestamp() * 1000)
            if entry and t > entry[1] + 1:
                entry, swept = None, swept + 1
            if r["op"] == "set":
                entry = (r["value"], t + int((r["ttl_s"] or 60) * 1000))
            elif r["op"] == "delete":
                entry = None
            elif entry and t > entry[1]:
                plain[key, t, r["seq"]], entry = ("expired", None), None
            else:
                plain[key, t, r["seq"]] = ("hit", entry[0]) if entry else ("miss", None)
        swept += entry is not None
    assert answers == plain == want and sum(r.kind == "swept" for r in got) == swept
    assert [(r.key, r.seq) for r in got if r.kind == "late"] == [(0, 901)]


def test_expired_read_at_the_very_time(spark):
    table = spark.createDataFrame([(1, T0, 0, "set", "a", 1.0), (1, T0 + timedelta(seconds=1), 1, "get", None, None), (1, T0 + timedelta(seconds=1.001), 2, "get", None, None), (1, T0 + timedelta(seconds=1.001), 3, "get", None, None)],
        "key long, ts timestamp, seq long, op string, value string, ttl_s double")
    assert {r.seq: r.kind for r in state.cache_answers(table).collect()} == {1: "hit", 2: "expired", 3: "miss"}


def test_progress(spark, tmp_path):
    schema = "operation_id long, ts timestamp, seq long, event string, step string, progress double"
    e = lambda op, t, seq, event, step="", progress=None: {"operation_id": op, "ts": at(t), "seq": seq, "event": event, "step": step, "progress": progress}
    feed = Feed(spark, tmp_path, schema, lambda s: state.progress_stream(s, 600, "1 minute"))
    feed.batch([e(1, 20, 3, "progress", "load", 25.0), e(1, 0, 1, "start"), e(2, 5, 2, "progress", "", 10.0), e(3, 30, 4, "start"), e(3, 31, 5, "start")])
    feed.batch([e(1, 40, 6, "step", "save"), e(1, 50, 7, "step_done", "save"), e(1, 60, 8, "failed")])
    feed.batch([e(9, 3000, 9, "start")])
    feed.batch([e(1, 61, 10, "completed"), e(9, 3100, 11, "progress", "", 400.0)])
    feed.batch([e(9, 9000, 12, "completed")])
    feed.batch([e(9, 9999, 13, "start")])
    got = feed.rows()
    ms = int(T0.timestamp() * 1000)
    one = sorted((r.seq, r.status, r.progress, r.step, r.steps_done, r.eta and r.eta - ms) for r in got if r.operation_id == 1)
    assert one == [(1, "running", 0.0, "", 0, None), (3, "running", 25.0, "load", 0, 80_000), (6, "running", 25.0, "save", 0, 160_000), (7, "running", 25.0, "save", 1, 200_000), (8, "failed", 100.0, "save", 1, 60_000), (10, "late", None, "", None, None)]
    assert [(r.status, r.seq) for r in got if r.operation_id == 2] == [("unknown", 2)]
    assert sorted((r.status, r.at - ms) for r in got if r.operation_id == 3) == [("refused", 31_000), ("running", 30_000), ("stalled", 630_000)]
    assert [r.progress for r in got if r.operation_id == 9 and r.seq == 11] == [100.0] and [r.status for r in got if r.seq == 12] == ["completed"]


def test_late_rows_are_kept(spark, tmp_path):
    schema = "series string, ts timestamp, value double"
    feed = Feed(spark, tmp_path, schema, lambda s: state.windows_and_late(s, 60, "30 seconds"))
    rows = [("a", 10, 1.0), ("a", 70, 2.0), ("b", 15, None), ("a", 50, 5.0)]
    feed.batch([{"series": s, "ts": at(t), "value": v} for s, t, v in rows])
    feed.batch([{"series": "a", "ts": at(200), "value": 7.0}])
    feed.batch([{"series": "a", "ts": at(20), "value": 9.0}, {"series": "a", "ts": at(175), "value": 1.0}, {"series": "b", "ts": at(400), "value": 0.0}])
    feed.batch([{"series": "b", "ts": at(900), "value": 0.0}])
    feed.batch([{"series": "b", "ts": at(990), "value": 0.0}])
    ms = int(T0.timestamp() * 1000)
    got = sorted((r.kind, r.series, (r.start - ms) // 1000, r.n, r.total) for r in feed.rows())
    assert got == [("late", "a", 0, 1, 9.0), ("window", "a", 0, 2, 6.0), ("window", "a", 60, 1, 2.0), ("window", "a", 120, 1, 1.0), ("window", "a", 180, 1, 7.0), ("window", "b", 0, 1, 0.0), ("window", "b", 360, 1, 0.0), ("window", "b", 900, 1, 0.0)]
