"""Stateful stream operators: a cache with expiry, progress of operations, and windows that keep late rows.

All work in event time. A key's rows wait in its state until the watermark has passed them and are then
handled in their order, so what arrives out of order within the watermark's delay gives the same result as a
sorted table; timers hand them over. Late rows, which the watermark has passed before they came,
are given out with kind ``late`` instead of being dropped. State is on checkpointed storage, so a
restarted query goes on where it stopped. A stream needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and several states of a key need, for queries that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


class InOrder(StatefulProcessor):
    """Rows with ``at`` (ms) and ``seq`` wait until the watermark passes ``at``; ``handle`` then gets them in order."""

    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle_ = handle
        self.waiting = handle.getMapState("waiting", "at long, seq long", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            values = row.asDict()
            at, seq = values["at"], values["seq"]
            if at <= mark:
                yield self.late(key, values)
                continue
            self.waiting.updateValue((at, seq), tuple(values[f.split()[0]] for f in self.fields.split(", ")))
            self.handle_.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        names = [f.split()[0] for f in self.fields.split(", ")]
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] == at)
        for (t, seq), values in due:
            self.waiting.removeKey((t, seq))
            yield from self.handle(key, t, seq, dict(zip(names, values)))
        yield from self.timer(key, at)

    def handle(self, key, at: int, seq: int, values: dict) -> Iterator[Row]:
        raise NotImplementedError

    def timer(self, key, at: int) -> Iterator[Row]:
        return iter(())

    def late(self, key, values: dict) -> Row:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Cache(InOrder):
    """set, get and delete of a key's entry; an entry is gone once the time is after its expiry."""

    fields = "op string, value string, ttl long"

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle):
        super().init(handle)
        self.entry = handle.getValueState("entry", "value string, expires long")

    def handle(self, key, at, seq, values):
        yield from self.timer(key, at - 1)  # a sweep that was due before, if the watermark has jumped over it
        there = self.entry.get() if self.entry.exists() else None
        if values["op"] == "set":
            expires = at + (values["ttl"] or self.ttl)
            self.entry.update((values["value"], expires))
            self.handle_.registerTimer(expires + 1)
        elif values["op"] == "delete":
            yield self.row(key, at, seq, "deleted" if there else "absent", None)
            self.entry.clear()
        elif there is None:
            yield self.row(key, at, seq, "miss", None)
        elif at > there[1]:
            self.entry.clear()  # a lazy delete
            yield self.row(key, at, seq, "expired", None)
        else:
            yield self.row(key, at, seq, "hit", there[0])

    def timer(self, key, at):
        if self.entry.exists() and (over := self.entry.get()[1] + 1) <= at:
            self.entry.clear()
            yield self.row(key, over, None, "swept", None)

    def late(self, key, values):
        return self.row(key, values["at"], values["seq"], "late", None)

    @staticmethod
    def row(key, at, seq, kind, value):
        return Row(key=key[0], at=at, seq=seq, kind=kind, value=value)


def ttl_cache(operations: DataFrame, ttl_s: float = 300.0, delay: str = "10 minutes") -> DataFrame:
    """key, at (ms), seq, kind and value of what a cache answers to (key, ts, seq, op, value, ttl_s), on a stream.

    op is set, get or delete; a set without a ttl, or with 0, has ``ttl_s``. A get is a ``hit`` with the value, a ``miss``, or
    ``expired``, which deletes the entry; a delete is ``deleted`` or ``absent``. An entry that nobody reads is ``swept`` one millisecond after its
    expiry, so that counting these rows gives the sweeps; a get of that very time still finds it
    expired. Times count in whole ms, rows of one time in the order of seq, which tells a key's rows of one time apart.
    """
    rows = operations.withWatermark("ts", delay).select("key", millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "op",
        F.col("value").cast("string").alias("value"), (F.col("ttl_s") * 1000).cast("long").alias("ttl"))
    return rows.groupBy("key").transformWithState(Cache(int(ttl_s * 1000)), "key long, at long, seq long, kind string, value string", "Append", "EventTime")


def cache_answers(operations: DataFrame, ttl_s: float = 300.0) -> DataFrame:
    """The hits, misses and expired reads of ``ttl_cache`` from a table: each get meets the last set or delete before it."""
    from pyspark.sql.window import Window

    at, seq = millis("ts"), F.col("seq").cast("long")
    rows = operations.withColumns({"at": at, "seq": seq})
    before = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ttl = F.when(F.coalesce("ttl_s", F.lit(0)) > 0, (F.col("ttl_s") * 1000).cast("long")).otherwise(F.lit(int(ttl_s * 1000)))
    change = F.when(F.col("op") == "set", F.struct(F.col("value").cast("string").alias("value"), (F.col("at") + ttl).alias("expires"))).when(F.col(
            "op") == "delete", F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("expires")))
    seen = rows.withColumn("held", F.last(change, ignorenulls=True).over(before)).where("op = 'get'")
    over = F.col("at") > F.col("held.expires")
    # an entry that a get or the sweep has found expired is gone for the later ones
    again = F.max(F.when(over, F.col("held.expires"))).over(before)
    swept = over & (F.coalesce(again, F.lit(-1)) == F.col("held.expires")) | (F.col("at") > F.col("held.expires") + 1)
    kind = F.when(F.col("held.expires").isNull() | swept, "miss").when(over, "expired").otherwise("hit")
    return seen.select("key", "at", "seq", kind.alias("kind"), F.when(kind == "hit", F.col("held.value")).alias("value"))


class Progress(InOrder):
    """The state of an operation: running, then completed, failed or cancelled; stalled if it is silent for too long."""

    fields = "event string, step string, progress double"

    def __init__(self, silent_ms: int):
        self.silent = silent_ms

    def init(self, handle):
        super().init(handle)
        self.now = handle.getValueState("now", "began long, last long, progress double, step string, steps int")

    def handle(self, key, at, seq, values):
        there, event = self.now.get() if self.now.exists() else None, values["event"]
        if event == "start":
            if there is None:
                yield from self.keep(key, at, seq, "running", (at, at, 0.0, "", 0))
            else:
                yield self.row(key, at, seq, "refused", there)  # it is being tracked already
        elif there is None:
            yield self.row(key, at, seq, "unknown", (at, at, 0.0, "", 0))
        else:
            began, _, progress, step, steps = there
            if event in ("completed", "failed", "cancelled"):
                self.now.clear()
                yield self.row(key, at, seq, event, (began, at, 100.0, step, steps))  # whatever the end, progress is 100
            elif event == "step_done":
                yield from self.keep(key, at, seq, "running", (began, at, progress, step, steps + (values["step"] == step)))
            elif event == "step":
                yield from self.keep(key, at, seq, "running", (began, at, progress, values["step"], steps))
            else:
                progress = min(max(values["progress"] or 0.0, 0.0), 100.0)
                yield from self.keep(key, at, seq, "running", (began, at, progress, values["step"] or step, steps))

    def keep(self, key, at, seq, status, state):
        self.now.update(state)
        self.handle_.registerTimer(at + self.silent)
        yield self.row(key, at, seq, status, state)

    def timer(self, key, at):
        if self.now.exists() and self.now.get()[1] + self.silent == at:
            yield self.row(key, at, None, "stalled", self.now.get())

    def late(self, key, values):
        return self.row(key, values["at"], values["seq"], "late", (None, values["at"], None, values["step"], None))

    @staticmethod
    def row(key, at, seq, status, state):
        began, last, progress, step, steps = state
        eta = int(began + (last - began) * 100.0 / progress) if progress and began is not None else None
        return Row(operation_id=key[0], at=at, seq=seq, status=status, began=began, progress=progress, step=step, steps_done=steps, eta=eta)


def progress_stream(events: DataFrame, silent_s: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """The states that operations pass through, from (operation_id, ts, seq, event, step, progress), on a stream.

    event is start, progress (0 to 100, cut to that), step, step_done, completed, failed or cancelled. A row comes out for each
    event: ``running``, the end, ``refused`` (start of a tracked operation) or ``unknown`` (no start), with
    the time of the start, the step, steps done and the linear estimate of the end (ms); and ``stalled`` where
    an operation has been silent for ``silent_s``. An operation that has ended leaves no state and may start again.
    """
    rows = events.withWatermark("ts", delay).select("operation_id", millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "event", "step",
        F.col("progress").cast("double").alias("progress"))
    return rows.groupBy("operation_id").transformWithState(Progress(int(silent_s * 1000)),
        "operation_id long, at long, seq long, status string, began long, progress double, step string, steps_done int, eta long", "Append", "EventTime")


class Windows(StatefulProcessor):
    """Count, sum, least and largest value of each window of a series, given out once the watermark passes its end."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle_ = handle
        self.open = handle.getMapState("open", "start long", "n long, total double, least double, most double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        sums: dict[int, tuple] = {}
        for row in rows:
            at, value = row["at"], row["value"]
            start = at // self.width * self.width
            if start + self.width <= mark:
                yield Row(series=key[0], kind="late", start=start, at=at, n=1, total=value, least=value, most=value)
                continue
            if start not in sums:
                sums[start] = tuple(self.open.getValue((start,))) if self.open.containsKey((start,)) else (0, 0.0, None, None)
            n, total, least, most = sums[start]
            if value is not None:
                total, least, most = total + value, value if least is None else min(least, value), value if most is None else max(most, value)
            sums[start] = (n + 1, total, least, most)
        for start, held in sums.items():
            self.open.updateValue((start,), held)
            self.handle_.registerTimer(start + self.width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.width
        if self.open.containsKey((start,)):
            n, total, least, most = tuple(self.open.getValue((start,)))
            self.open.removeKey((start,))
            yield Row(series=key[0], kind="window", start=start, at=None, n=n, total=total, least=least, most=most)

    def close(self) -> None:
        pass


def windows_and_late(samples: DataFrame, width_s: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """series, kind, start (ms), at (ms), n, total, least and most: windows of (series, ts, value) as they close, and late rows.

    A row that comes after its window has been given out has kind ``late``, its time and value. So windows
    and late rows together hold every row once; a sink may write the two kinds to two places. Null values count in n alone.
    """
    rows = samples.withWatermark("ts", delay).select("series", millis("ts").alias("at"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("series").transformWithState(Windows(int(width_s * 1000)),
        "series string, kind string, start long, at long, n long, total double, least double, most double", "Append", "EventTime")
