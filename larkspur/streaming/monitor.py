"""Windowed monitoring and rate limits; the same function serves a stream and a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.text import rnd
from ..functions.times import epoch
from ..registry import operator


@operator(category="streaming")
def tumbling_monitor(samples: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, mean, largest and smallest value of each series in windows; rows later than ``late`` are dropped on streams."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(w.alias("w"), "series").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value"), 6).alias("avg_value"), F.max("value")
        .alias("max_value"), F.min("value").alias("min_value"))
    return out.select(epoch(F.col("w.start")).alias("window_start"), "series", "n", "avg_value", "max_value", "min_value")


@operator(category="streaming")
def session_monitor(samples: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of each series: rows no further apart than ``gap``."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "series").agg(F.count(F.lit(1)).alias("n")).select(epoch(F.col("w.start"))
        .alias("session_start"), "series", "n")


def _allow(times: list[float], kept: list[float], most: int, window: float) -> list[bool]:
    out = []
    for t in times:
        while kept and t - kept[0] >= window:
            kept.pop(0)
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out


@operator(category="streaming")
def rate_limit(requests: DataFrame, most: int = 3, window_s: float = 86400.0) -> DataFrame:
    """identifier, t and whether each request is allowed by a sliding log of the allowed ones (batch).

    A request counts if fewer than ``most`` were allowed in the window before it. State is at most
    ``most`` times per identifier. Whether a request is allowed depends on all before it, so an
    identifier's requests stream through one task in time order, however many they are. Requests
    without an identifier share one log; those without a time come first and are not limited.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, kept = (), []
        for batch in batches:
            allowed = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (i,) != who:
                    who, kept = (i,), []
                allowed += [True] if t is None else _allow([t / 1e6], kept, most, window_s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], ["identifier", "t", "allowed"])

    rows = requests.select("identifier", epoch(F.col("t"), "MICROSECOND").alias("t"))
    schema = StructType([*rows.schema.fields, StructField("allowed", BooleanType())])
    return rows.repartition("identifier").sortWithinPartitions("identifier", "t").mapInArrow(run, schema)


def rate_limit_stream(requests: DataFrame, most: int = 3, window_s: float = 86400.0) -> DataFrame:
    """``rate_limit`` on a stream: the log is the identifier's state."""

    def update(key, batches, state):
        kept = list(state.get[0]) if state.exists else []
        for b in batches:
            b = b.sort_values("t")
            times = (b["t"].astype("int64") / 1e6).tolist()
            yield pd.DataFrame({"identifier": key[0], "t": b["t"].astype("int64"), "allowed": _allow(times, kept, most, window_s)})
        state.update((kept,))

    rows = requests.select("identifier", epoch(F.col("t"), "MICROSECOND").alias("t"))
    return rows.groupBy("identifier").applyInPandasWithState(update, "identifier long, t long, allowed boolean", "kept array<double>", "append", "NoTimeout")
