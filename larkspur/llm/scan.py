"""Running sums over sorted rows of any number, also within segments that fill many partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..storage import Scratch
from .joins import quoted


def _within(values: np.ndarray, start: np.ndarray, carry: int, ufunc: np.ufunc) -> np.ndarray:
    """Inclusive running values that begin anew where ``start`` is set; the rows before the first start continue ``carry``."""
    total = ufunc.accumulate(values)
    at = np.maximum.accumulate(np.where(start, np.arange(len(values)), -1))
    before = np.where(at > 0, total[np.maximum(at - 1, 0)], 0)
    undone = total - before if ufunc is np.add else total ^ before
    return np.where(at < 0, ufunc(total, np.int64(carry)), undone)


def _carries(kept: DataFrame, seg: str, cols: list[str], ops: list[np.ufunc]) -> list[tuple]:
    """(task, segment, what earlier tasks hold of it) for each task whose first segment began before it."""
    firsts, lasts = {}, {}
    for part, edge, *row in kept.where("_edge > 0").select("_part", "_edge", seg, *cols).collect():  # two rows a task at most
        if edge & 1:
            firsts[part] = row[0]
        if edge & 2:
            lasts[part] = row
    out, segment, held = [], None, [0] * len(cols)
    for part in sorted(firsts):
        if firsts[part] == segment:
            out.append((part, segment, *held))
        end, *tail = lasts[part]
        held = [int(op(np.int64(a), np.int64(b))) for a, b, op in zip(held if end == segment else [0] * len(cols), tail, ops)]
        segment = end
    return out


def running(df: DataFrame, order: list[Column | str], scratch: Scratch, sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), segment: str | None = None) -> DataFrame:
    """``df`` with ``<c>_run`` for each long column of ``sums`` and ``xors``: inclusive over the rows of its ``segment`` so far.

    Rows are sorted by ranges of (segment, order), so a segment may fill many tasks. Each task adds up by itself
    and its rows are written; what the earlier tasks hold of its first segment is then added. The driver sees the
    first and the last row of each task, no more. ``segment`` is a long column without nulls; without one
    all rows are one segment. ``df`` is read twice, once to find the ranges. Columns are distinct and don't
    end in ``_run``.
    """
    spark = df.sparkSession
    cols, ops = [*sums, *xors], [np.add] * len(sums) + [np.bitwise_xor] * len(xors)
    rows = df if segment else df.withColumn("_segment", F.lit(0).cast("long"))
    seg = segment or "_segment"
    keys = [seg, *order]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    names = rows.columns
    at_seg, at = names.index(seg), [names.index(c) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, held = TaskContext.get().partitionId(), None, [0] * len(cols), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            of = batch.column(at_seg).to_numpy(zero_copy_only=False)
            start = np.concatenate([[last is not None and of[0] != last], of[1:] != of[:-1]])
            got = []
            for i, (c, op) in enumerate(zip(at, ops)):
                r = _within(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), start, carry[i], op)
                carry[i] = int(r[-1])
                got.append(pa.array(r))
            edge = np.zeros(n, np.int32)
            edge[0] = last is None  # 1 is a task's first row, 2 its last one
            last = of[-1]
            held = pa.RecordBatch.from_arrays([*batch.columns, *got, pa.array(np.full(n, part, np.int64)), pa.array(edge)], schema.names)
        if held is not None:
            edge = held.column(len(schema.names) - 1).to_numpy().copy()
            edge[-1] += 2
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge)], schema.names)

    added = [*[StructField(f"{c}_run", LongType()) for c in cols], StructField("_part", LongType()), StructField("_edge", IntegerType())]
    schema = StructType([*rows.schema.fields, *added])
    kept = scratch.keep(ranged.mapInArrow(run, schema), "run")
    carries = _carries(kept, seg, [f"{c}_run" for c in cols], ops)
    names_ = StructType([StructField("_p", LongType()), StructField("_of", LongType()), *[StructField(f"_{i}_carry", LongType()) for i in range(len(cols))]])
    carried = spark.createDataFrame(carries, names_)
    out = kept.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & (F.col(seg) == F.col("_of")), "left")
    final = []
    for i, (c, op) in enumerate(zip(cols, ops)):
        mine, more = F.col(f"{c}_run"), F.coalesce(F.col(f"_{i}_carry"), F.lit(0))
        final.append((mine + more if op is np.add else mine.bitwiseXOR(more)).alias(f"{c}_run"))
    return out.select(*[quoted(c) for c in df.columns], *final)
