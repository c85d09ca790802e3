"""Pairs of sets: agreement of sketches, and the exact check on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .joins import sized_join
from .memory import give_back

#: Min-hash values of a sketch.
COORDINATES = 128
#: Partners that a set is compared with in one place, about.
PARTNERS = 256


def agreement(x: np.ndarray) -> np.ndarray:
    """How many values each two sketches share."""
    out = np.empty((len(x), len(x)), np.int16)
    for i in range(0, len(x), 32):
        out[i : i + 32] = (x[i : i + 32, None, :] == x[None, :, :]).sum(axis=2)
    np.fill_diagonal(out, 0)
    return out


def common(sets: list[np.ndarray], rows: int = 512, columns: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
    """How many values each two sets share, ``rows`` sets against all at a time: (first set, counts).

    The sets are 0 and 1 in columns of the values that several sets have; products of those are counts.
    """
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    wide = int((n > 1).sum())
    cuts = np.searchsorted(column, np.arange(0, wide + columns, columns))
    for lo in range(0, len(sets), rows):
        some = min(rows, len(sets) - lo)
        same = np.zeros((some, len(sets)))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            x = np.zeros((len(sets), min(columns, wide - k * columns)), np.float32)
            x[owner[a:b], column[a:b] - k * columns] = 1
            same += x[lo : lo + some] @ x.T
        yield lo, same


def checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of sets (fp, tokens) that are similar, in either order.

    One set of a pair is sent once for every ``PARTNERS`` of its partners or so, which follow it; a task
    holds one set and a batch of others. Of a pair, a set with many partners is that one.
    """
    ends = pairs.select(F.col("a").alias("hub")).unionByName(pairs.select(F.col("b").alias("hub")))
    parts_ = F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).cast("int").alias("parts")
    hubs = Scratch(pairs.sparkSession, "hubs").keep(ends.groupBy("hub").agg(parts_).where("parts > 1"))
    turned = sized_join(pairs, hubs.select("hub"), F.col("b") == F.col("hub"), "left")
    turn = F.col("hub").isNotNull()
    turned = turned.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    placed = sized_join(turned, hubs, F.col("a") == F.col("hub"), "left").select("a", "b", part)
    head = placed.select("a", "part").distinct().join(sets, F.col("a") == F.col("fp"))
    rest = placed.join(sets, F.col("b") == F.col("fp"))
    rows = head.select("a", "fp", "tokens", "part").unionByName(rest.select("a", "fp", "tokens", "part")).withColumn("later", F.col("a") != F.col("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, was = None, None, None
        for batch in batches:
            found = []
            for a, fp, tokens in zip(*[batch.column(i) for i in range(3)]):
                a, fp = a.as_py(), fp.as_py()
                if (a, fp) == was:
                    continue
                was = (a, fp)
                own = np.frombuffer(tokens.as_buffer(), np.uint64)
                if a == fp:
                    now, mine = a, own.copy()
                elif a == now:
                    common = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                    if common >= threshold * (len(mine) + len(own) - common) - 1e-9:
                        found.append((a, fp))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])
        give_back()

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "later", "fp").select("a", "fp", "tokens").mapInArrow(run, "a binary, b binary")
