"""Small groups of rows handled as a whole in Python, without pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import give_back


def by_cell(df: DataFrame, cell: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on all rows of each value of the long column ``cell``; it returns a batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[pa.RecordBatch] = []
        rows = 0

        def whole(part: pa.RecordBatch):
            nonlocal rows
            got = fn(part)
            if got is not None and got.num_rows:
                out.append(got)
                rows += got.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index(cell)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            if held and held[0].column(held[0].schema.get_field_index(cell))[0].as_py() != key[0]:
                whole(_one(held))
                held = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if b == len(key):
                    held.append(part)
                elif held:
                    whole(_one([*held, part]))
                    held = []
                else:
                    whole(part)
            if rows >= 4096:
                yield _one(out)
                out, rows = [], 0
        if held:
            whole(_one(held))
        if out:
            yield _one(out)
        give_back()

    return df.repartition(cell).sortWithinPartitions(cell).mapInArrow(run, schema)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    t = pa.Table.from_batches(batches).combine_chunks()
    return t.to_batches(max_chunksize=max(1, t.num_rows))[0]

