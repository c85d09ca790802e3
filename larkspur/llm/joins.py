"""Joins that broadcast a side only after its rows and bytes have been counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: A side of at most so many rows and bytes may be broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a field, and what texts, bytes and arrays hold."""
    sizes = [F.lit(8 * len(df.columns) + 8)]
    for f in df.schema:
        if isinstance(f.dataType, StringType | BinaryType):
            sizes.append(F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)))
        elif isinstance(f.dataType, ArrayType):
            sizes.append(F.coalesce(F.size(quoted(f.name)), F.lit(0)) * 24)
    return reduce(lambda a, b: a + b, sizes).cast("long")


def sized_join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``right``: broadcast if a count finds at most ``rows`` rows and 16 MB, else shuffled."""
    n, held = right.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(right))).first()
    small = n <= rows and (held or 0) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)
