"""Packing into optimal length buckets and token-budget batches.

Dynamic programming over the global length histogram chooses the bucket boundaries that make the
least padding; each bucket's documents, in a hashed order, are cut into batches that stay within
the token budget when padded to the bucket's boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .mixing import n_words
from .sharding import draw, key_text, number

BUCKETS = 12
BUDGET = 65_536


def boundaries(lengths: list[int] | np.ndarray, counts: list[int] | np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds, out of ``lengths``, with the least padding in total.

    ``lengths`` ascend; documents of length l are padded to the first bound that is not below l. The
    cost of a bucket satisfies the quadrangle inequality, so the best last cut grows with the length:
    each layer is solved by halving, a level of midpoints at a time, in O(m log m) for m lengths.
    """
    x, n = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    m = len(x)
    if not m:
        return []
    upto, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    best = x * upto[1:] - words[1:]  # one bucket for lengths 0..j
    choice: list[np.ndarray] = []
    for _ in range(min(buckets, m) - 1):
        nxt, came = best.copy(), np.full(m, -1)
        lo, hi, low, high = (np.array([v]) for v in (1, m - 1, 0, m - 2))  # lengths lo..hi, whose last cuts are in low..high
        while len(lo):
            mid = (lo + hi) // 2
            last = np.minimum(high, mid - 1)
            size = last - low + 1
            first = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(first - low, size)
            j = np.repeat(mid, size)
            cost = best[i] + x[j] * (upto[j + 1] - upto[i + 1]) - (words[j + 1] - words[i + 1])
            least = np.minimum.reduceat(cost, first)
            at = np.flatnonzero(cost == np.repeat(least, size))
            of = np.searchsorted(first, at, "right") - 1
            pick = i[at[np.concatenate([[True], of[1:] != of[:-1]])]]
            better = least < nxt[mid]
            nxt[mid], came[mid] = np.where(better, least, nxt[mid]), np.where(better, pick, came[mid])
            lo, hi, low, high = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([low, pick]), np.concatenate([pick, high])
            some = lo <= hi
            lo, hi, low, high = lo[some], hi[some], low[some], high[some]
        choice.append(came)
        best = nxt
    cuts, j = [m - 1], m - 1
    for came in reversed(choice):
        if came[j] >= 0:
            j = int(came[j])
            cuts.append(j)
    return [int(x[i]) for i in sorted(set(cuts))]


def histogram(lengths: DataFrame, column: str = "n_tokens") -> tuple[np.ndarray, np.ndarray]:
    """The lengths that occur and how often; as many rows as there are different lengths, however many documents."""
    rows = lengths.groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")
    return rows["length"].to_numpy(), rows["n"].to_numpy()


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, place and padding of all documents.

    Tokens are words. ``bucket_tokens`` is the padded length and ``batch`` a number in the bucket;
    a batch holds at most budget / bucket_tokens documents, or one document that is longer than the
    budget. Documents without words, null texts among them, count as length 0 and are packed too.
    A bucket may hold any share of all rows: ``number`` splits it. Repeated rows keep a place each. The
    texts are read once; their ids and lengths are kept.
    """
    rows = Scratch(docs.sparkSession, "pack").keep(docs.select(F.col("doc_id"), n_words(F.col("text")).alias("n_tokens")), "lengths")
    bounds = boundaries(*histogram(rows), buckets)
    upper = F.lit(bounds[-1] if bounds else 0)
    index = F.lit(max(0, len(bounds) - 1))
    for i in range(len(bounds) - 2, -1, -1):
        upper = F.when(F.col("n_tokens") <= bounds[i], F.lit(bounds[i])).otherwise(upper)
        index = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(index)
    rows = rows.withColumns({"bucket": index.cast("int"), "bucket_tokens": upper.cast("long"), "_key": draw(key_text(F.col("doc_id"), F.col(
                    "n_tokens")), "pack")})
    placed = number(rows, ["bucket"], "_key", ["doc_id", "n_tokens", "bucket_tokens"], "_slot")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(F.col("_slot") / fit).cast("long").alias("batch"),
        F.pmod(F.col("_slot"), fit).cast("long").alias("place"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
