"""Vector search and retrieval: exact cosine top-k, collections, and token-budgeted context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..registry import operator


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Bytes of vectors, as doubles, and number of queries that are scored against each other in one piece.
BLOCK, QUERIES = 64 << 20, 1 << 14
#: Vectors of which the best one stands in a query's first look, and how far single precision and rounding may be off.
GROUP, MARGIN = 128, 2e-5


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of length 1, in double; zero and missing vectors and those of another length than ``d`` are NaN."""
    column = column.combine_chunks()
    out = np.full((len(column), d), np.nan)
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), d), False)
    whole = column.filter(fits)
    out[fits.to_numpy(zero_copy_only=False)] = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), d)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, np.nan)


def likely(q: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of q those rows of x, at least k, that may be among its k best: no more than ``MARGIN`` below the k-th best of the best of all groups."""
    near = q @ x.T
    whole = len(x) // GROUP
    if whole < k:
        return [np.arange(len(x))] * len(q)
    tops = near[:, : whole * GROUP].reshape(len(q), whole, GROUP).max(axis=2)
    least = np.partition(tops, -k, axis=1)[:, -k]
    return [np.flatnonzero(own >= bound - np.float32(MARGIN)) for own, bound in zip(near, least)]


def nearest(table: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """The k rows of ``table`` (vec_id, embedding, ...) nearest to each of ``asks`` (query_id, q), with query_id and similarity.

    A first look in single precision leaves few rows for each query; these are scored in double.
    """
    ids, found, whose, sims = table["vec_id"].to_numpy(), [], [], []
    sizes = pc.fill_null(pc.list_value_length(asks["q"]), 0).to_numpy()
    for d in np.unique(sizes) if table.num_rows else ():
        of = np.flatnonzero(sizes == d)
        x, q = _matrix(table["embedding"], int(d)), _matrix(asks["q"].take(pa.array(of)), int(d))
        # rows without a similarity come last, so they don't count where there are k others
        whole = np.flatnonzero(~np.isnan(x).any(axis=1)) if d else np.zeros(0, np.int64)
        light = x[whole].astype(np.float32)
        for i in range(0, len(q), 64):
            part = q[i : i + 64]
            some = likely(part.astype(np.float32), light, k) if len(whole) >= k else None
            for j, own in enumerate(part):
                at = np.arange(len(x)) if some is None or np.isnan(own).any() else whole[some[j]]
                # a sum over no coordinates is 0, but there is no similarity of empty vectors
                near = x[at] @ own if d else np.full(len(at), np.nan)
                near = np.floor(near * 1e6 + 0.5) / 1e6
                best = np.lexsort((ids[at], -np.where(np.isnan(near), -np.inf, near)))[:k]
                found.append(at[best]), whose.append(np.full(len(best), of[i + j])), sims.append(near[best])
    cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    hits = table.take(pa.array(cat(found, np.int64)))
    return hits.append_column("query_id", asks["query_id"].take(pa.array(cat(whose, np.int64)))).append_column("similarity",
        pa.array(cat(sims, np.float64), from_pandas=True))


@operator(category="vectors")
def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k vectors nearest to each query (query_id, q), with query_id and similarity; filters come first.

    Vectors and queries are dealt into blocks, and every block of vectors meets every block of queries
    once; it sends k rows a query at most. Vectors without a similarity come last, ties by vec_id.
    """
    rows = vectors.where(where) if where is not None else vectors
    held, widest = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n, m = max(1, -(-held * 8 * max(widest or 1, 1) // BLOCK)), max(1, -(-queries.count() // QUERIES))
    rows = rows.withColumns({"_v": F.pmod(F.xxhash64("vec_id"), F.lit(n)), "_q": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    asked = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("_q"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_v"))

    def run(table: pa.Table, asks: pa.Table) -> pa.Table:
        return nearest(table.drop_columns(["_v", "_q"]), asks, k)

    kind = StructType([*vectors.schema.fields, StructField("query_id", queries.schema["query_id"].dataType), StructField("similarity", DoubleType())])
    near = rows.groupBy("_v", "_q").cogroup(asked.groupBy("_v", "_q")).applyInArrow(run, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


@operator(category="vectors")
def l2_normalize(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; zero vectors stay."""
    n = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.withColumn("norm", n).withColumn("embedding", F.when(F.col("norm") > 0, F.transform("embedding", lambda x: x.cast(
                    "double") / F.col("norm"))).otherwise(F.col("embedding").cast("array<double>")))


@operator(category="vectors")
def upsert_latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key; a hash aggregate combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


@operator(category="rag")
def context_budget(hits: DataFrame, budget: int, group: str = "conv_id", rank: str = "turn", text: str = "text") -> DataFrame:
    """Pieces in rank order while their tokens (length // 4) fit; the first that doesn't is cut if over 50 tokens are left."""
    w = Window.partitionBy(group).orderBy(rank)
    h = hits.withColumn("tokens", F.floor(F.length(text) / 4).cast("long"))
    h = h.withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("upto") - F.col("tokens"))
    h = h.withColumn("left", left).where((F.col("upto") <= budget) | ((F.col("left") > 50) & (F.col("upto") - F.col("tokens") <= budget)))
    return h.select(group, rank, "tokens", (F.col("upto") > budget).alias("truncated"), F.when(F.col("upto") > budget,
            F.concat(F.substring(F.col(text), F.lit(1), ((F.col("left") - 20) * 4).cast("int")), F.lit("..."))).otherwise(F.col(text))
        .alias("piece"))


@operator(category="rag")
def assemble_context(pieces: DataFrame, group: str = "conv_id", rank: str = "turn") -> DataFrame:
    """One context string for each group, pieces in rank order."""
    return pieces.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "piece"))), lambda x: x["piece"]),
            "\n\n").alias("context"), F.sum("tokens").alias("tokens"))
