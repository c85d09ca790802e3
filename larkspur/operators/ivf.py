"""An index of vectors by lists: each vector is in the list of its nearest centre, and lists are partitions on storage.

A search reads the lists whose centres are nearest to its queries. An exact search then reads those
others that could still hold a nearer vector: no vector of a list is nearer to a query than the angle to the
list's centre less the list's widest angle allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch
from .vectors import _matrix, nearest

#: Vectors that the centres are fitted on, at most; those whose ids have the smallest hashes.
SAMPLE = 1 << 14
#: Lists at most, and rounds of k-means.
LISTS, ROUNDS = 1 << 12, 8
#: Vectors of a list that one task compares with its queries, and that one file holds, about.
PART = 1 << 14


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k directions by spherical k-means, begun at evenly spaced rows; a list that runs empty keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.where(norm > 1e-12, norm, 1), c)
    return c


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of (vec_id, embedding) below ``path``, which must not exist; every row is in a list.

    Centres are fitted on at most ``sample`` vectors, on the driver; there are about as many as the square root of the rows. Vectors that are
    null, of length 0 or of another dimension than the sample's first are in list -1.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    some = rows.where("size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # the documented bound
    d = len(some[0]["embedding"]) if some else 0
    whole = [r["embedding"] for r in some if len(r["embedding"]) == d and all(v is not None for v in r["embedding"])]
    x = np.array(whole, np.float64).reshape(len(whole), d)
    norm = np.linalg.norm(x, axis=1, keepdims=True) if d else np.zeros((0, 1))
    x = x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    n = rows.count()
    k = max(1, min(lists or min(LISTS, round(math.sqrt(n))), len(x)))
    c = centres(x, k) if len(x) else np.zeros((0, d))
    scratch = Scratch(spark, "ivf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(pa.chunked_array([batch.column(1)]), d) if d else np.zeros((batch.num_rows, 0))
            near = m @ c.T if len(c) else np.full((batch.num_rows, 1), np.nan)
            bad = np.isnan(near[:, 0])
            at = np.where(bad, -1, np.argmax(np.where(np.isnan(near), -np.inf, near), axis=1))
            best = np.where(bad, np.nan, near[np.arange(len(at)), at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(best, from_pandas=True)], ["vec_id", "embedding", "list", "near"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = scratch.keep(rows.mapInArrow(run, f"vec_id {kind}, embedding array<double>, list int, near double"), "placed")
    about = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least"))
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, centre array<double>") if len(c) else None
    about = about.withColumn("centre", F.lit(None).cast("array<double>")) if held is None else about.join(F.broadcast(held), "list", "left")
    about = scratch.keep(about, "lists")
    about.coalesce(1).write.parquet(f"{path}/lists")
    placed.select("vec_id", "embedding", F.lit(0).alias("part"), "list").limit(0).coalesce(1).write.parquet(f"{path}/kind")
    parts = F.ceil(F.col("n") / PART).cast("int")
    spread = placed.join(F.broadcast(about.select("list", "n")), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
    spread.repartition("list", "part").select("vec_id", "embedding", "part", "list").write.partitionBy("list").parquet(f"{path}/rows")
    scratch.drop(placed, about)
    return VectorIndex(spark, path)


class VectorIndex:
    """An index that ``build`` has written. Its centres, at most ``LISTS``, are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.kind = spark.read.parquet(f"{path}/kind").schema
        found = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
        self.sizes = {r["list"]: r["n"] for r in found}
        good = [r for r in found if r["list"] >= 0]
        self.lists = np.array([r["list"] for r in good], np.int32)
        self.c = np.array([r["centre"] for r in good], np.float64)
        self.least = np.array([r["least"] for r in good], np.float64)

    def read(self, lists: list[int]) -> DataFrame:
        """The vectors of some lists; the other lists' files are not opened."""
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/rows").where(F.col("list").isin(lists) if lists else F.lit(False))

    def _asked(self, queries: DataFrame, probes: int, bound: bool) -> DataFrame:
        """(query_id, q, list): the ``probes`` nearest lists of each query; with ``bound``, of queries with ``floor``, all others that may hold a similarity of it or more."""
        c, lists, least, every = self.c, self.lists, self.least, -1 in self.sizes
        widest = np.arccos(np.clip(least, -1, 1)) if len(c) else least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                q = _matrix(pa.chunked_array([batch.column(1)]), c.shape[1]) if len(c) else np.zeros((n, 0))
                near = q @ c.T if len(c) else np.zeros((n, 0))
                blind = np.isnan(near).any(axis=1) if len(c) else np.ones(n, bool)
                order = np.argsort(-np.where(np.isnan(near), -np.inf, near), axis=1, kind="stable")
                first = np.zeros(near.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                if bound:
                    floor = batch.column(2).to_numpy(zero_copy_only=False)
                    angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - widest[None, :], 0)
                    chosen = ~first & (np.isnan(floor)[:, None] | (np.cos(angle) >= floor[:, None] - 2e-6))
                else:
                    chosen = first
                chosen[blind] = ~first[blind] if bound else first[blind]  # without a direction every vector is as near
                i, j = np.nonzero(chosen)
                at = lists[j]
                if bound and every:
                    short = np.flatnonzero(np.isnan(floor) | blind)
                    i, at = np.concatenate([i, short]), np.concatenate([at, np.full(len(short), -1, np.int32)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(at, pa.int32())], ["query_id", "q", "list"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.mapInArrow(run, f"query_id {kind}, q array<double>, list int")

    def _hits(self, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest of each list to each query that asks it, (query_id, vec_id, similarity)."""
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # at most as many as there are lists
        rows = self.read(lists).select("vec_id", "embedding", "list", "part")
        parts = F.element_at(F.create_map(*[F.lit(v) for i, n in self.sizes.items() for v in (i, -(-n // PART))]), F.col("list"))
        asks = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

        def run(table: pa.Table, some: pa.Table) -> pa.Table:
            return nearest(table.select(["vec_id", "embedding"]), some, k).select(["query_id", "vec_id", "similarity"])

        kinds = ", ".join(f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((asked, "query_id"), (rows, "vec_id")))
        return rows.groupBy("list", "part").cogroup(asks.groupBy("list", "part")).applyInArrow(run, f"{kinds}, similarity double")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """query_id, vec_id and similarity of the k nearest vectors to each query (query_id, q), from its ``probes`` nearest lists.

        With ``exact`` the rows are those of a comparison with all vectors, ties by vec_id and vectors
        without a similarity last. query_id tells the queries apart.
        """
        scratch = Scratch(self.spark, "search")
        wanted = scratch.keep(queries.select("query_id", F.col("q").cast("array<double>").alias("q")), "queries")
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        top = lambda rows: rows.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
        first = scratch.keep(top(self._hits(self._asked(wanted, probes, False), k)), "first")
        if not exact:
            return first.drop("_rank")
        floor = first.groupBy("query_id").agg(F.when(F.count("similarity") >= k, F.min("similarity")).alias("floor"))
        open_ = wanted.join(floor, wanted["query_id"].eqNullSafe(floor["query_id"]), "left").select(wanted["query_id"], "q", "floor")
        more = self._hits(scratch.keep(self._asked(open_, probes, True), "asked"), k)
        return top(first.drop("_rank").unionByName(more)).drop("_rank")
