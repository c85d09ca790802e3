"""Indexes for retrieval: chunks, embeddings, and collections of them in folders of Parquet files."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..registry import operator
from ..snapshots import Conflict, SnapshotLog
from ..storage import Scratch, remove
from .text import chunk_smart
from .vectors import topk

#: A function from texts to a matrix with a row for each.
Embedder = Callable[[list[str]], np.ndarray]
DIMENSION = 64
#: Texts that an embedder gets at a time.
BATCH = 32


@lru_cache(1 << 16)
def word_class(word: str) -> int:
    """The first byte of a word's MD5 digest."""
    return hashlib.md5(word.encode()).digest()[0]


def hashed_words(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """How many of a text's lower-case words fall into each of ``dimension`` (256 at most) classes of their MD5 digests: an embedder that needs no model."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for w in re.findall(r"\w+", text.lower()):
            out[i, word_class(w) % dimension] += 1
    return out


@operator(category="rag")
def embed(rows: DataFrame, embedder: Embedder = hashed_words, column: str = "text", normalize: bool = True) -> DataFrame:
    """The rows with an ``embedding`` of length 1; texts that embed as zeros stay zeros, null texts are empty."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("embedding array<double>").fields])
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            got = [np.asarray(embedder(texts[i : i + BATCH]), np.float64) for i in range(0, len(texts), BATCH)]
            if got:
                x = np.concatenate(got)
                if normalize:
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = x / np.where(norm > 0, norm, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], schema.names)

    return rows.mapInArrow(run, schema)


@operator(category="rag")
def build_index(docs: DataFrame, embedder: Embedder = hashed_words, size: int = 800, overlap: int = 100) -> DataFrame:
    """id, text, metadata and embedding of the clean chunks of (doc_id, text): rows for ``Collections.upsert``.

    An id is the document's and the chunk's number; rows that share a doc_id share ids, of which the collection keeps one.
    """
    chunks = chunk_smart(docs.select("doc_id", "text"), size, overlap)
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("chunk").cast("string"))
    metadata = F.create_map(F.lit("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("chunk"), F.col("chunk").cast("string"))
    return embed(chunks.select(key.alias("id"), "text", metadata.alias("metadata")), embedder)


ROWS = "id string, text string, metadata map<string,string>, embedding array<double>"


class Collections:
    """Named collections below a folder. A collection is a log of snapshots; a snapshot says for each bucket of ids where its Parquet files are.

    An upsert rewrites the buckets that its ids fall into, in a folder of its own, and then commits a
    snapshot that leads to them. A writer that stops before has changed nothing. Of two writers at a time one
    commits first; the other takes its buckets over, or merges again where both touched the same. Readers
    keep the snapshot that they began with until ``vacuum`` removes its files.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, attempts: int = 20):
        self.spark, self.root, self.buckets, self.attempts = spark, root.rstrip("/"), buckets, attempts

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise ValueError("a collection's name has letters, digits, dots, lines and underscores")
        return f"{self.root}/{name}"

    def _log(self, name: str) -> SnapshotLog:
        return SnapshotLog(self.spark, self._path(name) + "/log")

    def exists(self, name: str) -> bool:
        return self._log(name).latest() is not None

    def create(self, name: str, metadata: dict | None = None) -> bool:
        """Make a collection; false where there is one already, which stays as it is."""
        if self.exists(name):
            return False
        about = {"space": "cosine"} if metadata is None else metadata
        try:
            self._log(name).commit(0, {"about": about, "buckets": self.buckets, "folders": {}, "operation": "create"})
        except Conflict:
            return False
        return True

    def about(self, name: str) -> dict:
        return self._log(name).read(0)["about"]

    def names(self) -> list[str]:
        fs, path = self._fs(self.root)
        found = fs.listStatus(path) if fs.exists(path) else []
        return sorted(n for s in found if s.isDirectory() and self.exists(n := s.getPath().getName()))

    def delete(self, name: str) -> bool:
        """Remove a collection; false where there is none."""
        there = self.exists(name)
        if there:
            remove(self.spark, self._path(name))
        return there

    def history(self, name: str) -> list[tuple[int, str]]:
        """Versions and what made them, the first one first."""
        log = self._log(name)
        return [(v, log.read(v)["operation"]) for v in log.versions()]

    def _read(self, name: str, folders: dict[str, str]) -> DataFrame:
        """The rows of buckets, given their folders."""
        paths = [f"{self._path(name)}/rows/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        if not paths:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*paths)

    def get(self, name: str, version: int | None = None) -> DataFrame:
        """id, text, metadata and embedding of a collection, of its last version or the one named; an unknown or new one is empty."""
        log = self._log(name)
        at = log.latest() if version is None else version
        return self._read(name, {} if at is None else log.read(at)["folders"])

    def _buckets_of(self, name: str) -> tuple[int, Column]:
        n = self._log(name).read(0)["buckets"]
        return n, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def _commit(self, name: str, operation: str, touched: list[str], rewritten: Callable[[dict[str, str]], DataFrame]) -> int:
        """Commit new contents of the buckets ``touched``; ``rewritten`` makes their rows (with ``bucket``) from the folders that they have now."""
        log, based_on, made = self._log(name), None, {}
        for _ in range(self.attempts):
            latest = log.latest()
            content = log.read(latest)
            old = {b: f for b, f in content["folders"].items() if b in set(touched)}
            if old != based_on:
                folder = uuid.uuid4().hex
                rows = rewritten(old)
                rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self._path(name)}/rows/{folder}")
                fs, path = self._fs(f"{self._path(name)}/rows/{folder}")
                filled = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(path) if s.isDirectory()}
                based_on, made = old, {b: folder for b in filled}
            kept = {b: f for b, f in content["folders"].items() if b not in set(touched)}
            try:
                log.commit(latest + 1, content | {"folders": kept | made, "operation": operation})
                return latest + 1
            except Conflict:
                continue
        raise Conflict(f"{name}: {self.attempts} other writers were faster")

    def upsert(self, name: str, rows: DataFrame, version: str | None = None) -> int:
        """Add or replace rows (id, text, metadata, embedding) by id; the number of ids.

        Rows without an id get a new one. Of several rows with one id that with the largest ``version``
        counts; without a version, or where it ties, that with the largest text.
        """
        self.create(name)
        scratch = Scratch(self.spark, "upsert")
        last = F.struct(*([version] if version else []), F.coalesce("text", F.lit("")).alias("_text"))
        keyed = scratch.keep(rows.withColumn("id", F.coalesce(F.col("id").cast("string"), F.expr("uuid()"))))
        new = keyed.groupBy("id").agg(F.max_by(F.struct("text", "metadata", "embedding"), last).alias("r")).select("id", "r.*")
        bucket = self._buckets_of(name)[1]
        new = scratch.keep(new.withColumn("bucket", bucket))
        touched = [str(r["bucket"]) for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        n = new.count()
        if touched:
            self._commit(name, "upsert", touched, lambda old: self._read(name, old).join(new.select("id"), "id", "left_anti").withColumn("bucket",
                bucket).unionByName(new))
        scratch.drop(keyed, new)
        return n

    def remove_ids(self, name: str, ids: DataFrame) -> None:
        """Delete the rows whose id is in ``ids`` (id); unknown ids are ignored."""
        scratch = Scratch(self.spark, "remove")
        n, bucket = self._buckets_of(name)
        gone = scratch.keep(ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().withColumn("bucket", bucket))
        touched = [str(r["bucket"]) for r in gone.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if touched:
            self._commit(name, "remove", touched, lambda old: self._read(name, old).join(gone.select("id"), "id", "left_anti").withColumn("bucket", bucket))
        scratch.drop(gone)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Remove the files that none of the last ``keep`` versions leads to; the number of folders. No writer may be at work."""
        log = self._log(name)
        held = {f"{folder}/bucket={b}" for v in log.versions()[-keep:] for b, folder in log.read(v)["folders"].items()}
        fs, path = self._fs(self._path(name) + "/rows")
        removed = 0
        for run in fs.listStatus(path) if fs.exists(path) else []:
            for part in fs.listStatus(run.getPath()):
                if part.isDirectory() and f"{run.getPath().getName()}/{part.getPath().getName()}" not in held:
                    removed += fs.delete(part.getPath(), True)
        return removed

    def stats(self, name: str) -> dict:
        """Rows, dimension of the embeddings, and the metadata fields of one row."""
        rows = self.get(name)
        sample = rows.select(F.size("embedding").alias("d"), F.map_keys("metadata").alias("k")).first()
        return {"collection_name": name, "document_count": rows.count(), "embedding_dimension": sample["d"] if sample else None,
            "metadata_fields": sorted(sample["k"] or []) if sample else []}

    def query(self, name: str, queries: DataFrame, k: int = 5, where: Column | None = None, contains: str | None = None,
        embedder: Embedder = hashed_words, include: tuple[str, ...] = ("metadata", "document", "distance")) -> DataFrame:
        """The k nearest rows to each query (query_id, text) or (query_id, embedding): query_id, rank, id and what ``include`` names.

        ``where`` is a condition on the rows' columns, such as ``metadata['source'] = '3'``; ``contains`` a part of their text.
        """
        rows = self.get(name).withColumnRenamed("id", "vec_id")
        test = where if where is not None else F.lit(True)
        if contains is not None:
            test = test & F.contains("text", F.lit(contains))
        asked = queries if "embedding" in queries.columns else embed(queries.select("query_id", "text"), embedder)
        hits = topk(rows, asked.select("query_id", F.col("embedding").alias("q")), k, test)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
        parts = {"metadata": [F.col("metadata")], "document": [F.col("text").alias("document")], "distance": [(F.lit(1.0) - F.col(
                        "similarity")).alias("distance"), F.col("similarity")]}
        return hits.select("query_id", rank.cast("long").alias("rank"), F.col("vec_id").alias("id"), *[c for name_ in include for c in parts[name_]])


def quick_setup(spark: SparkSession, paths: str | list[str], root: str, name: str = "default", embedder: Embedder = hashed_words,
    size: int = 800, overlap: int = 100) -> Collections:
    """Read, clean, chunk and embed files, and put them into a collection; it is ready for ``query``."""
    from ..sources.ingest import read_documents

    out = Collections(spark, root)
    docs = read_documents(spark, paths).where("text is not null").select(F.col("path").alias("doc_id"), "text")
    out.upsert(name, build_index(docs, embedder, size, overlap))
    return out
