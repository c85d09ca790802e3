"""Posting lists of character trigrams beside a collection, by which a text condition finds its rows before texts are read.

The lists belong to the Parquet folders of a collection's snapshots, so an upsert leaves those of untouched buckets
valid, and only new folders have to be indexed. A posting is a row (gram, id); files are sorted by gram, so a
search reads the row groups of its grams alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Collections

#: Characters of a gram, and grams of a search that are looked up, the rarest ones.
N, LOOKED_UP = 3, 4


def grams(text: Column) -> Column:
    """The distinct grams of a text; none where it is shorter or null."""
    many = F.length(text) - (N - 1)
    return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), many), lambda i: F.substring(text, i, F.lit(N))))).otherwise(F.array())


class TextIndex:
    """The trigram index of one collection."""

    def __init__(self, collections: Collections, name: str):
        self.held, self.name, self.spark = collections, name, collections.spark
        self.path = f"{collections._path(name)}/grams"

    def _folders(self) -> dict[str, str]:
        log = self.held._log(self.name)
        return log.read(log.latest())["folders"] if self.held.exists(self.name) else {}

    def _done(self, folder: str, bucket: str) -> bool:
        fs, path = self.held._fs(f"{self.path}/{folder}-{bucket}/counts/_SUCCESS")
        return fs.exists(path)

    def refresh(self) -> int:
        """Index the folders of the last snapshot that aren't yet; how many they were. Each is complete once its counts are."""
        todo = [(b, f) for b, f in sorted(self._folders().items()) if not self._done(f, b)]
        for bucket, folder in todo:
            rows = self.held._read(self.name, {bucket: folder}).select("id", F.explode(grams(F.col("text"))).alias("gram"))
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            at = f"{self.path}/{folder}-{bucket}"
            rows.repartitionByRange(parts, "gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{at}/postings")
            counts = self.spark.read.schema("id string, gram string").parquet(f"{at}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            counts.repartitionByRange(1, "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{at}/counts")
        return len(todo)

    def postings(self, folders: list[str], wanted: list[str]) -> DataFrame:
        """The postings (id, gram) of some grams; row groups without them are skipped by their statistics."""
        paths = [f"{self.path}/{f}/postings" for f in folders]
        return self.spark.read.schema("id string, gram string").parquet(*paths).where(F.col("gram").isin(wanted))

    def candidates(self, part: str) -> tuple[DataFrame | None, dict[str, str]]:
        """Ids of indexed buckets whose texts hold the rarest grams of ``part``, and the buckets that aren't indexed; no ids (None) where the part is too short or no bucket is."""
        folders = self._folders()
        ready = {b: f for b, f in folders.items() if self._done(f, b)}
        wanted = sorted({part[i : i + N] for i in range(len(part) - N + 1)})
        if not wanted or not ready:
            return None, folders
        names = [f"{f}-{b}" for b, f in ready.items()]
        counts = self.spark.read.schema("gram string, n long").parquet(*[f"{self.path}/{n}/counts" for n in names]).where(F.col("gram").isin(wanted))
        held = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # at most as many as the part has grams
        rare = sorted(wanted, key=lambda g: (held.get(g, 0), g))[:LOOKED_UP]
        if held.get(rare[0], 0) == 0:
            return self.spark.createDataFrame([], "id string"), {b: f for b, f in folders.items() if b not in ready}
        found = self.postings(names, rare).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("id")
        return found, {b: f for b, f in folders.items() if b not in ready}

    def contains(self, part: str) -> DataFrame:
        """The rows of the collection whose text contains ``part``, case counting: those that a scan of all texts would give."""
        test = F.contains("text", F.lit(part))
        ids, rest = self.candidates(part)
        if ids is None:
            return self.held.get(self.name).where(test)
        ready = {b: f for b, f in self._folders().items() if b not in rest}
        number = self.held._buckets_of(self.name)[1]
        buckets = [str(r["b"]) for r in ids.select(number.alias("b")).distinct().collect()]  # at most as many as there are buckets
        hit = self.held._read(self.name, {b: f for b, f in ready.items() if b in set(buckets)}).join(ids, "id", "left_semi").where(test)
        open_ = [self.held._read(self.name, rest).where(test)] if rest else []
        return reduce(DataFrame.unionByName, [hit, *open_])
