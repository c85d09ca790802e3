"""Operators over a file catalog: path, name, dir, extension, size, mtime, content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import files as K
from ..functions.times import epoch
from ..registry import operator

EXTENSIONS = (".txt", ".py", ".csv", ".pdf", ".jpg", ".zip", ".mp3", ".xyz")


def catalog(docs: DataFrame) -> DataFrame:
    """A catalog made of documents: directory by source, extension by id, an hour of age for each id."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = docs.select("doc_id", F.col("source").alias("dir"), ext.alias("extension"), F.col("n_chars").alias("size"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("mtime"), F.col(
            "text").alias("content"))
    name = F.concat(F.col("doc_id").cast("string"), F.col("extension"))
    return rows.select(F.concat_ws("/", "dir", name).alias("path"), name.alias("name"), "dir", "extension", "size", "mtime", "content", "doc_id")


@operator(category="files")
def scan_filter(files: DataFrame, extensions: list[str] | None = None, min_size: int | None = None, max_size: int | None = None,
    after: str | None = None, before: str | None = None, pattern: str | None = None) -> DataFrame:
    """Files by extension (dot optional), inclusive size and time ranges, and a name glob; bad dates are ignored."""
    tests = []
    if extensions:
        tests.append(F.lower("extension").isin(*[("." + e.lstrip(".")).lower() for e in extensions]))
    if min_size is not None:
        tests.append(F.col("size") >= min_size)
    if max_size is not None:
        tests.append(F.col("size") <= max_size)
    for value, after_ in ((after, True), (before, False)):
        if value is not None:
            limit = F.try_to_timestamp(F.lit(value))
            tests.append(limit.isNull() | ((F.col("mtime") >= limit) if after_ else (F.col("mtime") <= limit)))
    if pattern:
        tests.append(F.col("name").rlike(K.glob(pattern)))
    return reduce(lambda df, t: df.where(t), tests, files)


@operator(category="files")
def scan_stats(files: DataFrame) -> DataFrame:
    """Count, total and mean size, oldest, newest and largest file; ties by path."""
    first = lambda k: F.min_by("path", F.struct(k, "path"))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.floor(F.avg(
                    "size")), F.lit(0)).cast("long").alias("avg_size"), F.min_by("path", F.struct("mtime", "path")).alias("oldest"),
        first((-epoch(F.col("mtime"))).alias("a")).alias("newest"), first((-F.col("size")).alias("a")).alias("largest"))


@operator(category="files")
def scan_sort_limit(files: DataFrame, by: str = "size", descending: bool = True, limit: int = 20) -> DataFrame:
    """The first rows by name, size, modified, type or path; ties by path. A sort with limit keeps ``limit`` rows per task."""
    keys = {"name": F.lower("name"), "size": F.col("size"), "modified": F.col("mtime"), "type": F.struct("extension", "name"), "path": F.lower("path")}
    key = keys.get(by, keys["name"])
    return files.orderBy(key.desc() if descending else key.asc(), "path").limit(limit)


@operator(category="files")
def duplicate_groups(files: DataFrame) -> DataFrame:
    """Contents of several files: digest, count and paths (an array as long as the group)."""
    rows = files.groupBy(F.md5("content").alias("md5")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("path")),
            ",").alias("paths"))
    return rows.where("n > 1")


@operator(category="files")
def flatten_names(files: DataFrame) -> DataFrame:
    """Target names in one folder; equal names get ``_1``, ``_2`` ... in the order of their paths."""
    n = F.row_number().over(Window.partitionBy("target").orderBy("path")) - 1
    rows = files.select("path", F.concat(F.regexp_extract("dir", r"^[^0-9]*", 0), "extension").alias("target")).withColumn("n", n)
    return rows.select("path", F.when(F.col("n") == 0, F.col("target")).otherwise(F.regexp_replace("target", r"(\.[^.]*)\z", F.concat(F.lit(
                    "_"), F.col("n").cast("string"), F.lit("$1")))).alias("target"))


@operator(category="files")
def compare_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names in both, only the first and only the second table."""
    a, b = left.select("name").distinct().withColumn("a", F.lit(True)), right.select("name").distinct().withColumn("b", F.lit(True))
    return a.join(b, "name", "full").select("name", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("side"))


@operator(category="files")
def validate_files(files: DataFrame, extensions: tuple[str, ...] = (".txt", ".csv", ".pdf"), most: int = 5000) -> DataFrame:
    """Ordered errors of each file, and whether it has none."""
    errors = F.filter(F.array(F.when(F.col("size") == 0, "File is empty"), F.when(F.col("size") > most, "File too large"), F.when(~F.lower(
                    "extension").isin(*extensions), "Extension not allowed")), F.isnotnull)
    return files.select("path", F.concat_ws("; ", errors).alias("errors"), (F.size(errors) == 0).alias("valid"))
