"""Where output files go: kept folders, one folder, or a folder for each category, with numbers for equal names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import files as K
from ..registry import operator
from ..storage import Scratch

#: The folder of each structure below the output root.
FOLDERS = {"maintained": "maintained_structure", "flattened": "flattened_structure", "categorized": "categorized_structure"}


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (path, target) with n, the rank of the path among those of its target (from 0); rows are dealt into ranges, so a very common name is many tasks' work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.keep(rows.repartitionByRange(parts, "target", "path").withColumn("_range", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("target", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("target").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col("target").alias("_t"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("target", "_range").orderBy("path")) - 1
    ranked = ranged.withColumn("_own", own)
    return ranked.join(held, (F.col("target") == F.col("_t")) & (F.col("_range") == F.col("_r"))).select(*rows.columns, (F.col("_own") + F.col("_before")).alias("n"))


def _stem(name: Column) -> Column:
    """A name without its extension; a dot at the begin is no extension's."""
    return F.regexp_extract(name, r"(?s)\A(.+?)(\.[^./]*)?\z", 1)


@operator(category="files")
def output_targets(files: DataFrame, structure: str = "maintained", source_root: str = "", stamp: str = "") -> DataFrame:
    """path and target (relative to the output root) of files (path), in a structure's folder below ``stamp``, a time that the caller sets.

    ``maintained`` keeps the folders below ``source_root`` (files elsewhere go to the top), ``flattened`` has one
    folder, ``categorized`` one for each category of the extension. In the last two the first path of a name keeps it and the
    others get ``_1``, ``_2``, ..., without the numbers that other files' own names have. Paths are distinct; null paths are left out.
    """
    if structure not in FOLDERS:
        raise ValueError(f"structures are {', '.join(FOLDERS)}")
    top = "/".join(p for p in (FOLDERS[structure], stamp) if p) + "/"
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path").where("path is not null")
    if structure == "maintained":
        root = source_root.rstrip("/") + "/"
        inner = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(name) if source_root else F.col("path")
        return rows.select("path", F.concat(F.lit(top), F.regexp_replace(inner, r"\A/+", "")).alias("target"))
    extension = F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^./]*)\z", 1))
    folder = F.lit("") if structure == "flattened" else F.concat(K.category(extension, default="other"), F.lit("/"))
    scratch = Scratch(files.sparkSession, "layout")
    named = scratch.keep(rows.select("path", F.concat(folder, name).alias("target")), "named")
    ranked = scratch.keep(_numbered(named, scratch), "ranked")
    again = ranked.where("n > 0")
    # names that look like another's with a number take that number, if that other has to be numbered at all
    own = named.select("target").distinct()
    place = F.regexp_extract("target", r"(?s)\A(.*/)?", 0)
    last = F.substring(F.col("target"), F.length(place) + 1, F.lit(1 << 30))
    looks = own.select(F.concat(place, F.regexp_extract(_stem(last), r"(?s)\A(.*)_[1-9][0-9]{0,17}\z", 1), F.regexp_extract(last, r"(?s)\A.+?(\.[^./]*)?\z", 1)).alias("_base"),
        F.regexp_extract(_stem(last), r"_([1-9][0-9]{0,17})\z", 1).alias("_k")).where("_k <> ''").select("_base", F.col("_k").cast("long").alias("_k"))
    taken = looks.join(again.groupBy("target").agg(F.max("n").alias("_most")), F.col("_base") == F.col("target"), "left_semi")
    # the i-th smallest taken number k moves every rank from k - i + 1 on by one
    rank = F.row_number().over(Window.partitionBy("_base").orderBy("_k"))
    shift = taken.withColumn("_from", F.col("_k") - rank + 1).groupBy("_base", "_from").agg(F.count(F.lit(1)).alias("_more"))
    total = F.sum("_more").over(Window.partitionBy("_base").orderBy("_from"))
    until = F.coalesce(F.lead("_from").over(Window.partitionBy("_base").orderBy("_from")) - 1, F.lit((1 << 62)))
    steps = scratch.keep(shift.select("_base", "_from", until.alias("_until"), total.alias("_shift")), "steps")
    moved = again.join(steps, (F.col("target") == F.col("_base")) & F.col("n").between(F.col("_from"), F.col("_until")), "left")
    number = (F.col("n") + F.coalesce("_shift", F.lit(0))).cast("string")
    new = F.concat(place, _stem(last), F.lit("_"), number, F.regexp_extract(last, r"(?s)\A.+?(\.[^./]*)?\z", 1))
    out = ranked.where("n = 0").select("path", "target").unionByName(moved.select("path", new.alias("target")))
    return out.select("path", F.concat(F.lit(top), "target").alias("target"))
