"""Batches: functions over rows with their errors, plans of conversions, lists of files, paging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import files as K
from ..functions.times import epoch
from ..registry import operator


def batch_map(rows: DataFrame, fn: Callable, column: str, result: str = "string", mode: str = "parallel") -> DataFrame:
    """The rows with status (success or failed), result and error of ``fn`` on each value of ``column``.

    An error is the row's, and the batch goes on. ``parallel`` and ``threaded`` run on all cores that the
    table's partitions give, ``serial`` in one task in the table's order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if mode not in ("parallel", "threaded", "serial"):
        raise ValueError("modes are parallel, threaded and serial")
    more = StructType.fromDDL(f"status string, result {result}, error string")
    schema = StructType([*rows.schema.fields, *more.fields])
    kinds = [f.type for f in to_arrow_schema(more)]
    at = rows.columns.index(column)

    def one(value) -> tuple:
        try:
            return "success", fn(value), None
        except Exception as e:  # whatever the function raises is the row's error
            return "failed", None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(v) for v in batch.column(at).to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(zip(*got), kinds)]], schema.names)

    return (rows.coalesce(1) if mode == "serial" else rows).mapInArrow(run, schema)


def batch_counts(results: DataFrame, most: int = 1000) -> DataFrame:
    """processed, successful, failed and the first ``most`` errors' messages in order, of ``batch_map``'s rows.

    A sort with a limit brings ``most`` messages of a task at most to the one row.
    """
    failed = F.col("status") == "failed"
    counts = results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"))
    first = results.where(failed & F.col("error").isNotNull()).select("error").orderBy("error").limit(most)
    listed = first.agg(F.array_sort(F.collect_list("error")).alias("errors"))
    return counts.join(F.broadcast(listed), how="cross")  # a row each


@operator(category="files")
def conversion_plan(files: DataFrame, root: str, target: str, out: str, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """path, output, tool and action of converting files (path, extension) below ``root`` to ``target``.

    Relative folders are kept below ``out``. The first tool that converts the pair is taken. An output in
    ``existing`` (path) is skipped unless ``overwrite``; without a tool a file is unsupported.
    """
    inner = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)).otherwise(
        F.element_at(F.split("path", "/"), -1))
    extension = F.lower("extension")
    stem = F.expr("substring(_inner, 1, length(_inner) - length(extension))")
    tool = F.lit(None).cast("string")
    for source, to, name in reversed(K.TOOLS):
        if to.lstrip(".") == target.lstrip("."):
            tool = F.when(extension == ("." + source.lstrip(".")), name).otherwise(tool)
    rows = files.withColumn("_inner", inner).select("path", F.concat(F.lit(out.rstrip("/") + "/"), stem, F.lit("." + target.lstrip(".")))
        .alias("output"), tool.alias("tool"))
    if existing is not None and not overwrite:
        there = existing.select(F.col("path").alias("output"), F.lit(True).alias("_there")).distinct()
        rows = rows.join(there, "output", "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("boolean"))
    action = F.when(F.col("tool").isNull(), "unsupported").when(F.col("_there"), "skip").otherwise("convert")
    return rows.select("path", "output", "tool", action.alias("action"))


@operator(category="files")
def distinct_files(files: DataFrame) -> DataFrame:
    """Each path once, in order."""
    return files.select("path").distinct().orderBy("path")


def page_of(rows: DataFrame, order: list[str | Column], page: int, size: int) -> DataFrame:
    """Rows page * size up to (page + 1) * size in the given order, which must be total; a top-k, not a sort of all."""
    return rows.orderBy(*order).offset(page * size).limit(size)


@operator(category="files")
def file_list_check(files: DataFrame, allowed: list[str]) -> DataFrame:
    """How many files (path, extension, size) are valid, missing (null size) or not allowed, and the first path of each."""
    why = F.when(F.col("size").isNull(), "missing").when(~F.col("extension").isin(*allowed), "invalid: extension not allowed").otherwise("valid")
    return files.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@operator(category="files")
def security_report(files: DataFrame, expected: list[str]) -> DataFrame:
    """writable (for others than the owner's group, from ``mode``) and suspicious (an executable type with an unexpected extension) of each file."""
    suspicious = F.col("mime").contains("executable") & ~F.col("extension").isin(*expected)
    return files.select("path", (F.shiftright("mode", 7).bitwiseAND(F.lit(1)) == 1).alias("writable"), suspicious.alias("suspicious"))


@operator(category="files")
def category_schemes(files: DataFrame) -> DataFrame:
    """The category of each file under the scanner's, the record's and the detector's scheme."""
    schemes = {"scanned": (K.SCANNED, "other"), "recorded": (K.RECORDED, "unknown"), "detected": (K.DETECTED, "other")}
    return files.select("path", *[K.category(F.col("extension"), s, d).alias(n) for n, (s, d) in schemes.items()])


@operator(category="files")
def code_language(files: DataFrame) -> DataFrame:
    """The programming language of each file by its extension, else text."""
    return files.select("path", K.lookup(F.lower("extension"), K.LANGUAGES, "text").alias("language"))


@operator(category="system")
def process_filter(processes: DataFrame, part: str, most: int = 50, name: str = "name", key: str = "pid") -> DataFrame:
    """The first ``most`` processes, by key, whose name holds ``part`` whatever the case; % and _ are wildcards."""
    return processes.where(F.col(name).ilike(f"%{part}%")).orderBy(key).limit(most)


@operator(category="system")
def by_usage(devices: DataFrame, used: str = "used", name: str = "device") -> DataFrame:
    """Devices from the fullest down, ties by name."""
    return devices.orderBy(F.desc(used), name)


@operator(category="system")
def port_states(probes: DataFrame, key: str = "host", seconds: str = "value", fast: float = 10, slow: float = 30) -> DataFrame:
    """Open, closed and filtered ports of each host, by how soon a probe was answered."""
    t = F.col(seconds)
    return probes.groupBy(key).agg(F.count_if(t < fast).alias("n_open"), F.count_if((t >= fast) & (t < slow)).alias("n_closed"),
        F.count_if(t >= slow).alias("n_filtered"))


@operator(category="workflow")
def latest_execution(runs: DataFrame, key: str, kind: str, t: str, tie: str) -> DataFrame:
    """The last run's kind and time for each key, ties by ``tie``; combined before the shuffle."""
    return runs.groupBy(key).agg(F.max_by(kind, F.struct(t, tie)).alias("last_type"), F.max(t).alias("last_s"))


@operator(category="workflow")
def distinct_values(rows: DataFrame, group: str, value: str, name: str = "n") -> DataFrame:
    """How many different values each group has."""
    return rows.groupBy(group).agg(F.countDistinct(value).alias(name))


@operator(category="system")
def iso_times(rows: DataFrame, at: str, key: str, since: int = 1704067200) -> DataFrame:
    """A time as ISO text, and whole seconds since an epoch second (the start of 2024)."""
    return rows.select(key, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (epoch(F.date_trunc("second", at)) - since).alias("since_s"))


@operator(category="files")
def docx_check(files: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """path, valid and the first error of files (path, size, present) that are to be converted from DOCX. The messages are fixed values."""
    error = (
        F.when(~F.coalesce("present", F.lit(False)), F.concat(F.lit("Input file not found: "), "path"))
        .when(~F.lower("path").endswith(".docx"), "Input file must be a .docx file")
        .when(F.col("size").isNull(), "Cannot access input file")
        .when(F.col("size") == 0, "Input file is empty")
        .when(F.col("size") > most_bytes, f"Input file too large (max {most_bytes >> 20}MB)")
    )
    return files.select("path", error.isNull().alias("valid"), error.alias("error"))
