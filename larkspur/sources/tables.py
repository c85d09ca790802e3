"""Delimited files as rows of cells, with a ladder of encodings, and what a conversion of them says."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import per, rnd
from .splits import SPLIT, read_split

#: Encodings in the order in which they are tried after the given one.
ENCODINGS = ("utf-8", "latin-1", "cp1252", "iso-8859-1")


def decode(data: bytes, encoding: str = "utf-8") -> tuple[str, str]:
    """The text and the first encoding that reads it; a byte order mark is dropped."""
    for name in dict.fromkeys((encoding, *ENCODINGS)):
        try:
            return data.decode("utf-8-sig" if name == "utf-8" else name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore"), "unknown"


def guess_encoding(head: bytes) -> str:
    """ascii, utf-8 (also where the head ends within a character), a byte order mark's encoding, or unknown."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    if head.isascii():
        return "ascii"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # the last character may be cut off
        return "utf-8"
    except UnicodeDecodeError:
        return "unknown"


def cells(text: str, sep: str = ",") -> Iterator[list[str | None]]:
    """The rows of a file: blank lines are rows of nulls, rows with more cells than the first are left out, shorter ones are filled up."""
    width = None
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
        if width is None:
            width = len(row) or None
        if width and len(row) <= width:
            yield [c if c != "" else None for c in row] + [None] * (width - len(row))


def read_csv(spark: SparkSession, paths: str | list[str], sep: str = ",", header: bool = True, encoding: str = "utf-8", recursive: bool = True,
    split: int = SPLIT) -> DataFrame:
    """path, encoding, line (from 0), names and cells of each row of the files.

    With ``header`` the first row gives the names; else they are numbers from 0. Files are read in ranges of ``split`` bytes, also where quoted cells hold line
    ends; only an ``encoding`` that doesn't hold ASCII as it is makes a file one task's. Empty files have no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    if '",\n'.encode(encoding) == b'",\n':
        return read_split(spark, files.select("path", F.col("length").alias("size")), tuple(dict.fromkeys((encoding, *ENCODINGS))), sep, header, split)
    files = files.select("path", "content")
    kinds = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("line", pa.int64()), ("names", pa.list_(pa.string())), ("cells",
                pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                text, used = decode(batch.column(1)[i].as_py(), encoding)
                rows = cells(text, sep)
                names = next(rows, None) if header else None
                names = [c or f"Unnamed: {j}" for j, c in enumerate(names)] if names else None
                held = [(path, used, line, names or list(map(str, range(len(row)))), row) for line, row in enumerate(rows)]
                for lo in range(0, len(held), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held[lo : lo + 4096]), kinds)], schema=kinds)

    return files.mapInArrow(run, "path string, encoding string, line long, names array<string>, cells array<string>")


def size_change(before: Column, after: Column) -> Column:
    """The change of a size in percent; 0 where there was none."""
    return rnd(per((after - before) * F.lit(100.0), before), 2)


def conversion_stats(rows: DataFrame) -> DataFrame:
    """rows, columns and change_percent for each input (path, names, cells) with input_size and output_size."""
    out = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("names")).cast("long").alias("columns"), F.max(
            "input_size").alias("input_size"), F.max("output_size").alias("output_size"))
    return out.withColumn("change_percent", size_change(F.col("input_size"), F.col("output_size")))
