"""Readers of text files: encodings, delimited files as text, directories by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, name, extension, size, mtime and content of files; bytes that are not UTF-8 are read as Latin-1."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = rows.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), F.col("length")
        .alias("size"), F.col("modificationTime").alias("mtime"), text.alias("content"))
    return rows.where(F.col("extension").isin(*["." + e.lower().lstrip(".") for e in extensions])) if extensions else rows


def read_delimited_as_text(spark: SparkSession, path: str, sep: str = ",", joiner: str = " | ") -> DataFrame:
    """Each row of a CSV or TSV file as one line of text."""
    rows = spark.read.csv(path, header=True, sep=sep, mode="DROPMALFORMED")
    return rows.select(F.concat_ws(joiner, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns]).alias("text"))
