"""Documents of many formats as texts and chunks: a reader for each extension, which users may add to.

A reader is a function from a file's bytes to its text. Files are read by Spark's binary source and
decoded in Arrow batches on the executors, a file at a time; one that its reader can't read has no text.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ingest_clean
from ..operators.text import chunk_smart
from .html import parse
from .office import pdf_text

_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def plain(data: bytes) -> str:
    """UTF-8, else Latin-1, which any bytes are."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def delimited(sep: str) -> Callable[[bytes], str]:
    """Header and rows, a line each, cells joined by `` | ``."""
    return lambda data: "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(plain(data)), delimiter=sep) if row)


def json_lines(data: bytes) -> str:
    """A line ``key: inner[0]: value`` for each leaf, in document order; empty objects and lists have none."""
    lines, todo = [], [("", json.loads(plain(data)))]
    while todo:
        at, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{at}: {k}" if at else k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
        else:
            lines.append(f"{at}: {node}")
    return "\n".join(lines)


def docx(data: bytes) -> str:
    """Paragraphs of the body that are not blank, then the rows of its tables, cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_DOCX}body")

    def text(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_DOCX}t"))

    lines = [text(p) for p in body.findall(f"{_DOCX}p")]
    for row in (r for t in body.findall(f"{_DOCX}tbl") for r in t.findall(f"{_DOCX}tr")):
        cells = ["\n".join(text(p) for p in c.findall(f"{_DOCX}p")) for c in row.findall(f"{_DOCX}tc")]
        lines.append(" | ".join(c for c in cells if c.strip()))
    return "\n".join(x for x in lines if x.strip())


def web(data: bytes) -> str:
    return parse(None, "", plain(data))["text"]


READERS: dict[str, Callable[[bytes], str]] = {".csv": delimited(","), ".tsv": delimited("\t"), ".json": json_lines, ".html": web,
    ".htm": web, ".docx": docx, ".pdf": pdf_text}


def register_reader(extension: str, reader: Callable[[bytes], str]) -> None:
    """Add or replace the reader of an extension (dot optional, case ignored); others are read as plain text."""
    READERS["." + extension.lower().lstrip(".")] = reader


def read_documents(spark: SparkSession, paths: str | list[str], extensions: list[str] | None = None, recursive: bool = True,
    most_bytes: int = 50 << 20) -> DataFrame:
    """path, text and error of all files; larger files than ``most_bytes`` have an error and are not decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    if extensions:
        files = files.where(extension.isin(*["." + e.lower().lstrip(".") for e in extensions]))
    readers = dict(READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, ext, content = (c[i].as_py() for c in batch.columns)
                text = error = None
                if content is None:
                    error = "file too large"
                else:
                    try:
                        text = readers.get(ext, plain)(content)
                    except Exception as e:  # whatever a user's reader raises is the file's error
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (path, text, error)], ["path", "text", "error"])

    return files.select("path", extension.alias("extension"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content")).mapInArrow(
        run, "path string, text string, error string")


def ingest(docs: DataFrame, size: int = 800, overlap: int = 100, least: int = 50) -> DataFrame:
    """Clean chunks of documents (path, text): columns of ``chunk_smart`` with ``path`` as the id. Blank texts have none."""
    rows = docs.select(F.col("path").alias("doc_id"), ingest_clean(F.col("text")).alias("text")).where("text <> ''")
    return chunk_smart(rows, size, overlap, least).withColumnRenamed("doc_id", "path")
