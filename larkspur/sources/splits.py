"""Delimited files of any size: byte ranges that are read by tasks of their own, cut where rows begin.

A range begins after the first line end at or behind its first byte. There a row begins, or a quoted cell
goes on; which of the two, the ranges before decide. So each range is looked at under both, which gives its
rows and its last state for each, and a walk over a file's ranges, one row for each, chooses. The task
that reads a range reads on behind it until its last row is whole.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch

#: Bytes that one task reads, about, and those that are read at a time to find a line's or a row's end.
SPLIT, STEP = 64 << 20, 1 << 16
_END = "\x00row begins\x00"
#: A cell may be as long as a range, which the parser's own limit would refuse.
_LIMIT = (1 << 31) - 1


class Part:
    """Bytes of a file."""

    def __init__(self, path: str, size: int):
        where = path if "://" in path else path.replace("file:/", "file:///", 1)
        self.fs, name = pafs.FileSystem.from_uri(where)
        self.file, self.size = self.fs.open_input_file(name), size

    def bytes(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(end, self.size) - start))

    def begin(self, at: int) -> int:
        """The first place at or behind ``at`` that follows a line end (or is the file's begin or end)."""
        if at <= 0:
            return 0
        at -= 1
        while at < self.size:
            some = self.bytes(at, at + STEP)
            if (found := some.find(b"\n")) >= 0:
                return at + found + 1
            at += len(some)
        return self.size


def table(text: str, sep: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))


def looked_at(text: str, sep: str, quoted: bool) -> tuple[list[list[str]], bool]:
    """The rows of a range, and whether it ends within a quoted cell; ``quoted`` if it begins in one, whose row is then the first."""
    if not text:
        return [], quoted
    body = ('"' if quoted else "") + text
    rows = table(body + ("" if text[-1] in "\r\n" else "\n") + _END, sep)
    return (rows[:-1], False) if rows[-1] == [_END] else (table(body, sep), True)


def whole_rows(part: Part, start: int, end: int, sep: str, quoted: bool, decode) -> list[list[str]]:
    """The rows that begin in a range; what goes on from before is left out, what goes on behind is read to its end."""
    rows, within = looked_at(decode(part.bytes(start, end)), sep, quoted)
    n, stop = len(rows) - quoted, end
    while within and stop < part.size and n > 0:
        stop = part.begin(stop + max(STEP, stop - end))
        rows, within = looked_at(decode(part.bytes(start, stop)), sep, quoted)
        within = within and len(rows) - quoted <= n
    return rows[quoted : n + quoted] if n > 0 else []


def plain(data: bytes) -> str:
    """Bytes as letters, to find rows: quotes, separators and line ends are ASCII in every encoding of the ladder."""
    return data.decode("latin-1")


def reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def first_row(text: str, sep: str) -> tuple[list[str] | None, int, int]:
    """The first row that isn't blank, and where it begins and ends."""
    at = 0

    def lines() -> Iterator[str]:
        nonlocal at
        for line in io.StringIO(text, newline=""):
            at += len(line)
            yield line

    begin = 0
    for row in csv.reader(lines(), delimiter=sep):
        if row:
            return row, begin, at
        begin = at
    return None, at, at


def read_split(spark: SparkSession, files: DataFrame, ladder: tuple[str, ...], sep: str, header: bool, split: int = SPLIT) -> DataFrame:
    """path, encoding, line, names and cells of the rows of files (path, size), each range by a task of its own.

    ``ladder`` are encodings that hold ASCII as it is; a file has the first that reads all its ranges. Rows
    with more cells than the first are left out, shorter ones filled up, blank lines are rows of nulls but
    for those before the first row.
    """
    scratch = Scratch(spark, "csv")
    heads = scratch.keep(files.where("size > 0").repartition("path").mapInArrow(_heads(sep, header, ladder), "path string, size long, first array<string>, low long, reads array<boolean>"), "heads")
    body = F.greatest(F.ceil((F.col("size") - F.col("low")) / F.lit(split)).cast("long"), F.lit(1))
    parts = heads.where("first is not null").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), body - 1)))
    at = F.col("low") + F.col("i") * split
    parts = parts.select("path", "size", "i", F.when(F.col("i") == 0, -F.col("low") - 1).otherwise(at).alias("from"), (at + split).alias("to"), "first").repartition("path", "i")
    seen = scratch.keep(parts.mapInArrow(_seen(sep, ladder),
        "path string, size long, i long, start long, end long, first array<string>, n0 long, w0 boolean, n1 long, w1 boolean, reads array<boolean>"), "seen")
    good = seen.select("path", "reads").unionByName(heads.select("path", "reads")).groupBy("path").agg(*[F.bool_and(F.col("reads")[i]).alias(f"_{i}") for i in range(len(ladder))])
    chosen = F.coalesce(*[F.when(F.col(f"_{i}"), F.lit(e)) for i, e in enumerate(ladder)])
    states = seen.drop("reads").repartition("path").sortWithinPartitions("path", "i").mapInArrow(
        _states, "path string, size long, i long, start long, end long, first array<string>, line long, quoted boolean")
    ready = scratch.keep(states.join(good.select("path", chosen.alias("encoding")), "path"), "states")
    return ready.repartition("path", "i").select("path", "size", "start", "end", "first", "line", "quoted", "encoding").mapInArrow(
        _rows(sep, header), "path string, encoding string, line long, names array<string>, cells array<string>")


def _heads(sep: str, header: bool, ladder: tuple[str, ...]):
    """The first row of each file that isn't blank, where the rows behind it (with ``header``) or from it on begin, and which encodings read what is before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(_LIMIT)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                part = Part(path, size)
                mark = 3 if part.bytes(0, 3) == codecs.BOM_UTF8 else 0
                end, row = mark, None
                while row is None and end < size:
                    end = part.begin(max(2 * end, STEP))
                    text = plain(part.bytes(mark, end))
                    if looked_at(text, sep, False)[1] and end < size and len(table(text, sep)) == 1:
                        continue  # the first row goes on
                    row, begin, stop = first_row(text, sep)
                low = mark + (stop if header else begin) if row else size
                ok = [reads(part.bytes(mark, low), e) for e in ladder]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([row], pa.list_(pa.string())), pa.array([low], pa.int64()), pa.array([ok], pa.list_(pa.bool_()))],
                    ["path", "size", "first", "low", "reads"])

    return run


def _seen(sep: str, ladder: tuple[str, ...]):
    """What a range holds if it begins with a row (n0 rows, w0: ends within quotes) or in quotes (n1, w1), and which encodings read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(_LIMIT)
        names = ["path", "size", "i", "start", "end", "first", "n0", "w0", "n1", "w1", "reads"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(pa.bool_())]
        for batch in batches:
            for path, size, i, from_, to, first in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                part = Part(path, size)
                start, end = (-from_ - 1 if from_ < 0 else part.begin(from_)), part.begin(to)
                start, end = min(start, size), max(min(start, size), end)
                data, found = part.bytes(start, end), []
                for quoted in (False, True):
                    within = looked_at(plain(data), sep, quoted)[1]
                    found += [sum(len(r) <= len(first) for r in whole_rows(part, start, end, sep, quoted, plain)), within]
                values = (path, size, i, start, end, first, *found, [reads(data, e) for e in ladder])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line's number of each range, and whether it begins within quotes; a file's ranges come in order."""
    now, line, quoted = None, 0, False
    for batch in batches:
        lines, states = [], []
        for path, n0, w0, n1, w1 in zip(*[batch.column(c).to_pylist() for c in (0, 6, 7, 8, 9)]):
            if path != now:
                now, line, quoted = path, 0, False
            lines.append(line)
            states.append(quoted)
            line, quoted = (line + n1, w1) if quoted else (line + n0, w0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(lines, pa.int64()), pa.array(states, pa.bool_())],
            ["path", "size", "i", "start", "end", "first", "line", "quoted"])


def _rows(sep: str, header: bool):
    kinds = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("line", pa.int64()), ("names", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(_LIMIT)
        for batch in batches:
            for path, size, start, end, first, line, quoted, encoding in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                width = len(first)
                names = [c.encode("latin-1").decode(encoding) or f"Unnamed: {j}" for j, c in enumerate(first)] if header else list(map(str, range(width)))
                rows = whole_rows(Part(path, size), start, end, sep, quoted, lambda data: data.decode(encoding))  # noqa: B023
                kept = [r for r in rows if len(r) <= width]
                for lo in range(0, len(kept), 4096):
                    held = [(path, encoding, line + lo + k, names, [c if c != "" else None for c in r] + [None] * (width - len(r))) for k, r in enumerate(kept[lo : lo + 4096])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)

    return run
