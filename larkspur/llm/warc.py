"""Web archives: Zstandard-compressed WARC files with a dictionary of their own.

Each file's dictionary is built from the records that it holds and is embedded in a skippable frame at
its start; every record is one frame. Files are written by tasks to shared storage under names of their
own; a table that Spark commits lists those that count, so retried tasks do no harm.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .joins import sized_join
from .memory import give_back

#: Bytes of records that a task gathers for one file, and so its memory; a larger record is a file.
FILE_BYTES = 8 << 20
#: Files that a task reads back, where there are more than enough for all cores.
FILES_PER_TASK = 4
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Fixed values of the format: the frame that holds a dictionary, and the start of a trained dictionary.
SKIPPABLE = 0x184D2A5D
TRAINED = b"\x37\xa4\x30\xec"
_DATE = "2024-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return pafs.FileSystem.from_uri(uri)


def header(fields: list[tuple[str, str]]) -> bytes:
    """The head of a record; control characters in values are percent-encoded."""
    safe = [(k, re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)) for k, v in fields]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in safe) + "\r\n").encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record that refers to another's."""
    revisit = refers_to is not None
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("WARC-Payload-Length", str(len(html))),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return header(fields) + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on all records; too few to train on are themselves the dictionary."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 16))
    try:
        # d and k fix the training's segments, so that it takes one pass over the records
        return zstandard.train_dictionary(size, records, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:4096] for r in records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def make_archive(records: list[bytes]) -> bytes:
    """A file: the dictionary in a skippable frame, then a frame for each record."""
    d = dictionary(records)
    raw = d.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(compressor.compress, records)])


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file, one record in memory at a time."""
    lead = stream.read(8)
    magic, size = struct.unpack("<II", lead)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    held = b""
    engine = zstandard.ZstdDecompressor(dict_data=d)
    while True:
        frame = engine.decompressobj()
        out = []
        while not frame.eof:
            if not held:
                held = stream.read(1 << 16)
                if not held:
                    break
            out.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        if not frame.eof:
            if any(out):
                raise ValueError("a record is cut off")
            return
        whole = b"".join(out)
        head, _, rest = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) to files in ``folder``; path, records and bytes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        held, size, n = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, n
            name = f"part-{base}-{n:05d}.warc.zst"
            data = make_archive(held)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)],
                        pa.int64())], ["path", "records", "bytes"])
            held, size, n = [], 0, n + 1
            return row

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*batch.columns):
                body = html.as_py()
                body = b"" if body is None else body.encode()
                record = make_record(page_id.as_py(), url.as_py(), body, digest.as_py(), refers.as_py())
                if held and size + len(record) > file_bytes:
                    yield flush()
                held.append(record)
                size += len(record)
        if held:
            yield flush()
        give_back()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "digest", "refers_to")
    return rows.mapInArrow(run, "path string, records long, bytes long")


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of the files ``path``.

    A response's length and digest are those of the payload that was read; a digest that differs from
    the record's own is an error.
    """

    def number(uri: str) -> int | None:
        tail = uri.rstrip(">").rpartition(":")[2]
        return None if tail == "null" else int(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, block in read_archive(stream):
                        said = fields["WARC-Payload-Digest"].partition(":")[2]
                        if fields["WARC-Type"] == "revisit":
                            rows.append((number(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), said, "revisit",
                                    number(fields["WARC-Refers-To"])))
                            continue
                        body = block.partition(b"\r\n\r\n")[2]
                        if (digest := hashlib.sha256(body).hexdigest()) != said:
                            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append((number(fields["WARC-Record-ID"]), len(body), digest, "response", None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes",
                            "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path").mapInArrow(run, schema)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with their payload's digest and the page_id that they revisit (null for responses).

    Of equal payloads of at least 100 bytes the smallest page_id responds. Rows with that page_id are
    all responses; null page_ids revisit it, and respond if the group has no other. Only digests that
    occur more than once are joined, and payloads are not shuffled while those are few.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumns({"digest": F.sha2(body, 256), "_long": F.length(body) >= REVISIT_BYTES})
    own = F.col("page_id").cast("long")
    first = rows.where("_long").groupBy("digest").agg(F.min(own).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1 and _first is not null").select(F.col("digest").alias("_digest"), "_first")
    first = Scratch(pages.sparkSession, "warc").keep(first, "first")
    rows = sized_join(rows, first, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~own.eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archive every page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per page, repeated rows included; null html is an empty payload, and equal payloads under
    100 bytes are all responses. An empty table makes no archive.
    """
    scratch = Scratch(pages.sparkSession, "archives")
    files = scratch.keep(write_archives(with_revisits(pages), f"{scratch.path}/files"), "manifest")
    n, cores = files.count(), pages.sparkSession.sparkContext.defaultParallelism
    return read_archives(files.repartition(max(1, min(n, max(2 * cores, -(-n // FILES_PER_TASK))))))
