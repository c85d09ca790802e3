"""Media columns: AVI motion-JPEG written, parsed, decoded and cut into timed shots.

A text's bytes are the 8-bit samples of 24 x 24 grey frames, kept as lossless JPEGs in a RIFF file
with an index. Any such column of AVI bytes can be read: frames are found through the index,
decoded each by itself, and shots begin where the histograms of consecutive frames differ more than
they do around.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import SIDE, decode_all, encode_lossless
from .words import utf8

FRAME = SIDE * SIDE
FPS = 25
BINS = 32
#: A cut differs by more than the mean of the differences around it plus so many deviations, and by a least share of samples.
DEVIATIONS, LEAST, AROUND = 2.0, 0.25, 8


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """A RIFF AVI file with one motion-JPEG stream and an index of its frames."""
    movi, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file, through its index, and its frames a second.

    Without an index, or with one that points astray, the frames are those in the file's movi list.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, b""

    def walk(at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            size = struct.unpack_from("<I", data, at + 4)[0]
            yield data[at : at + 4], at + 8, min(at + 8 + size, end)
            at += 8 + size + (size & 1)

    todo = [(12, len(data))]
    while todo:
        for name, a, b in walk(*todo.pop(0)):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi = (a, b)
            elif name == b"LIST" and data[a : a + 4] in (b"hdrl", b"strl"):
                todo.append((a + 4, b))
            elif name == b"strh" and data[a : a + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, a + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = data[a:b]
    if movi is None:
        return [], fps
    frames = []
    for name, _, at, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if name[2:] in (b"dc", b"db"):
            for base in (movi[0], 0):  # offsets count from the list's name, or from the file's start
                if data[base + at : base + at + 4] == name:
                    frames.append(data[base + at + 8 : base + at + 8 + size])
                    break
    if not frames:
        frames = [data[a:b] for name, a, b in walk(movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return frames, fps


def shots(pictures: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first frame, one past the last) of each shot.

    The difference of two frames is the share of samples that change their bin of a grey histogram. It is a
    cut if it is at least ``LEAST`` and beyond mean + ``DEVIATIONS`` * deviation of the ``AROUND``
    differences on either side.
    """
    n = len(pictures)
    if n < 2:
        return [(0, n)] if n else []
    grey = [p if p.ndim == 2 else p.mean(axis=2).astype(np.uint8) for p in pictures]
    if len({g.shape for g in grey}) == 1:
        cells = np.stack(grey).reshape(n, -1).astype(np.int64) * BINS // 256 + (np.arange(n) * BINS)[:, None]
        h = np.bincount(cells.ravel(), minlength=n * BINS).reshape(n, BINS) / cells.shape[1]
    else:
        h = np.stack([np.bincount(g.ravel().astype(np.int64) * BINS // 256, minlength=BINS) / g.size for g in grey])
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    m = len(d)
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    lo, hi = np.maximum(np.arange(m) - AROUND, 0), np.minimum(np.arange(m) + AROUND + 1, m)
    count = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - d) / count
    dev = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / count - mean * mean, 0))
    cuts = (np.flatnonzero((d >= LEAST) & (d > mean + DEVIATIONS * dev)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def payload(text: bytes) -> bytes:
    """The bytes with 255 appended up to a positive multiple of a frame's samples."""
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


def pack_bytes(data: bytes) -> bytes:
    """An AVI file whose samples are the payload of ``data``."""
    p = np.frombuffer(payload(data), np.uint8)
    return write_avi(encode_lossless(p.reshape(-1, SIDE, SIDE)))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (AVI bytes) of every document; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(raw)], pa.int64()), pa.array([pack_bytes(raw)],
                            pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, n_frames, start_s and end_s: one row for each shot of each AVI file.

    Rows with null or unreadable media have one row with a null clip and the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    frames, fps = read_avi(batch.column(1)[i].as_py() or b"")
                    rows = [(k, a, b - a, a / fps, b / fps, None) for k, (a, b) in enumerate(shots(decode_all(frames)))]
                except (ValueError, IndexError, KeyError, ZeroDivisionError, OverflowError, struct.error) as e:
                    rows = [(None, None, None, None, None, str(e))]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                    key = pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([key, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", "clip",
                            "first_frame", "n_frames", "start_s", "end_s", "error"])

    schema = "doc_id long, clip long, first_frame long, n_frames long, start_s double, end_s double, error string"
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, schema)


def describe(raw: bytes, media: bytes) -> tuple:
    """The digest columns of one stored file; everything but n_bytes is taken from the stored bytes."""
    frames, fps = read_avi(media)
    pictures = decode_all(frames)
    back = np.stack(pictures).tobytes() if pictures else b""
    cut = shots(pictures)
    level = np.frombuffer(back, np.uint8).mean() if back else 0.0
    feature = f"frames={len(pictures)} level={level:.4f} shots={len(cut)} at=" + ",".join(f"{a / fps:.2f}" for a, _ in cut)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    Every text is stored as an AVI file, the file is parsed and decoded, and what it gives back is
    described. Null and empty texts are one frame of 255. Texts are handled one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            rows = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                raw = data[a:b].tobytes()
                rows.append(describe(raw, pack_bytes(raw)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
