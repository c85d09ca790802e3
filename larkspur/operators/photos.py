"""EXIF data of JPEG and TIFF files, and the photographer's view of it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..registry import operator

#: Fixed values of the format: tags that are read, and the sizes of the types of values.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal",
    0x9209: "Flash", 0x920A: "FocalLength", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: What the fields are called in the result.
NAMES = {"Make": "camera_make", "Model": "camera_model", "LensModel": "lens_model", "LensMake": "lens_make", "ExposureTime":
    "exposure_time", "FNumber": "aperture", "ISOSpeedRatings": "iso", "FocalLength": "focal_length", "Flash": "flash_fired", "DateTime":
    "capture_date", "DateTimeOriginal": "capture_date_original", "GPSLatitude": "gpslatitude", "GPSLongitude": "gpslongitude",
    "GPSAltitude": "gpsaltitude",}


def tiff_block(data: bytes) -> bytes:
    """The TIFF structure of a file: all of a TIFF, the EXIF segment of a JPEG, else nothing."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def _values(block: bytes, order: str, kind: int, n: int, raw: bytes) -> str:
    size = SIZES.get(kind, 0) * n
    if size > 4:
        at = struct.unpack(order + "I", raw)[0]
        raw = block[at : at + size]
    if kind in (2, 7):
        return raw[:n].split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        pairs = struct.iter_unpack(order + ("II" if kind == 5 else "ii"), raw[:size])
        return ",".join(f"{a / b:g}" if b else "0" for a, b in pairs)
    form = {1: "B", 3: "H", 4: "I", 9: "i"}[kind]
    return ",".join(map(str, struct.unpack(order + form * n, raw[:size])))


def exif(data: bytes) -> dict[str, str]:
    """The known tags of a file's main, photo and position directories; lists are joined by commas."""
    block = tiff_block(data)
    if len(block) < 8:
        return {}
    order = "<" if block[:2] == b"II" else ">"
    todo, out, seen = [(struct.unpack(order + "I", block[4:8])[0], TAGS)], {}, set()
    while todo:
        at, known = todo.pop()
        if at in seen or at + 2 > len(block):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", block[at : at + 2])[0]):
            entry = block[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            if tag in (0x8769, 0x8825):
                todo.append((struct.unpack(order + "I", entry[8:])[0], TAGS if tag == 0x8769 else GPS))
            elif tag in known and kind in SIZES and SIZES[kind] * n <= len(block):
                out[known[tag]] = _values(block, order, kind, n, entry[8:])
    return out


@operator(category="images")
def photo_info(files: DataFrame) -> DataFrame:
    """path, info (the fields of ``NAMES`` that a file has) and error of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                info, error = {}, None
                try:
                    found = exif(batch.column(1)[i].as_py() or b"")
                    info = {NAMES[k]: v for k, v in found.items() if k in NAMES}
                except (struct.error, KeyError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([list(info.items())], pa.map_(pa.string(),
                                pa.string())), pa.array([error], pa.string())], ["path", "info", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, info map<string,string>, error string")
