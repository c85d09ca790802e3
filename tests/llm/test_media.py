"""Stored media, features and clips against their definitions; baseline JPEG frames from an encoder of the tests' own."""

import hashlib
import struct

import numpy as np
import pytest

from larkspur.llm import jpeg, media


def zigzag():
    out, r, c, up = [], 0, 0, True
    for _ in range(64):
        out.append(r * 8 + c)
        if up:
            r, c, up = (r, c + 1, False) if r == 0 and c < 7 else (r + 1, c, False) if c == 7 else (r - 1, c + 1, True)
        else:
            r, c, up = (r + 1, c, True) if c == 0 and r < 7 else (r, c + 1, True) if r == 7 else (r + 1, c - 1, False)
    return out


def cosine(block):
    out = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            s = sum(block[x][y] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for x in range(8) for y in range(8))
            out[u, v] = s / 4 * (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1)
    return out


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        if n:
            self.bits += format(value, f"0{n}b")

    def amplitude(self, v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    def done(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def encode(planes, factors, size, restart=0):
    """A baseline file of component planes of whole units, all coefficients unscaled; 4 bits a DC and 8 or 9 an AC symbol."""
    h, w = size
    dc = {s: (format(s, "04b")) for s in range(12)}
    ac = {s: format(s, "08b") if s < 255 else "111111110" for s in range(256)}
    units = [(y, x) for y in range(-(-h // (8 * factors[0][1]))) for x in range(-(-w // (8 * factors[0][0])))]
    out, wr, scan = [0] * len(planes), Writer(), b""
    for i, (uy, ux) in enumerate(units):
        if restart and i and i % restart == 0:
            scan += wr.done() + bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            out = [0] * len(planes)
        for c, (plane, (fh, fv)) in enumerate(zip(planes, factors)):
            for by in range(fv):
                for bx in range(fh):
                    y, x = (uy * fv + by) * 8, (ux * fh + bx) * 8
                    q = np.rint(cosine(plane[y : y + 8, x : x + 8].astype(float) - 128)).astype(int).ravel()[zigzag()]
                    n, bits = wr.amplitude(int(q[0]) - out[c])
                    out[c] = int(q[0])
                    wr.bits += dc[n]
                    wr.put(bits, n)
                    run = 0
                    last = max([0, *np.flatnonzero(q).tolist()])
                    for v in q[1 : last + 1].tolist():
                        if v == 0:
                            run += 1
                            continue
                        while run > 15:
                            wr.bits += ac[0xF0]
                            run -= 16
                        n, bits = wr.amplitude(v)
                        wr.bits += ac[run << 4 | n]
                        wr.put(bits, n)
                        run = 0
                    if last < 63:
                        wr.bits += ac[0]
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, fh << 4 | fv, 0]) for i, (fh, fv) in enumerate(factors))
    tables = bytes([0x00]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + bytes([0x10]) + bytes([0] * 7 + [255, 1] + [0] * 7) + bytes(range(256))
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, frame) + seg(0xC4, tables) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"")
    start = seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    return head + start + scan + wr.done() + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_grey(restart):
    rng = np.random.default_rng(1)
    x = np.clip(np.cumsum(rng.integers(-9, 10, (24, 32)), axis=1) + 120, 0, 255).astype(np.uint8)
    got = jpeg.decode(encode([x], [(1, 1)], (21, 30), restart))
    assert got.shape == (21, 30) and np.abs(got.astype(int) - x[:21, :30]).max() <= 2


@pytest.mark.parametrize("factors", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_baseline_colour(factors):
    h, w = 32, 48
    y = np.add.outer(np.arange(h) * 3, np.arange(w) * 2).astype(np.uint8) % 200
    cb, cr = np.full((h, w), 90, np.uint8), np.full((h, w), 160, np.uint8)
    fh, fv = factors[0]
    got = jpeg.decode(encode([y, cb[:: fv, :: fh], cr[:: fv, :: fh]], factors, (h, w), 3))
    want = np.stack([y + 1.402 * 32, y + 0.344136 * 38 - 0.714136 * 32, y - 1.772 * 38], axis=-1)
    assert np.abs(got - np.clip(want, 0, 255)).max() <= 3


def test_frames_without_sense():
    good = encode([np.full((8, 8), 9, np.uint8)], [(1, 1)], (8, 8))
    for bad in (b"", b"\xff\xd8\xff\xd9", good[: len(good) // 2], good.replace(struct.pack(">BHH", 8, 8, 8), struct.pack(">BHH", 8, 0, 0)), good.replace(struct.pack(">BHH", 8, 8, 8), struct.pack(">BHH", 8, 8, 0))):
        with pytest.raises((ValueError, IndexError, KeyError)):
            jpeg.decode(bad)


def features(raw):
    """The digest's columns from their definitions, by the payload alone."""
    p = media.payload(raw)
    frames = np.frombuffer(p, np.uint8).reshape(-1, 576)
    h = [np.histogram(f, bins=32, range=(0, 256))[0] / 576 for f in frames]
    d = [abs(a - b).sum() / 2 for a, b in zip(h, h[1:])]
    cuts = [0]
    for i, v in enumerate(d):
        around = d[max(0, i - 8) : i] + d[i + 1 : i + 9]
        mean, dev = (np.mean(around), np.std(around)) if around else (0, 0)
        if v >= 0.25 and v > mean + 2 * dev + 1e-12:
            cuts.append(i + 1)
    return len(frames), frames.mean(), cuts


def test_stored_form_and_features(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.text_media(docs).collect()}
    clips = {}
    for r in media.clips(media.text_media(docs)).collect():
        assert r["error"] is None
        clips.setdefault(r["doc_id"], []).append((r["clip"], r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]))
    for r in media.media_digests(docs).collect():
        raw, data = texts[r["doc_id"]], stored[r["doc_id"]]
        assert data[:4] == b"RIFF" and data[8:12] == b"AVI " and struct.unpack("<I", data[4:8])[0] == len(data) - 8
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        n, level, cuts = features(raw)
        assert r["feature"] == f"frames={n} level={level:.4f} shots={len(cuts)} at=" + ",".join(f"{c / 25:.2f}" for c in cuts)
        assert sorted(clips[r["doc_id"]]) == [(k, a, b - a, a / 25, b / 25) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], n]))]


def test_clips_of_bad_files(spark):
    good = media.pack_bytes(b"x" * 2000)
    rows = [(1, None), (2, b"junk"), (3, good), (4, good[: len(good) - 900]), (None, media.write_avi([])), (5, media.write_avi([b"\xff\xd8\xff\xd9"]))]
    got = media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    error = {r["doc_id"]: r["error"] for r in got}
    assert error[1] and error[2] and error[3] is None and error[5] and 4 in error and None not in error
