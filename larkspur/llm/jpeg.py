"""JPEG frames in numpy: a lossless (SOF3) encoder, and decoders of lossless and baseline frames.

The encoder predicts each 8-bit sample from its left neighbour. Its Huffman table gives difference
category k a code of 9 - k bits, and k more bits follow, so every sample takes 9 bits and frames
with that table are coded and decoded as whole arrays. Other frames are decoded bit by bit.
"""

from __future__ import annotations

import numpy as np

SIDE = 24
#: Codes of length 1 .. 9 stand for categories 8 .. 0.
_CATEGORIES = list(range(8, -1, -1))


def _coder() -> tuple[np.ndarray, np.ndarray]:
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        length = 9 - k
        bits = d if d >= 0 else d + (1 << k) - 1
        code[d + 255] = (((1 << length) - 2) << k) | bits
        back[code[d + 255]] = d
    return code, back


_CODE, _BACK = _coder()


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def lossless_header(width: int, height: int) -> bytes:
    """All that comes before a frame's coded samples: one 8-bit component, predictor 1."""
    table = bytes([0, *([1] * 9), *([0] * 7), *_CATEGORIES])
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + segment(0xC4, table) + segment(0xC3, frame) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """One JPEG for each (height, width) array of 8-bit samples; height * width must be a multiple of 8."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODE[d.reshape(n, -1) + 255].reshape(n, -1, 8)
    out = np.empty((n, c.shape[1], 9), np.uint8)
    out[:, :, 0] = c[:, :, 0] >> 1
    for j in range(1, 8):
        out[:, :, j] = (c[:, :, j - 1] << (8 - j)) | (c[:, :, j] >> (j + 1))
    out[:, :, 8] = c[:, :, 7]
    head = lossless_header(width, height)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in out.reshape(n, -1)]


def decode_all(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame; runs of frames with the encoder's own header are decoded at once."""
    out: list[np.ndarray] = []
    i, own = 0, lossless_header(SIDE, SIDE)
    size = SIDE * SIDE * 9 // 8
    while i < len(frames):
        j, scans = i, []
        while j < len(frames) and frames[j].startswith(own):
            scan = frames[j][len(own) : -2].replace(b"\xff\x00", b"\xff")
            if len(scan) != size:
                break
            scans.append(scan)
            j += 1
        if scans:
            b = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), -1, 9).astype(np.uint16)
            c = np.empty((*b.shape[:2], 8), np.uint16)
            for k in range(8):
                c[:, :, k] = ((b[:, :, k] << (k + 1)) | (b[:, :, k + 1] >> (7 - k))) & 511
            d = _BACK[c].reshape(len(scans), SIDE, SIDE).astype(np.int32)
            d[:, 0, 0] += 128
            d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
            out.extend(np.cumsum(d, axis=2).astype(np.uint8))
            i = j
        else:
            out.append(decode(frames[i]))
            i += 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        got = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return got

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def difference(self, k: int) -> int:
        if k == 16:
            return 32768
        bits = self.take(k)
        return bits if not k or bits >> (k - 1) else bits - (1 << k) + 1


def _basis() -> np.ndarray:
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order: along the diagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


_BASIS, _ZIGZAG = _basis(), _zigzag()


def decode(data: bytes) -> np.ndarray:
    """(height, width) samples of a grey frame, (height, width, 3) of a colour one (RGB from YCbCr).

    Baseline (SOF0), extended 8-bit Huffman (SOF1) and lossless (SOF3, one component) frames with one scan.
    """
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, dict[tuple[int, int], int]] = {}
    restart, kind, parts = 0, None, []
    height = width = 0
    at = 2
    while True:
        while data[at] != 0xFF or data[at + 1] in (0, 0xFF):
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            raise ValueError("no scan")
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                quant[body[0] & 15] = values
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                lengths, values = body[1:17], body[17 : 17 + sum(body[1:17])]
                code, n, table = 0, 0, {}
                for length, many in enumerate(lengths, 1):
                    for _ in range(many):
                        table[length, code] = values[n]
                        code, n = code + 1, n + 1
                    code <<= 1
                huff[body[0]] = table
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC3):
            kind, height, width = marker, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if not height or not width or not body[5]:
                raise ValueError("a frame without samples")
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline and lossless Huffman frames are read")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            first = body[1 + 2 * body[0]]
            break
    end = data.rfind(b"\xff\xd9")
    scan = data[at : end if end > at else len(data)]
    pieces, last = [], 0
    i = scan.find(b"\xff")
    while 0 <= i < len(scan) - 1:
        if 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[last:i])
            last = i + 2
        i = scan.find(b"\xff", i + 2)
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, scan[last:]]]
    if kind is None:
        raise ValueError("a scan before its frame")
    if kind == 0xC3:
        return _lossless(pieces, huff[tables[parts[0][0]] >> 4], height, width, first, restart)
    return _baseline(pieces, parts, tables, quant, huff, height, width, restart)


def _lossless(pieces: list[bytes], table: dict, height: int, width: int, predictor: int, restart: int) -> np.ndarray:
    out = np.zeros((height, width), np.int64)
    if restart % width:
        raise ValueError("restarts within a row")
    rows = restart // width if restart else height
    for y in range(height):
        if y % rows == 0:
            bits = _Bits(pieces[y // rows])
        for x in range(width):
            if y % rows == 0:
                p = 128 if not x else out[y, x - 1]
            elif not x:
                p = out[y - 1, 0]
            else:
                a, b, c = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
                p = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor]
            out[y, x] = (p + bits.difference(bits.symbol(table))) & 0xFF
    return out.astype(np.uint8)


def _baseline(pieces, parts, tables, quant, huff, height, width, restart) -> np.ndarray:
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = hmax = vmax = 1
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    planes = {p[0]: np.zeros((down * p[2] * 8, across * p[1] * 8)) for p in parts}
    dc: dict[int, int] = {}
    bits = _Bits(b"")
    for unit in range(across * down):
        if unit == 0 or restart and unit % restart == 0:
            bits = _Bits(pieces[unit // restart if restart else 0])
            dc = {p[0]: 0 for p in parts}
        my, mx = divmod(unit, across)
        for name, h, v, q in parts:
            for b in range(h * v):
                block = np.zeros(64)
                low, high = huff[tables[name] >> 4], huff[0x10 | (tables[name] & 15)]
                dc[name] += bits.difference(bits.symbol(low))
                block[0] = dc[name] * quant[q][0]
                k = 1
                while k < 64:
                    s = bits.symbol(high)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        k += 16
                        continue
                    k += s >> 4
                    block[_ZIGZAG[k]] = bits.difference(s & 15) * quant[q][k]
                    k += 1
                y, x = (my * v + b // h) * 8, (mx * h + b % h) * 8
                planes[name][y : y + 8, x : x + 8] = _BASIS @ block.reshape(8, 8) @ _BASIS.T + 128
    full = [np.repeat(np.repeat(planes[n], vmax // v, 0), hmax // h, 1)[:height, :width] for n, h, v, _ in parts]
    if len(full) < 3:
        return np.clip(np.rint(full[0]), 0, 255).astype(np.uint8)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
