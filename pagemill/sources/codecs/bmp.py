"""BMP: pages from bytes and bytes from pages."""

from __future__ import annotations

import struct

import numpy as np

from pagemill.functions.page import BW1, GRAY8, RGB24, RGBA32, Page, half_up

INCHES_A_METRE, DEFAULT_DPI = 39.3701, 96.0


def _rle8(data: bytes, w: int, h: int) -> np.ndarray:
    out, x, y, i = np.zeros((h, w), np.uint8), 0, 0, 0
    while i + 1 < len(data) and y < h:
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            out[y, x : x + n] = v
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2 and i + 1 < len(data):
            x, y, i = x + data[i], y + data[i + 1], i + 2
        elif v > 2:
            raw = np.frombuffer(data[i : i + v], np.uint8)
            room = out[y, x : x + len(raw)]
            room[:] = raw[: len(room)]
            x, i = x + v, i + v + v % 2
    return out


def read(data: bytes) -> Page | None:
    """A page of 1, 8, 24 or 32 bits; None for what is no such BMP. The palette of 8 bits is ignored; a one-bit palette that starts with black is inverted to ink."""
    if len(data) < 26 or data[:2] != b"BM":
        return None
    (start,) = struct.unpack_from("<I", data, 10)
    (head,) = struct.unpack_from("<I", data, 14)
    how, ppm = 0, (0, 0)
    if head == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
    elif head >= 40 and len(data) >= 54:
        w, h, _, bits, how, _, *ppm = struct.unpack_from("<iiHHIIii", data, 18)
    else:
        return None
    down, h = h < 0, abs(h)
    if bits not in (1, 8, 24, 32) or how not in (0, 1, 3) or (how == 1 and bits != 8) or w <= 0 or not h:
        return None
    stride = (w * bits + 31) // 32 * 4
    if how == 1:
        px = _rle8(data[start:], w, h)
    else:
        if start + stride * h > len(data):
            return None
        rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
        px = np.unpackbits(rows, axis=1)[:, :w] if bits == 1 else rows[:, : w * bits // 8].reshape((h, w) if bits == 8 else (h, w, bits // 8))
    px = (px if down else px[::-1]).copy()
    if bits == 1:
        size = 3 if head == 12 else 4
        first = data[14 + head : 14 + head + size][:3]
        if sum(first) < 3 * 128:
            px = 1 - px
    elif bits >= 24:
        px[..., [0, 2]] = px[..., [2, 0]]
    dpi = [v / INCHES_A_METRE if v > 0 else DEFAULT_DPI for v in ppm]
    return Page(px, {1: BW1, 8: GRAY8, 24: RGB24, 32: RGBA32}[bits], *dpi)


def write(p: Page) -> bytes:
    """Bottom-up, uncompressed; grey and one-bit pages have a palette."""
    bits = p.format
    palette = b"\xff\xff\xff\x00\x00\x00\x00\x00" if bits == 1 else b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    stride = (p.width * bits + 31) // 32 * 4
    px = p.pixels[::-1]
    if bits >= 24:
        px = px.copy()
        px[..., [0, 2]] = px[..., [2, 0]]
    flat = np.packbits(px, axis=1) if bits == 1 else px.reshape(p.height, -1)
    rows = np.zeros((p.height, stride), np.uint8)
    rows[:, : flat.shape[1]] = flat
    ppm = [half_up((d if d > 0 else DEFAULT_DPI) * INCHES_A_METRE) for d in (p.dpi_x, p.dpi_y)]
    start = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, p.width, p.height, 1, bits, 0, rows.size, *ppm, len(palette) // 4, 0)
    return head + palette + rows.tobytes()
