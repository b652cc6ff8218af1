"""TIFF: tags and pages from bytes, and bytes from pages."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from pagemill.functions.page import BW1, GRAY8, RGB24, RGBA32, Page, blank
from pagemill.sources.codecs import runs

# Sizes of the field types, numbers of tags and compressions.
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, ORIENTATION, SAMPLES, ROWS, STRIP_COUNTS = 256, 257, 258, 259, 262, 266, 273, 274, 277, 278, 279
X_RES, Y_RES, RES_UNIT, SOFTWARE, EXTRA = 282, 283, 296, 305, 338
NONE, G4, LZW, PACKBITS = 1, 4, 5, 32773
COMPRESSIONS = {"raw": NONE, "g4": G4, "lzw": LZW, "packbits": PACKBITS}
MOST_PAGES = 10_000


@dataclass(frozen=True)
class Field:
    kind: int
    ints: list[int]
    doubles: list[float]
    text: str | None = None


Ifd = dict[int, Field]


def _field(data: bytes, order: str, kind: int, count: int, at: int) -> Field | None:
    code, size = KINDS[kind]
    if at < 0 or at + size * count > len(data):
        return None
    raw = data[at : at + size * count]
    if code == "s":
        text = raw.split(b"\x00")[0].decode("latin-1") if kind == 2 else None
        return Field(kind, list(raw) if kind == 7 else [], [], text)
    values = struct.unpack(f"{order}{count * len(code)}{code[0]}", raw)
    if len(code) == 2:
        return Field(kind, [], [n / d if d else 0.0 for n, d in zip(values[::2], values[1::2], strict=True)])
    return Field(kind, [], list(values)) if kind > 10 else Field(kind, list(values), [])


def read_tags(data: bytes) -> list[Ifd] | None:
    """Tags of each page; None if it is no TIFF or a directory is broken. Fields of unknown type or out of range are left out."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        return None
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        return None
    pages: list[Ifd] = []
    while at and len(pages) < MOST_PAGES:
        if at + 2 > len(data):
            return None
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            return None
        tags: Ifd = {}
        for i in range(n):
            pos = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, pos)
            if kind not in KINDS:
                continue
            inside = KINDS[kind][1] * count <= 4
            field = _field(data, order, kind, count, pos + 8 if inside else struct.unpack_from(order + "I", data, pos + 8)[0])
            if field is not None:
                tags[tag] = field
        pages.append(tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return pages


def get_int(tags: Ifd, tag: int, default: int | None = None) -> int | None:
    f = tags.get(tag)
    return f.ints[0] if f and f.ints else int(f.doubles[0]) if f and f.doubles else default


def get_double(tags: Ifd, tag: int) -> float | None:
    f = tags.get(tag)
    return f.doubles[0] if f and f.doubles else float(f.ints[0]) if f and f.ints else None


def get_text(tags: Ifd, tag: int) -> str | None:
    f = tags.get(tag)
    return f.text if f else None


def read_page(data: bytes, page: int = 0, pages: list[Ifd] | None = None) -> Page | None:
    """A page's pixels; None for what is not supported: tiles, other depths, other compressions. Grey white-is-zero is kept as stored."""
    pages = read_tags(data) if pages is None else pages
    if pages is None or page >= len(pages):
        return None
    t = pages[page]
    w, h, bits, samples = get_int(t, WIDTH, 0), get_int(t, LENGTH, 0), get_int(t, BITS, 1), get_int(t, SAMPLES, 1)
    format = {(1, 1): BW1, (8, 1): GRAY8, (8, 3): RGB24, (8, 4): RGBA32}.get((bits, samples))
    how, photometric = get_int(t, COMPRESSION, 1), get_int(t, PHOTOMETRIC, 1)
    if format is None or not w or not h or STRIP_OFFSETS not in t or STRIP_COUNTS not in t or how not in (NONE, G4, LZW, PACKBITS) or (how == G4 and format != BW1):
        return None
    rows, row = min(get_int(t, ROWS, h) or h, h), (w + 7) // 8 if format == BW1 else w * format // 8
    flip = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
    parts = []
    for i, (at, size) in enumerate(zip(t[STRIP_OFFSETS].ints, t[STRIP_COUNTS].ints)):
        n = min(rows, h - i * rows)
        raw = data[at : at + size]
        if n <= 0:
            break
        if how == G4:
            raw = np.packbits(runs.ung4(raw.translate(flip) if get_int(t, FILL_ORDER, 1) == 2 else raw, w, n), axis=1).tobytes()
        elif how == LZW:
            raw = runs.unlzw(raw, n * row)
        elif how == PACKBITS:
            raw = runs.unpackbits(raw, n * row)
        parts.append(raw[: n * row].ljust(n * row, b"\x00"))
    body = b"".join(parts).ljust(h * row, b"\x00")
    p = Page.from_bytes(body, w, h, format, get_double(t, X_RES) or 0.0, get_double(t, Y_RES) or 0.0)
    return p.of(1 - p.pixels) if format == BW1 and photometric == 1 and how != G4 or format == BW1 and how == G4 and photometric == 1 else p


def _strip(p: Page, how: int) -> bytes:
    if how == G4:
        return runs.g4(p.pixels)
    raw = p.to_bytes()
    if how == PACKBITS:
        row = len(raw) // p.height
        return b"".join(runs.packbits(raw[i : i + row]) for i in range(0, len(raw), row))
    return runs.lzw(raw) if how == LZW else raw


def write(pages: list[Page], compression: int = NONE, software: str = "pagemill") -> bytes:
    """A TIFF of one strip a page, little-endian, tags in order; empty pages are left out. One-bit ink is black (white is zero)."""
    out, link = bytearray(b"II*\x00\x00\x00\x00\x00"), 4
    for p in pages:
        if p.empty:
            continue
        how = compression if compression in COMPRESSIONS.values() and (compression != G4 or p.format == BW1) else NONE
        strip = _strip(p, how)
        at = len(out)
        out += strip + b"\x00" * (len(strip) % 2)
        bits, samples = (1, 1) if p.format == BW1 else (8, p.format // 8)
        tags = [
            (WIDTH, 4, [p.width]), (LENGTH, 4, [p.height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [0 if p.format == BW1 else 1 if p.format == GRAY8 else 2]),
            (STRIP_OFFSETS, 4, [at]), (SAMPLES, 3, [samples]), (ROWS, 4, [p.height]), (STRIP_COUNTS, 4, [len(strip)]),
            *([(X_RES, 5, [int(p.dpi_x), 1]), (Y_RES, 5, [int(p.dpi_y), 1]), (RES_UNIT, 3, [2])] if p.dpi_x > 0 and p.dpi_y > 0 else []),
            (SOFTWARE, 2, software.encode("latin-1") + b"\x00"), *([(EXTRA, 3, [2])] if p.format == RGBA32 else []),
        ]
        bodies = []
        for tag, kind, v in tags:
            raw = v if kind == 2 else struct.pack(f"<{len(v)}{KINDS[kind][0][0]}", *v)
            count = len(v) // (2 if kind == 5 else 1)
            if len(raw) > 4:
                place, raw = len(out), raw + b"\x00" * (len(raw) % 2)
                out += raw
                raw = struct.pack("<I", place)
            bodies.append(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\x00"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(bodies)) + b"".join(bodies)
        link = len(out)
        out += b"\x00\x00\x00\x00"
    return bytes(out)


def read_pages(data: bytes) -> list[Page]:
    """All pages up to the first that can't be decoded."""
    tags, out = read_tags(data) or [], []
    for i in range(len(tags)):
        p = read_page(data, i, tags)
        if p is None:
            break
        out.append(p)
    return out
