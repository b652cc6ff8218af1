"""Byte and bit codecs of TIFF strips: PackBits, LZW, and group 4 (ITU-T T.6)."""

from __future__ import annotations

import numpy as np

# PackBits -------------------------------------------------------------------------------------------------------------


def packbits(row: bytes) -> bytes:
    """Runs of three and more are repeats, all else literals, at most 128 bytes each."""
    out, i, n = bytearray(), 0, len(row)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), row[i]))
        else:
            while j < n and j - i < 128 and not (j + 2 < n and row[j] == row[j + 1] == row[j + 2]):
                j += 1
            out.append(j - i - 1)
            out += row[i:j]
        i = j
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128 and i + 1 < len(data):
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


# LZW, from the high bit, 9 to 12 bits, codes widen one early -----------------------------------------------------------


def lzw(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    bits, held, out, width, nxt = 0, 0, bytearray(), 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            table, width, nxt = {bytes((j,)): j for j in range(256)}, 9, 258
        elif nxt >= 1 << width and width < 12:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        nxt += 1
        if nxt >= 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, prev, out = list(fresh), 9, b"", bytearray()
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, prev = list(fresh), 9, b""
            continue
        if not prev:
            if code >= 256:
                break
            prev = table[code]
            out += prev
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table):
            now = prev + prev[:1]
        else:
            break
        out += now
        table.append(prev + now[:1])
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        prev = now
    return bytes(out[:size])


# Group 4 --------------------------------------------------------------------------------------------------------------

# The run-length codes of ITU-T T.4 for runs of 0 to 63, then for 64 to 1728 in steps of 64, and for both
# colours 1792 to 2560 in steps of 64; then the mode codes of T.6.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100
0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101
00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001
011011010 011011011 010011000 010011001 010011010 011000 010011011"""
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100
00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011
000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101
000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101
0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
PASS, ACROSS, VERTICAL = "0001", "001", {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001" * 2


def _lengths(codes: str) -> dict[int, str]:
    words = codes.split() + LONG.split()
    return {(i if i < 64 else (i - 63) * 64): c for i, c in enumerate(words)}


RUNS = (_lengths(WHITE), _lengths(BLACK))
#: No code is longer than this.
LONGEST = 13


def _reader(codes: dict[str, object]) -> list[tuple[int, object]]:
    """By the next LONGEST bits as a number: the length of the code they begin with, 0 for none, and what it means."""
    out: list[tuple[int, object]] = [(0, None)] * (1 << LONGEST)
    for code, meaning in codes.items():
        rest = LONGEST - len(code)
        first = int(code, 2) << rest
        out[first : first + (1 << rest)] = [(len(code), meaning)] * (1 << rest)
    return out


_READ_RUN = tuple(_reader({c: n for n, c in r.items()}) for r in RUNS)
_READ_MODE = _reader({PASS: "pass", ACROSS: "across", **{c: d for d, c in VERTICAL.items()}})


def _ahead(data: bytes) -> np.ndarray:
    """At each bit the number that it and the LONGEST - 1 behind it make; zeros follow the end."""
    bits = np.concatenate((np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(LONGEST, np.uint8))).astype(np.uint16)
    out = np.zeros(len(bits) - LONGEST, np.uint16)
    for i in range(LONGEST):
        out = (out << np.uint16(1)) | bits[i : i + len(out)]
    return out


def _run(n: int, colour: int) -> str:
    out = ""
    while n > 2560:
        out, n = out + RUNS[colour][2560], n - 2560
    if n >= 64:
        out, n = out + RUNS[colour][n // 64 * 64], n % 64
    return out + RUNS[colour][n]


def _changes(row: np.ndarray) -> list[int]:
    """Places where the colour differs from that before; a row starts from white."""
    return np.flatnonzero(np.diff(row, prepend=0)).tolist()


def _next(changes: list[int], after: int, colour: int, width: int, hint: int) -> tuple[int, int, int]:
    """b1 and b2: the first change right of ``after`` to the colour opposite to ``colour``, and the one behind it."""
    i = max(hint - 2, 0)
    while i < len(changes) and (changes[i] <= after or i % 2 != colour):
        i += 1
    return (changes[i] if i < len(changes) else width, changes[i + 1] if i + 1 < len(changes) else width, i)


def g4(bw: np.ndarray) -> bytes:
    h, w = bw.shape
    out: list[str] = []
    ref: list[int] = []
    for y in range(h):
        cur = _changes(bw[y])
        a0, colour, k, hint = -1, 0, 0, 0
        while a0 < w:
            while k < len(cur) and cur[k] <= a0 or k < len(cur) and k % 2 != colour:
                k += 1
            a1 = cur[k] if k < len(cur) else w
            b1, b2, hint = _next(ref, a0, colour, w, hint)
            if b2 < a1:
                out.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a0, colour, k, hint = a1, 1 - colour, max(k - 1, 0), max(hint - 1, 0)
            else:
                a2 = cur[k + 1] if k + 1 < len(cur) else w
                out.append(ACROSS + _run(a1 - max(a0, 0), colour) + _run(a2 - a1, 1 - colour))
                a0 = a2
        ref = cur
    bits = "".join(out) + END
    return int(bits.ljust((len(bits) + 7) // 8 * 8, "0"), 2).to_bytes((len(bits) + 7) // 8, "big")


def ung4(data: bytes, w: int, h: int) -> np.ndarray:
    """Rows until the end mark or the first bad code; what is left is white."""
    ahead = _ahead(data).tolist()
    at, out, ref = 0, np.zeros((h, w), np.uint8), []

    def read(table: list[tuple[int, object]]):
        nonlocal at
        n, got = table[ahead[at]] if at < len(ahead) else (0, None)
        if not n or at + n > len(ahead):
            return None
        at += n
        return got

    def run(colour: int) -> int | None:
        total = 0
        while True:
            n = read(_READ_RUN[colour])
            if n is None:
                return None
            total += n
            if n < 64:
                return total

    for y in range(h):
        cur: list[int] = []  # changes, white first
        a0, colour, hint = -1, 0, 0
        while a0 < w:
            b1, b2, hint = _next(ref, a0, colour, w, hint)
            mode = read(_READ_MODE)
            if mode is None:
                return out
            if mode == "pass":
                a0 = b2
            elif mode == "across":
                one, two = run(colour), run(1 - colour)
                if one is None or two is None:
                    return out
                a1 = min(max(a0, 0) + one, w)
                cur += [a1, min(a1 + two, w)]
                a0 = cur[-1]
            else:
                a0 = min(max(b1 + mode, 0), w)
                cur.append(a0)
                colour, hint = 1 - colour, max(hint - 1, 0)
        for i in range(0, len(cur), 2):
            out[y, cur[i] : cur[i + 1] if i + 1 < len(cur) else w] = 1
        ref = _changes(out[y])
    return out
