import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.page import BW1, GRAY8, RGB24, RGBA32, Page, blank
from pagemill.sources.codecs import bmp, pdf, runs, tiff


def test_run_codes_are_prefix_free():
    for table in runs.RUNS:
        codes = sorted(table.values())
        assert len(set(codes)) == 104
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))


@given(st.integers(1, 70), st.integers(1, 12), st.floats(0, 1), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_bw_round_trips(w, h, share, seed):
    px = (np.random.default_rng(seed).random((h, w)) < share).astype(np.uint8)
    p = Page(px, BW1, 300, 200)
    for how in tiff.COMPRESSIONS.values():
        q = tiff.read_page(tiff.write([p], how))
        assert (q.pixels == px).all() and (q.dpi_x, q.dpi_y) == (300, 200)
    assert (bmp.read(bmp.write(p)).pixels == px).all()


@pytest.mark.parametrize("format,shape", [(GRAY8, (9, 13)), (RGB24, (9, 13, 3)), (RGBA32, (9, 13, 4))])
def test_colour_round_trips(format, shape):
    p = Page(np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8), format, 300, 300)
    for how in (tiff.NONE, tiff.LZW, tiff.PACKBITS):
        assert (tiff.read_page(tiff.write([p], how)).pixels == p.pixels).all()
    assert (bmp.read(bmp.write(p)).pixels == p.pixels).all()


def test_lzw_beyond_the_table():
    data = np.random.default_rng(2).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    assert runs.unlzw(runs.lzw(data), len(data)) == data


def test_multipage_skips_empty_pages():
    one = Page(np.eye(5, dtype=np.uint8), BW1, 300, 300)
    data = tiff.write([blank(0, 0, BW1), one, blank(0, 0, BW1), one], tiff.LZW)
    assert [p.pixels.shape for p in tiff.read_pages(data)] == [(5, 5), (5, 5)]


def test_tags_of_both_byte_orders_and_bad_input():
    p = Page(np.zeros((200, 100), np.uint8), BW1, 300, 300)
    tags = tiff.read_tags(tiff.write([p], tiff.G4))[0]
    assert (tiff.get_int(tags, tiff.WIDTH), tiff.get_int(tags, tiff.LENGTH), tiff.get_int(tags, tiff.COMPRESSION), tiff.get_double(tags, tiff.X_RES)) == (100, 200, 4, 300.0)
    big = b"MM\x00*\x00\x00\x00\x08\x00\x01\x01\x00\x00\x03\x00\x00\x00\x01\x00\x64\x00\x00\x00\x00\x00\x00"
    assert tiff.get_int(tiff.read_tags(big)[0], tiff.WIDTH) == 100
    for bad in (b"", b"II*\x00", b"XX*\x00\x08\x00\x00\x00", b"II*\x00\xff\x00\x00\x00"):
        assert tiff.read_tags(bad) is None


def test_bmp_run_lengths():
    raw = bmp.write(Page(np.full((2, 4), 7, np.uint8), GRAY8))
    packed = bytearray(raw[: 54 + 1024])
    packed[30:34] = (1).to_bytes(4, "little")
    packed += bytes((4, 9, 0, 0, 0, 3, 1, 2, 3, 0, 1, 5, 0, 1))
    assert bmp.read(bytes(packed)).pixels.tolist() == [[1, 2, 3, 5], [9, 9, 9, 9]]


def test_pdf_has_three_objects_a_page_and_a_sound_table():
    p = Page(np.zeros((72, 144), np.uint8), BW1, 72, 72)
    data = pdf.write([p, p.of(np.zeros((3, 3, 4), np.uint8), format=RGBA32)])
    assert data.startswith(b"%PDF-1.4") and data.count(b" 0 obj\n") == 8 and b"/MediaBox [0 0 144 72]" in data and b"/Decode [1 0]" in data
    at = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[at : at + 4] == b"xref"
