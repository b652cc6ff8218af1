import numpy as np
import pytest

from pagemill.functions import page as P
from pagemill.functions.page import BW1, GRAY8, RGB24, RGBA32, Page
from pagemill.plans import page_pipeline as PP
from pagemill.plans import profile as PR


def ink(w, h, *boxes, dpi=300):
    px = np.zeros((h, w), np.uint8)
    for x0, y0, x1, y1 in boxes:
        px[y0:y1, x0:x1] = 1
    return Page(px, BW1, dpi, dpi)


def inch(v):
    return {"value": v, "unit": "inches"}


def px(v):
    return {"value": v, "unit": "pixels"}


def test_spans_and_components():
    bits = np.unpackbits(np.array([[0xFF, 0x00], [0x00, 0xF0]], np.uint8), axis=1)
    assert P.spans(bits).tolist() == [[0, 0, 8], [1, 8, 12]]
    runs = np.array([[0, 0, 2], [1, 0, 2], [2, 6, 8], [3, 6, 8]])
    assert P.components(runs, (0, 0, 10, 10))[:, 4].tolist() == [4, 4]
    diagonal = np.array([[0, 0, 2], [1, 2, 4]])
    assert len(P.components(diagonal, (0, 0, 9, 9), 4)) == 2 and len(P.components(diagonal, (0, 0, 9, 9), 8)) == 1
    clipped = P.components(np.array([[0, 0, 100], [1, 0, 100]]), (0, 0, 50, 9))
    assert clipped.tolist() == [[0, 0, 50, 2, 100]]
    assert len(P.components(np.empty((0, 3), np.int64), (0, 0, 5, 5))) == 0


def test_components_agree_with_a_flood():
    rng = np.random.default_rng(5)
    for density in (0.2, 0.5, 0.8):
        bw = (rng.random((30, 40)) < density).astype(np.uint8)
        for n, near in ((4, P._CROSS), (8, P._SQUARE)):
            seen, found = np.zeros_like(bw), []
            for y, x in np.argwhere(bw):
                if seen[y, x]:
                    continue
                stack, cells = [(y, x)], []
                seen[y, x] = 1
                while stack:
                    a, b = stack.pop()
                    cells.append((a, b))
                    for i, j in near:
                        c, e = a + i, b + j
                        if 0 <= c < 30 and 0 <= e < 40 and bw[c, e] and not seen[c, e]:
                            seen[c, e] = 1
                            stack.append((c, e))
                ys, xs = zip(*cells)
                found.append([min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(cells)])
            assert sorted(P.components(P.spans(bw), (0, 0, 40, 30), n).tolist()) == sorted(found)


def test_subimage_and_small_parts():
    assert P.subimage(ink(200, 100, (40, 20, 90, 50)), PR.DEFAULTS["subimage"])[0] == (40, 20, 90, 50)
    box, parts = P.subimage(ink(200, 200, (5, 5, 7, 7), (50, 50, 80, 80)), {**PR.DEFAULTS["subimage"], "min_width_px": 10, "min_height_px": 10})
    assert box == (50, 50, 80, 80) and len(parts) == 1
    assert P.subimage(ink(20, 20), PR.DEFAULTS["subimage"])[0] is None


def test_edges_specks_and_holes():
    edges = {k: px(10) for k in ("top", "left", "right", "bottom")}
    out = P.edge_cleanup(ink(100, 100, (0, 0, 100, 100)), edges).pixels
    assert out[:10].sum() == out[:, -10:].sum() == 0 and out[10, 10] == out[89, 89] == 1
    specks = ink(60, 60, (1, 1, 2, 2), (20, 1, 21, 2), (30, 30, 35, 35))
    assert P.despeckle(specks, "single_pixel", 1, 1).pixels.sum() == 25
    assert P.despeckle(ink(60, 60, (1, 1, 4, 4), (20, 20, 40, 40)), "object", 1, 5).pixels.sum() == 400
    holes = ink(400, 400, (10, 180, 40, 210), (200, 200, 380, 210))
    assert P.hole_cleanup(holes, {"top": px(0), "bottom": px(0), "right": px(0), "left": px(60)}).pixels.sum() == 1800


def test_canvas_margins_and_resize():
    canvas = lambda **k: P.canvas_of({**PR.DEFAULTS["canvas"], **k}, 300, 300, 70, 50)
    assert canvas() == (2550, 3300) and canvas(orientation="landscape") == (3300, 2550) and canvas(preset="autodetect") == (70, 50) and canvas(preset="a4") == (2480, 3508)
    gray = Page(np.full((80, 100), 90, np.uint8), GRAY8, 300, 300)
    m = PR.merge(PR.DEFAULTS["margins"][0], {"left": {"distance": px(25)}, "top": {"distance": px(30)}})
    sheet, box = P.place_by_margins(gray, (20, 10, 70, 40), m, (200, 150), False)
    assert box == (25, 30, 75, 60) and sheet.pixels[30, 25] == 90 and sheet.pixels[29, 25] == 255
    for v, top in (("top", 0), ("center", 25), ("bottom", 50)):
        c = {**PR.DEFAULTS["resize"], "enabled": True, "source": "full_page", "allow_enlarge": False, "v_alignment": v, "canvas": {"preset": "custom", "width": px(100), "height": px(100), "orientation": "portrait"}}
        assert P.resize(Page(np.zeros((50, 50), np.uint8), GRAY8, 300, 300), (0, 0, 50, 50), c, False)[1][:2] == (25, top)


def test_histograms_and_thresholds():
    assert P.otsu(np.zeros(256, int)) == 128
    two = np.zeros(256, int)
    two[40:61] = 5
    two[190:211] = 5
    assert 60 <= P.otsu(two) <= 190
    red = Page(np.dstack([np.full((5, 5), 255, np.uint8), *[np.zeros((5, 5), np.uint8)] * 2]), RGB24)
    assert P.histogram(red)[76] == 25
    assert P.convert(P.convert(red, RGBA32), RGB24).pixels.tolist() == red.pixels.tolist()
    assert P.color_dropout(red, "red", 30).pixels.min() == 255


def test_morphology():
    dot = ink(9, 9, (4, 4, 5, 5))
    assert P.dilate(dot).pixels.sum() == 9 and P.dilate(dot, "cross").pixels.sum() == 5
    assert P.erode(ink(9, 9, (0, 0, 9, 9))).pixels.sum() == 49
    assert (P.morph_close(dot).pixels == dot.pixels).all() and P.morph_open(dot).pixels.sum() == 0


def test_blank_pages():
    c = {**PR.DEFAULTS["blank_page"], "enabled": True}
    assert P.blank_page(P.blank(0, 0, BW1), c).is_blank and P.blank_page(ink(200, 150), c).is_blank
    assert not P.blank_page(ink(200, 150, (20, 20, 90, 90)), c).is_blank and P.blank_page(ink(200, 150, (20, 20, 23, 21)), c).is_blank
    border = ink(200, 150, (0, 0, 200, 10), (0, 0, 10, 150))
    assert P.blank_page(border, {**c, "edge_margin": inch(0.1)}).is_blank


def test_limits_turns_and_skew():
    assert P.limited((100, 0), (600, 600)) == (100, 0) and P.limited((300, -500), (150, 300)) == (150, -300)
    gray = Page(np.arange(12, dtype=np.uint8).reshape(3, 4), GRAY8, 100, 200)
    assert P.rotate(gray, "cw90").pixels[0].tolist() == [8, 4, 0] and P.rotate(gray, "cw90").dpi_x == 200
    assert P.crop(gray, -2, 1, 3, 9).pixels.tolist() == [[4, 5, 6], [8, 9, 10]]
    lines = ink(200, 100, (20, 20, 180, 22), (20, 50, 180, 52), (20, 80, 180, 82))
    assert abs(P.detect_skew(lines)) <= 0.5
    tilted = P.rotate_arbitrary(lines, 2.0)
    assert abs(abs(P.detect_skew(tilted)) - 2.0) < 0.3
    assert P.rotate_arbitrary(lines, 0.0) is lines


def test_pipeline_log_and_errors():
    p = PR.profile(canvas={"preset": "custom", "width": inch(1), "height": inch(1)}, margins=[{"top": {"distance": inch(0.8)}}], movement_limit={"enabled": True, "max_vertical": inch(0.2), "max_horizontal": inch(0.2)})
    s, error = PP.run_page(ink(300, 300, (50, 20, 120, 80)), p)
    assert not error and [n for n, _, _ in s.log] == ["rotate", "edge_cleanup", "deskew", "hole_cleanup", "despeckle", "detect_subimage", "blank_page", "margins", "movement_limit"]
    assert s.log[-1][1] and s.log[5][2] == "content at (50,20) 70x60 px, 1 components"
    assert PP.run_page(P.blank(0, 0, BW1), p)[1] == "empty source image"
    assert PP.run_page(ink(5, 5), p, only="bleach")[1] == "unknown step: bleach"


@pytest.mark.parametrize(
    "change",
    [
        {}, {"rotation": "cw90"}, {"rotation": "180"}, {"deskew": {"enabled": True}}, {"despeckle": {"mode": "object", "object_max": 3}}, {"despeckle": {"mode": "single_pixel"}}, {"odd_even_mode": True},
        {"edge_cleanup": {"enabled": True, "order": "after_deskew", "set1": {"top": px(3)}}}, {"hole_cleanup": {"enabled": True, "set1": {"left": inch(0.3)}}}, {"blank_page": {"enabled": True, "min_components": 2}},
        {"canvas": {"preset": "auto"}}, {"position_image": False}, {"keep_outside_subimage": True}, {"margins": [{"center_horizontal": True, "center_vertical": True}]}, {"resize": {"enabled": True, "anti_alias": True}},
        {"resize": {"enabled": True, "source": "custom", "h_alignment": "proportional", "v_alignment": "proportional"}}, {"color_dropout": {"enabled": True, "color": "r"}},
    ],
)
def test_profile_matrix(change):
    p = PR.from_json(PR.to_json(PR.profile(**change)))
    pages = [ink(120, 160, (10, 10, 60, 12), (10, 40, 90, 80), (3, 3, 4, 4)), ink(60, 60), Page(np.full((40, 50), 200, np.uint8), GRAY8), Page(np.random.default_rng(1).integers(0, 256, (30, 40, 3)).astype(np.uint8), RGB24, 100, 100)]
    for i, page in enumerate(pages):
        s, error = PP.run_page(page, p, i)
        assert not error and "detect_subimage" in [n for n, _, _ in s.log]


def test_profile_errors():
    for bad in ('{"rotation": "sideways"}', "{", '{"color_dropout": {"threshold": 256}}', '{"margins": 3}', '{"name": 3}'):
        with pytest.raises(PR.ProfileError):
            PR.from_json(bad)
    assert PR.from_json('{"nobody": [1], "canvas": {"preset": "LEGAL"}}')["canvas"]["preset"] == "legal"


def test_steps_on_their_own_ask_whether_they_are_enabled():
    red = Page(np.dstack([np.full((5, 5), 255, np.uint8), *[np.zeros((5, 5), np.uint8)] * 2]), RGB24, 300, 300)
    off = PR.profile(color_dropout={"enabled": False, "color": "red", "threshold": 30}, resize={"enabled": False})
    for step, said in (("color_dropout", "disabled"), ("resize", "no resize applied")):
        s, error = PP.run_page(red, off, only=step)
        assert not error and s.log == [(step, False, said)] and (s.page.pixels == red.pixels).all()
    on = PR.profile(color_dropout={"enabled": True, "color": "red", "threshold": 30}, resize={"enabled": True})
    assert PP.run_page(red, on, only="color_dropout")[0].page.pixels.min() == 255 and PP.run_page(red, on, only="resize")[0].log == [("resize", True, "resized")]


def test_gray_is_rounded():
    px = np.array([[[2, 0, 0], [0, 0, 5], [255, 255, 255], [1, 0, 0]]], np.uint8)
    assert P.convert(Page(px, RGB24), GRAY8).pixels.tolist() == [[1, 1, 255, 0]]


def test_paths_and_places(spark):
    from pyspark.sql import functions as F

    from pagemill.functions import expressions as X

    one = spark.range(1)
    path = lambda source, ext, tiff=None: one.select(X.output_path(F.lit(source), F.lit(""), F.lit("_c"), F.lit(ext), tiff).alias("p")).first().p
    assert path("/in/a.BMP", "") == "/in/a_c.tif" and path("/in/a.BMP", "png") == "/in/a_c.png" and path("/in/a.BMP", "", F.lit(False)) == "/in/a_c.BMP" and path("/in/a", "", F.lit(False)) == "/in/a_c.tif"
    place = lambda before, after, size: one.select(X.margin_place(F.lit(100), F.lit(size), F.lit(before), F.lit(after), F.lit(True)).alias("p")).first().p
    assert place(10, 20, 50) == 20 and place(10, 20, 71) == 10 and place(10, 20, 75) == 8
