"""Page functions on numpy arrays: no Spark here, so each can be tested alone.

A page's pixels are (h, w) of 0/1 for one bit (1 is ink), (h, w) grey, (h, w, 3) or (h, w, 4) colour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

BW1, GRAY8, RGB24, RGBA32 = 1, 8, 24, 32


@dataclass(frozen=True)
class Page:
    pixels: np.ndarray
    format: int
    dpi_x: float = 0.0
    dpi_y: float = 0.0

    @property
    def width(self) -> int:
        return self.pixels.shape[1]

    @property
    def height(self) -> int:
        return self.pixels.shape[0]

    @property
    def empty(self) -> bool:
        return self.width <= 0 or self.height <= 0

    def of(self, pixels: np.ndarray, **more) -> "Page":
        return replace(self, pixels=pixels, **more)

    def to_bytes(self) -> bytes:
        """Tight rows from the top; one-bit rows packed from the high bit."""
        return (np.packbits(self.pixels, axis=1) if self.format == BW1 else np.ascontiguousarray(self.pixels)).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, width: int, height: int, format: int, dpi_x: float = 0.0, dpi_y: float = 0.0) -> "Page":
        raw = np.frombuffer(data, np.uint8)
        if width <= 0 or height <= 0:
            return blank(0, 0, format)
        if format == BW1:
            px = np.unpackbits(raw.reshape(height, -1), axis=1)[:, :width]
        else:
            px = raw.reshape((height, width) if format == GRAY8 else (height, width, format // 8))
        return cls(px.copy(), format, dpi_x, dpi_y)


def white(format: int) -> int:
    return 0 if format == BW1 else 255


def blank(width: int, height: int, format: int, dpi_x: float = 0.0, dpi_y: float = 0.0, value: int | None = None) -> Page:
    shape = (height, width) if format in (BW1, GRAY8) else (height, width, format // 8)
    return Page(np.full(shape, white(format) if value is None else value, np.uint8), format, dpi_x, dpi_y)


def half_up(x: float) -> int:
    """Halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def cut_div(a: int, b: int) -> int:
    """Division towards zero."""
    return int(math.trunc(a / b))


def pixels_of(m: dict, dpi: float) -> float:
    return {"inches": m["value"] * dpi, "millimeters": m["value"] * dpi / 25.4}.get(m["unit"], m["value"])


# geometry ------------------------------------------------------------------------------------------------------------


def invert(p: Page) -> Page:
    return p.of((1 if p.format == BW1 else 255) - p.pixels)


def crop(p: Page, x: int, y: int, w: int, h: int) -> Page:
    """The origin is clamped to the page without making the size smaller; the size is cut at the far edges."""
    x, y = max(x, 0), max(y, 0)
    return p.of(p.pixels[y : max(y, min(y + h, p.height)), x : max(x, min(x + w, p.width))].copy())


def rotate(p: Page, how: str) -> Page:
    """``cw90``, ``ccw90`` or ``180``; quarter turns swap the resolutions."""
    turns = {"cw90": 3, "ccw90": 1, "180": 2}[how]
    turned = np.ascontiguousarray(np.rot90(p.pixels, turns))
    return p.of(turned) if how == "180" else p.of(turned, dpi_x=p.dpi_y, dpi_y=p.dpi_x)


def blit(dst: Page, src: Page, x: int, y: int) -> Page:
    out = dst.pixels.copy()
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + src.width, dst.width), min(y + src.height, dst.height)
    if x0 < x1 and y0 < y1:
        out[y0:y1, x0:x1] = src.pixels[y0 - y : y1 - y, x0 - x : x1 - x]
    return dst.of(out)


def pad(p: Page, top: int, left: int, right: int, bottom: int, value: int = 0) -> Page:
    return blit(blank(p.width + left + right, p.height + top + bottom, p.format, p.dpi_x, p.dpi_y, value), p, left, top)


# colour --------------------------------------------------------------------------------------------------------------


def convert(p: Page, to: int, threshold: int = 128) -> Page:
    px = p.pixels
    if p.format == to:
        return p
    if p.format == BW1:
        px = np.where(px > 0, 0, 255).astype(np.uint8)
    if px.ndim == 3 and to in (BW1, GRAY8):
        c = px.astype(np.uint32)
        px = ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2] + 128) >> 8).astype(np.uint8)
    if to == BW1:
        px = (px < threshold).astype(np.uint8)
    elif to in (RGB24, RGBA32):
        rgb = np.repeat(px[..., None], 3, axis=2) if px.ndim == 2 else px[..., :3]
        px = rgb if to == RGB24 else np.concatenate((rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)), axis=2)
    return p.of(np.ascontiguousarray(px), format=to)


def luminance(p: Page) -> np.ndarray:
    if p.format == BW1:
        return np.where(p.pixels > 0, 0, 255).astype(np.uint8)
    if p.format == GRAY8:
        return p.pixels
    c = p.pixels.astype(np.float64)
    return np.minimum(0.299 * c[..., 0] + 0.587 * c[..., 1] + 0.114 * c[..., 2] + 0.5, 255).astype(np.uint8)


def histogram(p: Page) -> np.ndarray:
    return np.bincount(luminance(p).ravel(), minlength=256)


def otsu(hist: np.ndarray) -> int:
    """The threshold of largest variance between classes, the first of equals; 128 for nothing, 0 for a single value."""
    total = int(hist.sum())
    if not total:
        return 128
    n, s = np.cumsum(hist).astype(np.float64), np.cumsum(hist * np.arange(256)).astype(np.float64)
    rest = total - n
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where((n > 0) & (rest > 0), n * rest * (s / n - (s[-1] - s) / rest) ** 2, 0.0)
    return int(var.argmax()) if var.max() > 0 else 0


def binarize(p: Page, threshold: int) -> Page:
    return p.of((luminance(p) <= threshold).astype(np.uint8), format=BW1)


def color_dropout(p: Page, color: str, threshold: int) -> Page:
    """Pixels where a channel exceeds the mean of the two others by more than the threshold become white."""
    if p.format not in (RGB24, RGBA32) or color not in ("red", "green", "blue"):
        return p
    c = p.pixels.astype(np.int32)
    k = ("red", "green", "blue").index(color)
    others = c[..., (k + 1) % 3] + c[..., (k + 2) % 3]
    out = p.pixels.copy()
    out[c[..., k] - others // 2 > threshold] = 255
    return p.of(out)


# scaling and turning ---------------------------------------------------------------------------------------------------


def _resized(p: Page, px: np.ndarray, w: int, h: int) -> Page:
    return p.of(px, dpi_x=p.dpi_x * w / p.width, dpi_y=p.dpi_y * h / p.height)


def scale_nearest(p: Page, w: int, h: int) -> Page:
    x = np.minimum((np.arange(w) * (p.width / w)).astype(np.int64), p.width - 1)
    y = np.minimum((np.arange(h) * (p.height / h)).astype(np.int64), p.height - 1)
    return _resized(p, p.pixels[y[:, None], x[None, :]], w, h)


def _bilinear(px: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    h, w = px.shape[:2]
    x0, y0 = sx.astype(np.int64), sy.astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    if px.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    c = px.astype(np.float64)
    v = c[y0, x0] * (1 - fx) * (1 - fy) + c[y0, x1] * fx * (1 - fy) + c[y1, x0] * (1 - fx) * fy + c[y1, x1] * fx * fy
    return np.clip(v + 0.5, 0, 255).astype(np.uint8)


def scale_bilinear(p: Page, w: int, h: int) -> Page:
    if p.format == BW1:
        return scale_nearest(p, w, h)
    sx = np.arange(w) * ((p.width - 1) / max(w - 1, 1))
    sy = np.arange(h) * ((p.height - 1) / max(h - 1, 1))
    sx, sy = np.broadcast_arrays(sx[None, :], sy[:, None])
    return _resized(p, _bilinear(p.pixels, sx, sy), w, h)


def rotate_arbitrary(p: Page, degrees: float) -> Page:
    """Turned about its centre on a canvas that holds all of it; what comes from outside is white."""
    if p.empty or abs(degrees) < 0.001:
        return p
    a = math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    w = math.ceil(p.width * abs(cos) + p.height * abs(sin))
    h = math.ceil(p.width * abs(sin) + p.height * abs(cos))
    rx, ry = (np.arange(w) - w / 2.0)[None, :], (np.arange(h) - h / 2.0)[:, None]
    sx, sy = rx * cos + ry * sin + p.width / 2.0, -rx * sin + ry * cos + p.height / 2.0
    out = blank(w, h, p.format, p.dpi_x, p.dpi_y)
    if p.format == BW1:
        ix, iy = (np.copysign(np.floor(np.abs(v) + 0.5), v).astype(np.int64) for v in (sx, sy))
        ok = (ix >= 0) & (ix < p.width) & (iy >= 0) & (iy < p.height)
        out.pixels[ok] = p.pixels[iy[ok], ix[ok]]
    else:
        ok = (sx >= 0) & (sx < p.width - 1) & (sy >= 0) & (sy < p.height - 1)
        out.pixels[ok] = _bilinear(p.pixels, sx[ok], sy[ok])
    return out


def projection_variance(bw: np.ndarray, degrees: float) -> float:
    """Variance of the ink counts along lines at an angle, over a grid of at most some 500 samples an axis."""
    h, w = bw.shape
    a = math.radians(degrees) if degrees else 0.0
    cos, sin = math.cos(a), math.sin(a)
    ends = (0.0, -w * sin, h * cos, -w * sin + h * cos)
    low, bins = min(ends), int(max(ends) - min(ends)) + 2
    dx, dy = max(1, w // 500), max(1, h // 500)
    y, x = np.nonzero(bw[::dy, ::dx])
    if not len(x) or not 0 < bins <= 100_000:
        return 0.0
    at = (-(x * dx) * sin + (y * dy) * cos - low).astype(np.int64)
    counts = np.bincount(at[(at >= 0) & (at < bins)], minlength=bins).astype(np.float64)
    return float(((counts - counts.sum() / bins) ** 2).sum() / bins)


def detect_skew(p: Page, low: float = -5.0, high: float = 5.0, step: float = 0.1) -> float:
    """The angle of largest projection variance: a coarse search, then a fine one around its best. Angles add up step by step."""
    if p.empty:
        return 0.0
    bw = convert(p, BW1).pixels
    best, top = 0.0, 0.0

    def scan(start: float, stop: float, by: float) -> None:
        nonlocal best, top
        angle = start
        while angle <= stop:
            v = projection_variance(bw, angle)
            if v > top:
                best, top = angle, v
            angle += by

    scan(low, high, step)
    centre = best
    scan(centre - step, centre + step, step / 10.0)
    return best


def deskew(p: Page, low: float, high: float) -> tuple[Page, float, float, bool]:
    """(page, angle, confidence, corrected)."""
    angle = detect_skew(p, -high, high)
    bw = convert(p, BW1).pixels
    flat = projection_variance(bw, 0)
    confidence = min(max((projection_variance(bw, angle) - flat) / flat, 0.0), 1.0) if flat > 0 else 0.0
    if not low <= abs(angle) <= high:
        return p, angle, confidence, False
    return rotate_arbitrary(p, angle), angle, confidence, True


# morphology ------------------------------------------------------------------------------------------------------------

_CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))
_SQUARE = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def _near(px: np.ndarray, shape: str, least: bool) -> np.ndarray:
    """Least or greatest of the neighbours; outside the page there is no ink."""
    wide = np.pad(px, 1)
    h, w = px.shape
    parts = [wide[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i, j in (_CROSS if shape == "cross" else _SQUARE)]
    return np.minimum.reduce(parts) if least else np.maximum.reduce(parts)


def dilate(p: Page, shape: str = "square", times: int = 1) -> Page:
    px = p.pixels
    for _ in range(times):
        px = _near(px, shape, False)
    return p.of(px)


def erode(p: Page, shape: str = "square", times: int = 1) -> Page:
    px = p.pixels
    for _ in range(times):
        px = _near(px, shape, True)
    return p.of(px)


def morph_open(p: Page, shape: str = "square", times: int = 1) -> Page:
    return dilate(erode(p, shape, times), shape, times)


def morph_close(p: Page, shape: str = "square", times: int = 1) -> Page:
    return erode(dilate(p, shape, times), shape, times)


# spans and components -----------------------------------------------------------------------------------------------------


def spans(bw: np.ndarray) -> np.ndarray:
    """(row, start, end) of the runs of ink, by row and start."""
    edge = np.diff(np.pad(bw.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, s = np.nonzero(edge == 1)
    _, e = np.nonzero(edge == -1)
    return np.stack((y, s, e), 1)


def components(runs: np.ndarray, roi: tuple[int, int, int, int], connectivity: int = 4) -> np.ndarray:
    """(left, top, right, bottom, pixels) of the connected parts of ``runs`` inside ``roi``, by their first run."""
    left, top, right, bottom = roi
    r = runs[(runs[:, 0] >= top) & (runs[:, 0] < bottom)]
    r = np.stack((r[:, 0], np.maximum(r[:, 1], left), np.minimum(r[:, 2], right)), 1)
    r = r[r[:, 1] < r[:, 2]]
    n, reach = len(r), 1 if connectivity == 8 else 0
    label = np.arange(n)
    # links: with runs a row above that overlap; both rows are in order of start, so the partners are a stretch
    key = r[:, 0] * (1 << 32)
    above = key - (1 << 32)
    lo = np.searchsorted(key + r[:, 2], above + r[:, 1] - reach, side="right")
    hi = np.searchsorted(key + r[:, 1], above + r[:, 2] + reach, side="left")
    count = np.maximum(hi - lo, 0)
    b = np.repeat(np.arange(n), count)
    a = np.repeat(lo, count) + np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
    while len(a):
        was = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == was).all():
            break
    roots, index = np.unique(label, return_inverse=True)
    out = np.zeros((len(roots), 5), np.int64)
    out[:, :2] = np.iinfo(np.int64).max
    np.minimum.at(out[:, 0], index, r[:, 1])
    np.minimum.at(out[:, 1], index, r[:, 0])
    np.maximum.at(out[:, 2], index, r[:, 2])
    np.maximum.at(out[:, 3], index, r[:, 0] + 1)
    np.add.at(out[:, 4], index, r[:, 2] - r[:, 1])
    return out


def parts_of(p: Page, roi: tuple[int, int, int, int] | None = None, connectivity: int = 4) -> np.ndarray:
    return components(spans(convert(p, BW1).pixels), roi or (0, 0, p.width, p.height), connectivity)


def cleared(p: Page, boxes: np.ndarray) -> Page:
    px = p.pixels.copy()
    for left, top, right, bottom in boxes[:, :4].tolist():
        px[top:bottom, left:right] = white(p.format)
    return p.of(px)


def despeckle(p: Page, mode: str, low: int, high: int) -> Page:
    c = parts_of(p)
    size = np.maximum(c[:, 2] - c[:, 0], c[:, 3] - c[:, 1])
    return cleared(p, c[c[:, 4] == 1] if mode == "single_pixel" else c[(size >= low) & (size <= high)])


def strips(p: Page, edges: dict) -> list[tuple[int, int, int, int]]:
    """The top, bottom, left and right strips of a page, those that are not empty."""
    px = {k: half_up(pixels_of(edges[k], p.dpi_y if k in ("top", "bottom") else p.dpi_x)) for k in ("top", "bottom", "left", "right")}
    w, h = p.width, p.height
    found = [(0, 0, w, min(px["top"], h)), (0, max(0, h - px["bottom"]), w, h), (0, 0, min(px["left"], w), h), (max(0, w - px["right"]), 0, w, h)]
    return [r for r in found if r[0] < r[2] and r[1] < r[3]]


def edge_cleanup(p: Page, edges: dict) -> Page:
    return cleared(p, np.array(strips(p, edges), np.int64).reshape(-1, 4))


def hole_cleanup(p: Page, edges: dict) -> Page:
    """Clears boxes of parts in the strips that are about as large as punch holes and not long; parts are those of the page as it came."""
    runs = spans(p.pixels)
    scale = min(p.dpi_x, p.dpi_y) / 300.0
    low, high = half_up(15 * scale), half_up(60 * scale)
    for roi in strips(p, edges):
        c = components(runs, roi)
        w, h = c[:, 2] - c[:, 0], c[:, 3] - c[:, 1]
        small, large = np.minimum(w, h), np.maximum(w, h)
        p = cleared(p, c[(small >= low) & (large <= high) & (large <= 2.0 * small)])
    return p


def subimage(p: Page, config: dict) -> tuple[tuple[int, int, int, int] | None, np.ndarray]:
    """Bounds of the parts that are large enough and not too large (None without any), and the parts."""
    c = parts_of(p)
    w, h = c[:, 2] - c[:, 0], c[:, 3] - c[:, 1]
    keep = (w >= config["min_width_px"]) & (h >= config["min_height_px"])
    for size, most in ((w, pixels_of(config["max_width"], p.dpi_x)), (h, pixels_of(config["max_height"], p.dpi_y))):
        if most > 0:
            keep &= size <= int(most)
    c = c[keep]
    if not len(c):
        return None, c
    return (int(c[:, 0].min()), int(c[:, 1].min()), int(c[:, 2].max()), int(c[:, 3].max())), c


@dataclass(frozen=True)
class Blank:
    is_blank: bool = False
    percent: float = 0.0
    ink: int = 0
    total: int = 0
    parts: int = 0


def blank_page(p: Page, config: dict) -> Blank:
    if p.empty:
        return Blank(True)
    bw = convert(p, BW1).pixels
    mx, my = int(pixels_of(config["edge_margin"], p.dpi_x)), int(pixels_of(config["edge_margin"], p.dpi_y))
    x0, y0 = min(mx, p.width // 2), min(my, p.height // 2)
    x1, y1 = max(p.width - mx, x0), max(p.height - my, y0)
    inner = bw[max(y0, 0) : y1, max(x0, 0) : x1]
    ink, total = int(inner.sum()), (x1 - x0) * (y1 - y0)
    percent = ink / total * 100.0 if total > 0 else 0.0
    parts = len(components(spans(bw), (x0, y0, x1, y1))) if config["min_components"] > 0 else 0
    return Blank(percent < config["threshold_percent"] or parts < config["min_components"], percent, ink, total, parts)


# placement -----------------------------------------------------------------------------------------------------------------

#: Paper sizes in inches.
PAPERS = {"letter": (8.5, 11.0), "legal": (8.5, 14.0), "tabloid": (11.0, 17.0), "a4": (8.267, 11.692), "a3": (11.692, 16.535)}


def canvas_of(config: dict, dpi_x: float, dpi_y: float, width: int, height: int) -> tuple[int, int]:
    if config["preset"] == "autodetect":
        return width, height
    if config["preset"] == "custom":
        w, h = half_up(pixels_of(config["width"], dpi_x)), half_up(pixels_of(config["height"], dpi_y))
    else:
        inches = PAPERS[config["preset"]]
        w, h = half_up(inches[0] * dpi_x), half_up(inches[1] * dpi_y)
    turned = (config["orientation"] == "landscape" and w < h) or (config["orientation"] == "portrait" and w > h)
    return (h, w) if turned else (w, h)


def _edges_px(edges: dict, p: Page, dpi: tuple[float, float] | None = None) -> dict[str, int]:
    dx, dy = dpi or (p.dpi_x, p.dpi_y)
    return {k: half_up(pixels_of(edges[k].get("distance", edges[k]), dy if k in ("top", "bottom") else dx)) for k in ("top", "left", "right", "bottom")}


def place_by_margins(p: Page, box: tuple[int, int, int, int], margins: dict, canvas: tuple[int, int], keep_outside: bool) -> tuple[Page, tuple[int, int, int, int]]:
    m = _edges_px(margins, p)
    w, h = box[2] - box[0], box[3] - box[1]
    x = m["left"] + (cut_div(canvas[0] - m["left"] - m["right"] - w, 2) if margins["center_horizontal"] else 0)
    y = m["top"] + (cut_div(canvas[1] - m["top"] - m["bottom"] - h, 2) if margins["center_vertical"] else 0)
    sheet = blank(*canvas, p.format, p.dpi_x, p.dpi_y)
    sheet = blit(sheet, p, x - box[0], y - box[1]) if keep_outside else blit(sheet, crop(p, box[0], box[1], w, h), x, y)
    return sheet, (x, y, x + w, y + h)


def resize(p: Page, box: tuple[int, int, int, int], config: dict, second: bool) -> tuple[Page, tuple[int, int, int, int]] | None:
    """The page's content scaled onto a canvas between margins; None if the margins leave no room."""
    dpi = (p.dpi_x if p.dpi_x > 0 else 300.0, p.dpi_y if p.dpi_y > 0 else 300.0)
    whole, part = (0, 0, p.width, p.height), "set2" if second else "set1"
    if config["source"] == "custom":
        e = _edges_px(config[f"source_{part}"], p, dpi)
        src = (e["left"], e["top"], p.width - e["right"], p.height - e["bottom"])
    else:
        src = whole if config["source"] == "full_page" else box
    if src[0] >= src[2] or src[1] >= src[3]:
        src = whole
    content = crop(p, src[0], src[1], src[2] - src[0], src[3] - src[1])
    cw, ch = canvas_of(config["canvas"], *dpi, p.width, p.height)
    m = _edges_px(config[f"margins_{part}"], p, dpi)
    room_w, room_h = cw - m["left"] - m["right"], ch - m["top"] - m["bottom"]
    if room_w <= 0 or room_h <= 0 or content.empty:
        return None
    scale = min(room_w / content.width, room_h / content.height)
    if (scale < 1 and not config["allow_shrink"]) or (scale > 1 and not config["allow_enlarge"]):
        scale = 1.0
    w, h = max(half_up(content.width * scale), 1), max(half_up(content.height * scale), 1)
    if (w, h) != (content.width, content.height):
        content = (scale_bilinear if config["anti_alias"] else scale_nearest)(content, w, h)
    free_w, free_h = room_w - w, room_h - h
    x = {"center": cut_div(free_w, 2), "proportional": int(src[0] / p.width * free_w)}[config["h_alignment"]] + m["left"]
    y = {"top": 0, "center": cut_div(free_h, 2), "bottom": free_h, "proportional": int(src[1] / p.height * free_h)}[config["v_alignment"]] + m["top"]
    return blit(blank(cw, ch, p.format, p.dpi_x, p.dpi_y), content, x, y), (x, y, x + w, y + h)


def limited(moved: tuple[int, int], most: tuple[int, int]) -> tuple[int, int]:
    return tuple(max(-m, min(m, d)) for d, m in zip(moved, most, strict=True))
