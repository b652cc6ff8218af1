"""Scalar functions as column expressions: enums, times, JSON, units, geometry, placement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.schema import JOB_STATES

#: Names and aliases of the enums.
UNITS = {"inches": "inches", "in": "inches", "pixels": "pixels", "px": "pixels", "millimeters": "millimeters", "mm": "millimeters"}
#: Paper sizes in inches, as width and height of the upright sheet.
PAPERS = {"letter": (8.5, 11.0), "legal": (8.5, 14.0), "tabloid": (11.0, 17.0), "a4": (8.267, 11.692), "a3": (11.692, 16.535)}


def normalized(text: Column, names: dict[str, str]) -> Column:
    """The canonical name of an enum value in any case, null if it is none."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(pairs, F.lower(text))


def state_of(text: Column) -> Column:
    return normalized(text, {s: s for s in JOB_STATES})


def rounded(x: Column) -> Column:
    """To whole numbers, halves away from zero."""
    return F.round(x, 0).cast("bigint")


# times ---------------------------------------------------------------------------------------------------------------

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?"


def iso_time(text: Column, zone_required: bool = True) -> Column:
    """ISO 8601 in UTC to a time, null if malformed; a fraction is cut or padded to microseconds."""
    good = text.rlike(ISO + ("Z$" if zone_required else "Z?$"))
    whole = F.substring(text, 1, 19)
    digits = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 6), 6, "0")
    return F.when(good, F.try_to_timestamp(F.concat(F.regexp_replace(whole, "T", " "), F.lit("."), digits), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz"))


def iso_text(time: Column) -> Column:
    """A time with microseconds and Z; null stays null."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# units ---------------------------------------------------------------------------------------------------------------


def to_pixels(value: Column, unit: Column, dpi: Column) -> Column:
    """A measurement in pixels: inches, pixels or millimetres."""
    return F.when(unit == "inches", value * dpi).when(unit == "millimeters", value * dpi / 25.4).otherwise(value)


def from_pixels(pixels: Column, unit: Column, dpi: Column) -> Column:
    return F.when(unit == "inches", pixels / dpi).when(unit == "millimeters", pixels * 25.4 / dpi).otherwise(pixels)


def stride(width: Column, bits: Column) -> Column:
    """Bytes of a padded row: bits rounded up to bytes, bytes to fours."""
    return F.call_function("div", F.call_function("div", width * bits + 7, F.lit(8)) + 3, F.lit(4)) * 4


def canvas(paper: Column, orientation: Column, dpi_x: Column, dpi_y: Column, own_w: Column, own_h: Column) -> Column:
    """struct(width, height): the paper in pixels, turned to its orientation; autodetect is the source's size as it is."""
    w = h = None
    for name, (x, y) in PAPERS.items():
        w = F.when(paper == name, F.lit(x)) if w is None else w.when(paper == name, F.lit(x))
        h = F.when(paper == name, F.lit(y)) if h is None else h.when(paper == name, F.lit(y))
    w, h = rounded(w * dpi_x), rounded(h * dpi_y)
    turn = ((orientation == "landscape") & (w < h)) | ((orientation == "portrait") & (w > h))
    own = paper == "autodetect"
    return F.struct(F.when(own, own_w.cast("bigint")).when(turn, h).otherwise(w).alias("width"), F.when(own, own_h.cast("bigint")).when(turn, w).otherwise(h).alias("height"))


def limited_move(original: Column, placed: Column, limit: Column) -> Column:
    """Where something may be placed: at most ``limit`` from where it was."""
    return original + F.greatest(-limit, F.least(limit, placed - original))


def margin_place(canvas_size: Column, content: Column, before: Column, after: Column, centred: Column) -> Column:
    """The first pixel of content on a canvas: after its margin, or centred between both margins (halves cut towards zero)."""
    return before + F.when(centred, F.call_function("div", canvas_size - before - after - content, F.lit(2))).otherwise(0)


# rectangles (structs of left, top, right, bottom, half-open) -------------------------------------------------------------


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def rect_empty(r: Column) -> Column:
    return (r.left >= r.right) | (r.top >= r.bottom)


def rect_area(r: Column) -> Column:
    return (r.right - r.left).cast("bigint") * (r.bottom - r.top).cast("bigint")


def rect_intersects(a: Column, b: Column) -> Column:
    return (a.left < b.right) & (a.right > b.left) & (a.top < b.bottom) & (a.bottom > b.top)


def rect_intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a.left, b.left), F.greatest(a.top, b.top), F.least(a.right, b.right), F.least(a.bottom, b.bottom))


def rect_union(a: Column, b: Column) -> Column:
    return rect(F.least(a.left, b.left), F.least(a.top, b.top), F.greatest(a.right, b.right), F.greatest(a.bottom, b.bottom))


def rect_contains(a: Column, x: Column, y: Column) -> Column:
    return (x >= a.left) & (x < a.right) & (y >= a.top) & (y < a.bottom)


def combinable(a: Column, b: Column, tolerance: int = 0) -> Column:
    """Whether the union covers no more than both areas and a tolerance."""
    return rect_area(rect_union(a, b)) <= rect_area(a) + rect_area(b) + tolerance


# outputs -------------------------------------------------------------------------------------------------------------


def compression(bits: Column, raster: Column) -> Column:
    """TIFF compression: 1 none, 4 group 4, 5 LZW."""
    return F.when(raster == "raw", 1).when((raster == "lzw") | (bits != 1), 5).otherwise(4)


def output_path(source: Column, directory: Column, suffix: Column, extension: Column, tiff: Column | None = None) -> Column:
    """Folder (given, else the source's) / stem + suffix + extension: the given one, with a dot; else .tif if ``tiff`` holds,
    as it does by default; else the source's; else .tif.
    """
    name = F.regexp_extract(source, r"([^/]*)$", 1)
    stem, own = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    ext = F.when(F.coalesce(extension, F.lit("")) != "", F.concat(F.when(extension.startswith("."), "").otherwise("."), extension)).when(F.lit(True) if tiff is None else tiff, ".tif").when(own != "", own).otherwise(".tif")
    folder = F.when(F.coalesce(directory, F.lit("")) != "", directory).otherwise(F.regexp_extract(source, r"^(.*)/[^/]*$", 1))
    return F.concat(folder, F.lit("/"), stem, F.coalesce(suffix, F.lit("")), ext)


def file_filter(path: Column, kind: str) -> Column:
    """Whether a file is shown: ``pages`` (TIFF and BMP), ``tiff``, ``bmp``, or any other word for all files."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    shown = {"pages": ("tif", "tiff", "bmp"), "tiff": ("tif", "tiff"), "bmp": ("bmp",)}
    return ext.isin(*shown[kind]) if kind in shown else F.lit(True)


def decoder_of(path: Column) -> Column:
    """Which decoder a file goes to by its extension; ``probe`` tries TIFF, then BMP."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ext.isin("tif", "tiff"), "tiff").when(ext == "bmp", "bmp").otherwise("probe")
