"""Queries over page rasters, with the SQL that states their results.

``pixels`` are 64 x 48 grey pages from order lines, ``tiles`` 8 x 8 grey pages from embeddings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import expressions as X
from pagemill.operators import components as C, pixels as R
from pagemill.plans import codec_udfs, directory, page_pipeline, profile as profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

W, H, T = 64, 48, 8


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark, d):
    key = [F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % W).cast("int").alias("x"), (F.col("l_orderkey") % H).cast("int").alias("y")]
    return table(spark, d, "lineitem").groupBy(*key).agg((F.max("l_quantity") * 5).cast("int").alias("v"))


def tiles(spark, d):
    v = F.least(F.greatest(F.floor(128 + F.col("e").cast("double") * 256), F.lit(0)), F.lit(255)).cast("int")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return rows.select("image_id", (F.col("i") % T).alias("x"), R.div(F.col("i"), T).cast("int").alias("y"), v.alias("v"))


def bits(rows, below=128):
    return rows.select("image_id", "x", "y", F.when(F.col("v") < below, 1).otherwise(0).alias("v"))


def ink(rows):
    return rows.filter("v < 128").select("image_id", "x", "y")


PIXELS = f"pixels AS (SELECT l_suppkey AS image_id, CAST(l_partkey % {W} AS INTEGER) AS x, CAST(l_orderkey % {H} AS INTEGER) AS y, CAST(max(l_quantity) * 5 AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3)"
TILES = (
    f"tiles AS (SELECT vec_id AS image_id, CAST(i % {T} AS INTEGER) AS x, CAST(i // {T} AS INTEGER) AS y, CAST(least(greatest(floor(128 + CAST(embedding[i + 1] AS DOUBLE) * 256), 0), 255) AS INTEGER) AS v"
    f" FROM embeddings, range({T * T}) AS r(i))"
)
BITS = "bits AS (SELECT image_id, x, y, CASE WHEN v < 128 THEN 1 ELSE 0 END AS v FROM tiles)"
SPANS = "spans AS (SELECT image_id, y AS \"row\", CAST(min(x) AS INTEGER) AS col_start, CAST(max(x) + 1 AS INTEGER) AS col_end FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM pixels WHERE v < 128) GROUP BY image_id, y, g)"


def _parts(reach: int = 0) -> str:
    """Components by the closure of overlapping spans of neighbouring rows; the label is the rank of the first span."""
    return (
        f"s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY \"row\", col_start) AS sid FROM spans),"
        f" e AS (SELECT a.image_id, a.sid AS p, b.sid AS q FROM s a JOIN s b ON a.image_id = b.image_id AND a.\"row\" = b.\"row\" + 1 AND a.col_start < b.col_end + {reach} AND a.col_end + {reach} > b.col_start),"
        " e2 AS (SELECT image_id, p, q FROM e UNION SELECT image_id, q, p FROM e),"
        " reached AS (SELECT image_id, sid, sid AS root FROM s UNION SELECT r.image_id, e2.q, r.root FROM reached r JOIN e2 ON e2.image_id = r.image_id AND e2.p = r.sid),"
        " rooted AS (SELECT image_id, sid, min(root) AS root FROM reached GROUP BY image_id, sid),"
        " parts AS (SELECT s.image_id, root, CAST(min(col_start) AS INTEGER) AS \"left\", CAST(min(\"row\") AS INTEGER) AS top, CAST(max(col_end) AS INTEGER) AS \"right\", CAST(max(\"row\") + 1 AS INTEGER) AS bottom,"
        " CAST(sum(col_end - col_start) AS BIGINT) AS pixel_count FROM s JOIN rooted USING (image_id, sid) GROUP BY s.image_id, root),"
        " labelled AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY root) - 1 AS label, \"left\", top, \"right\", bottom, pixel_count FROM parts)"
    )


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return put


def _with(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"


# values ---------------------------------------------------------------------------------------------------------------

HIST = "hist AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY image_id, v)"
RUN = "run AS (SELECT *, CAST(sum(n) OVER up AS BIGINT) AS c, CAST(sum(v * n) OVER up AS BIGINT) AS s, CAST(sum(n) OVER a AS BIGINT) AS total, CAST(sum(v * n) OVER a AS BIGINT) AS all_s FROM hist WINDOW up AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id))"
OTSU = (
    "var AS (SELECT image_id, v, CASE WHEN total > c THEN CAST(total - c AS DOUBLE) * c * pow(CAST(s AS DOUBLE) / c - CAST(all_s - s AS DOUBLE) / (total - c), 2) END AS w FROM run),"
    " otsu AS (SELECT image_id, CASE WHEN w > 0 THEN v ELSE 0 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w DESC NULLS LAST, v) AS r FROM var) WHERE r = 1)"
)


@query("pixel_histogram", _with("SELECT image_id, v, n FROM hist", PIXELS, HIST))
def pixel_histogram(spark, d):
    return R.histogram(pixels(spark, d))


@query("histogram_stats", _with("SELECT image_id, round(max(all_s) / max(total), 6) AS mean, min(CASE WHEN c > total // 2 THEN v END) AS median, min(v) AS least, max(v) AS most FROM run GROUP BY image_id", PIXELS, HIST, RUN))
def histogram_stats(spark, d):
    return R.histogram_stats(R.histogram(pixels(spark, d)))


@query("otsu_threshold", _with("SELECT image_id, threshold FROM otsu", PIXELS, HIST, RUN, OTSU))
def otsu_threshold(spark, d):
    return R.otsu(R.histogram(pixels(spark, d)))


@query("binarize_otsu", _with("SELECT image_id, x, y, CASE WHEN v <= threshold THEN 1 ELSE 0 END AS v FROM pixels JOIN otsu USING (image_id)", PIXELS, HIST, RUN, OTSU))
def binarize_otsu(spark, d):
    p = pixels(spark, d)
    return p.join(R.otsu(R.histogram(p)), "image_id").select("image_id", "x", "y", F.when(F.col("v") <= F.col("threshold"), 1).otherwise(0).alias("v"))


@query("gray_to_bw", _with("SELECT image_id, x, y, CASE WHEN v < 128 THEN 1 ELSE 0 END AS v FROM pixels", PIXELS))
def gray_to_bw(spark, d):
    return bits(pixels(spark, d))


@query("invert", _with("SELECT image_id, x, y, 255 - v AS v FROM tiles", TILES))
def invert(spark, d):
    return tiles(spark, d).select("image_id", "x", "y", (255 - F.col("v")).alias("v"))


def _rgb():
    v = F.col("v")
    return v, v * 3 % 256, 255 - v


@query("rgb_to_gray", _with("SELECT image_id, x, y, (77 * v + 150 * (v * 3 % 256) + 29 * (255 - v) + 128) >> 8 AS gray, CAST(floor(0.299 * v + 0.587 * (v * 3 % 256) + 0.114 * (255 - v) + 0.5) AS INTEGER) AS luminance FROM pixels", PIXELS))
def rgb_to_gray(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", R.gray(*_rgb()).alias("gray"), R.luminance(*_rgb()).alias("luminance"))


@query("color_dropout", _with("SELECT image_id, x, y, CASE WHEN drop THEN 255 ELSE v END AS r, CASE WHEN drop THEN 255 ELSE v * 3 % 256 END AS g, CASE WHEN drop THEN 255 ELSE 255 - v END AS b FROM (SELECT *, v - ((v * 3 % 256) + (255 - v)) // 2 > 30 AS drop FROM pixels)", PIXELS))
def color_dropout(spark, d):
    r, g, b = _rgb()
    drop = R.dropped(r, g, b, 30)
    white = lambda c, name: F.when(drop, 255).otherwise(c).alias(name)
    return pixels(spark, d).select("image_id", "x", "y", white(r, "r"), white(g, "g"), white(b, "b"))


# places ---------------------------------------------------------------------------------------------------------------


@query("crop", _with("SELECT image_id, x - 2 AS x, y AS y, v FROM tiles WHERE x BETWEEN 2 AND 6 AND y BETWEEN 0 AND 3", TILES))
def crop(spark, d):
    return R.crop(tiles(spark, d), 2, -1, 5, 4)


for _how, _x, _y in (("cw90", "7 - y", "x"), ("ccw90", "y", "7 - x"), ("180", "7 - x", "7 - y")):

    @query(f"rotate_{_how}", _with(f"SELECT image_id, {_x} AS x, {_y} AS y, v FROM tiles", TILES))
    def rotate(spark, d, how=_how):
        return R.rotate(tiles(spark, d), how, T, T)


_GRID = "grid AS (SELECT DISTINCT image_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM tiles, range({w}) AS a(gx), range({h}) AS b(gy))"


@query("pad", _with("SELECT g.image_id, g.x, g.y, coalesce(t.v, 17) AS v FROM grid g LEFT JOIN tiles t ON t.image_id = g.image_id AND t.x + 2 = g.x AND t.y + 1 = g.y", TILES, _GRID.format(w=13, h=13)))
def pad(spark, d):
    return R.pad(tiles(spark, d), T, T, 1, 2, 3, 4, 17)


_ONCE = TILES.replace("tiles AS (", "tiles AS MATERIALIZED (", 1)


@query("blit", _with("SELECT image_id, x, y, coalesce(m.v, a.v) AS v FROM tiles a LEFT JOIN moved m USING (image_id, x, y)", _ONCE, "moved AS MATERIALIZED (SELECT image_id, x + 3 AS x, y - 2 AS y, 255 - v AS v FROM tiles)"))
def blit(spark, d):
    t = tiles(spark, d)
    return R.blit(t, t.withColumn("v", 255 - F.col("v")), 3, -2)


_NEAREST = f"places AS MATERIALIZED (SELECT image_id, x, y, least(CAST(floor(x * CAST({T / 12!r} AS DOUBLE)) AS INTEGER), 7) AS sx, least(CAST(floor(y * CAST({T / 5!r} AS DOUBLE)) AS INTEGER), 7) AS sy FROM grid)"


@query("scale_nearest", _with("SELECT p.image_id, p.x, p.y, s.v FROM places p JOIN (SELECT image_id, x AS sx, y AS sy, v FROM tiles) s USING (image_id, sx, sy)", _ONCE, _GRID.format(w=12, h=5), _NEAREST))
def scale_nearest(spark, d):
    return R.scale_nearest(tiles(spark, d), T, T, 12, 5)


_FX, _FY = f"CAST({7 / 10!r} AS DOUBLE)", f"CAST({7 / 4!r} AS DOUBLE)"
_CORNERS = (
    f"p AS (SELECT *, x * {_FX} - floor(x * {_FX}) AS wx, y * {_FY} - floor(y * {_FY}) AS wy, CAST(floor(x * {_FX}) AS INTEGER) AS x0, CAST(floor(y * {_FY}) AS INTEGER) AS y0 FROM grid),"
    " corners AS (SELECT image_id, x, y, x0 AS sx, y0 AS sy, (1 - wx) * (1 - wy) AS w FROM p UNION ALL SELECT image_id, x, y, least(x0 + 1, 7), y0, wx * (1 - wy) FROM p"
    " UNION ALL SELECT image_id, x, y, x0, least(y0 + 1, 7), (1 - wx) * wy FROM p UNION ALL SELECT image_id, x, y, least(x0 + 1, 7), least(y0 + 1, 7), wx * wy FROM p)"
)


@query("scale_bilinear", _with("SELECT c.image_id, c.x, c.y, CAST(floor((sum(CAST(round(w * v * 1e7) AS BIGINT)) + 5000000) / 1e7) AS INTEGER) AS v FROM corners c JOIN tiles t ON t.image_id = c.image_id AND t.x = sx AND t.y = sy GROUP BY c.image_id, c.x, c.y", TILES, _GRID.format(w=11, h=5), _CORNERS))
def scale_bilinear(spark, d):
    return R.scale_bilinear(tiles(spark, d), T, T, 11, 5)


def _morph(name: str, src: str, how: str, near: str, n: int) -> str:
    agg = "max(b.v)" if how == "dilate" else f"CASE WHEN sum(b.v) = {n} THEN 1 ELSE 0 END"
    return f"{name} AS (SELECT a.image_id, a.x, a.y, CAST({agg} AS INTEGER) AS v FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND {near} GROUP BY a.image_id, a.x, a.y)"


_SQUARE, _CROSS = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1", "abs(a.x - b.x) + abs(a.y - b.y) <= 1"


@query("dilate", _with("SELECT * FROM m", TILES, BITS, _morph("m", "bits", "dilate", _CROSS, 5)))
def dilate(spark, d):
    return R.morph(bits(tiles(spark, d)), "dilate", T, T, R.CROSS)


@query("erode", _with("SELECT * FROM m", TILES, BITS, _morph("m", "bits", "erode", _SQUARE, 9)))
def erode(spark, d):
    return R.morph(bits(tiles(spark, d)), "erode", T, T)


@query("morph_open", _with("SELECT * FROM m2", TILES, BITS, _morph("m", "bits", "erode", _CROSS, 5), _morph("m2", "m", "dilate", _CROSS, 5)))
def morph_open(spark, d):
    return R.morph(R.morph(bits(tiles(spark, d)), "erode", T, T, R.CROSS), "dilate", T, T, R.CROSS)


@query("morph_close", _with("SELECT * FROM m2", TILES, BITS, _morph("m", "bits", "dilate", _SQUARE, 9), _morph("m2", "m", "erode", _SQUARE, 9)))
def morph_close(spark, d):
    return R.morph(R.morph(bits(tiles(spark, d)), "dilate", T, T), "erode", T, T)


@query("edge_cleanup", _with("SELECT image_id, x, y, CASE WHEN x < 4 OR x >= 58 OR y < 3 OR y >= 43 THEN 255 ELSE v END AS v FROM pixels", PIXELS))
def edge_cleanup(spark, d):
    return R.edge_cleanup(pixels(spark, d), W, H, 3, 4, 6, 5)


@query("blank_page", _with(f"SELECT image_id, CAST(sum(CASE WHEN v < 128 THEN 1 ELSE 0 END) AS BIGINT) AS foreground, round(sum(CASE WHEN v < 128 THEN 1 ELSE 0 END) / {W * H} * 100.0, 6) AS percent, sum(CASE WHEN v < 128 THEN 1 ELSE 0 END) / {W * H} * 100.0 < 9.0 AS is_blank FROM pixels GROUP BY image_id", PIXELS))
def blank_page(spark, d):
    return R.blank(bits(pixels(spark, d)), W * H, 9.0)


# spans, components, rectangles ------------------------------------------------------------------------------------------


def span_rows(spark, d):
    return R.spans(ink(pixels(spark, d)))


@query("spans", _with("SELECT image_id, \"row\", col_start, col_end FROM spans", PIXELS, SPANS))
def spans(spark, d):
    return span_rows(spark, d)


for _n, _reach in ((4, 0), (8, 1)):

    @query(f"components_{_n}", _with("SELECT * FROM labelled", PIXELS, SPANS, _parts(_reach), recursive=True))
    def components_n(spark, d, n=_n):
        return C.components(span_rows(spark, d), n)


_ROI = (8, 6, 40, 30)
_IN_ROI = (
    f"spans AS (SELECT image_id, \"row\", greatest(col_start, {_ROI[0]}) AS col_start, least(col_end, {_ROI[2]}) AS col_end FROM all_spans"
    f" WHERE \"row\" >= {_ROI[1]} AND \"row\" < {_ROI[3]} AND col_start < {_ROI[2]} AND col_end > {_ROI[0]})"
)


@query("components_roi", _with("SELECT * FROM labelled", PIXELS, SPANS.replace("spans AS", "all_spans AS", 1), _IN_ROI, _parts(), recursive=True))
def components_roi(spark, d):
    """Parts of what is inside a region; spans are cut at its edges."""
    return C.components(span_rows(spark, d), 4, _ROI)


@query("component_stats", _with("SELECT image_id, count(*) AS parts, CAST(sum(pixel_count) AS BIGINT) AS ink, max(pixel_count) AS largest FROM labelled GROUP BY image_id", PIXELS, SPANS, _parts(), recursive=True))
def component_stats(spark, d):
    return C.components(span_rows(spark, d)).groupBy("image_id").agg(F.count("*").alias("parts"), F.sum("pixel_count").alias("ink"), F.max("pixel_count").alias("largest"))


@query("subimage_bounds", _with("SELECT image_id, min(\"left\") AS \"left\", min(top) AS top, max(\"right\") AS \"right\", max(bottom) AS bottom, count(*) AS parts FROM labelled WHERE \"right\" - \"left\" >= 2 AND bottom - top >= 2 GROUP BY image_id", PIXELS, SPANS, _parts(), recursive=True))
def subimage_bounds(spark, d):
    return C.bounds(C.sized(C.components(span_rows(spark, d)), 2, 2))


_ERASED = "SELECT p.image_id, p.x, p.y FROM pixels p WHERE v < 128 AND NOT EXISTS (SELECT 1 FROM labelled b WHERE b.image_id = p.image_id AND p.x >= b.\"left\" AND p.x < b.\"right\" AND p.y >= b.top AND p.y < b.bottom AND {})"


@query("despeckle", _with(_ERASED.format("greatest(\"right\" - \"left\", bottom - top) BETWEEN 1 AND 2"), PIXELS, SPANS, _parts(), recursive=True))
def despeckle(spark, d):
    i = ink(pixels(spark, d))
    size = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    return C.erased(i, C.components(R.spans(i)).filter(size.between(1, 2)))


@query("hole_cleanup", _with(_ERASED.format("least(\"right\" - \"left\", bottom - top) >= 2 AND greatest(\"right\" - \"left\", bottom - top) <= 6 AND greatest(\"right\" - \"left\", bottom - top) <= 2 * least(\"right\" - \"left\", bottom - top)"), PIXELS, SPANS, _parts(), recursive=True))
def hole_cleanup(spark, d):
    i = ink(pixels(spark, d))
    return C.erased(i, C.holes(C.components(R.spans(i)), 0.1))


@query("rect_sort", _with("SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY top DESC, \"left\", label) AS position FROM labelled", PIXELS, SPANS, _parts(), recursive=True))
def rect_sort(spark, d):
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("image_id").orderBy(*C.sort_order("bottom_top"))).cast("bigint")
    return C.components(span_rows(spark, d)).select("image_id", "label", at.alias("position"))


@query(
    "rect_bands",
    _with(
        "SELECT image_id, label, CAST(sum(fresh) OVER (PARTITION BY image_id ORDER BY top, \"left\", label) - 1 AS BIGINT) AS band FROM (SELECT *, CASE WHEN reach IS NULL OR top >= reach THEN 1 ELSE 0 END AS fresh FROM"
        " (SELECT *, max(bottom) OVER (PARTITION BY image_id ORDER BY top, \"left\", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM labelled))",
        PIXELS, SPANS, _parts(), recursive=True,
    ),
)
def rect_bands(spark, d):
    return C.bands(C.components(span_rows(spark, d))).select("image_id", "label", "band")


def _two_rects(spark, d):
    k, q = F.col("l_partkey"), F.col("l_suppkey")
    a = X.rect(k % 40, q % 30, k % 40 + 10, q % 30 + 8)
    b = X.rect(q % 50, k % 20, q % 50 + 12, k % 20 + 9)
    return table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), a.alias("a"), b.alias("b"))


_RECTS = "rects AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 40 AS al, l_suppkey % 30 AS atop, l_partkey % 40 + 10 AS ar, l_suppkey % 30 + 8 AS ab, l_suppkey % 50 AS bl, l_partkey % 20 AS bt, l_suppkey % 50 + 12 AS br, l_partkey % 20 + 9 AS bb FROM lineitem)"


@query("rect_algebra", _with("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, al < br AND ar > bl AND atop < bb AND ab > bt AS meets, least(al, bl) AS u_left, greatest(ab, bb) AS u_bottom, CASE WHEN al < br AND ar > bl AND atop < bb AND ab > bt THEN (least(ar, br) - greatest(al, bl)) * (least(ab, bb) - greatest(atop, bt)) ELSE 0 END AS common, bl >= al AND bl < ar AND bt >= atop AND bt < ab AS inside FROM rects", _RECTS))
def rect_algebra(spark, d):
    a, b = F.col("a"), F.col("b")
    u = X.rect_union(a, b)
    common = F.when(X.rect_intersects(a, b), X.rect_area(X.rect_intersection(a, b))).otherwise(0)
    return _two_rects(spark, d).select("k.*", X.rect_intersects(a, b).alias("meets"), u.left.alias("u_left"), u.bottom.alias("u_bottom"), common.alias("common"), X.rect_contains(a, b.left, b.top).alias("inside"))


@query("rect_combinable_pairs", _with("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM rects WHERE (greatest(ar, br) - least(al, bl)) * (greatest(ab, bb) - least(atop, bt)) <= 10 * 8 + 12 * 9 + 50", _RECTS))
def rect_combinable_pairs(spark, d):
    return _two_rects(spark, d).filter(X.combinable(F.col("a"), F.col("b"), 50)).select("k.*")


# numbers --------------------------------------------------------------------------------------------------------------

_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("unit_to_pixels", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 300, 6) AS from_inches, round(l_quantity * 300 / 25.4, 6) AS from_mm, l_quantity AS from_pixels, round(l_quantity / 300, 6) AS to_inches, CAST(floor(l_quantity * 0.5 + 0.5) AS BIGINT) AS halves, (l_partkey * 24 + 31) // 32 * 4 AS stride FROM lineitem")
def unit_to_pixels(spark, d):
    q, dpi = F.col("l_quantity"), F.lit(300.0)
    px = lambda unit: X.to_pixels(q, F.lit(unit), dpi)
    return table(spark, d, "lineitem").select(
        *_KEYS, F.round(px("inches"), 6).alias("from_inches"), F.round(px("millimeters"), 6).alias("from_mm"), px("pixels").alias("from_pixels"), F.round(X.from_pixels(q, F.lit("inches"), dpi), 6).alias("to_inches"),
        X.rounded(q * 0.5).alias("halves"), X.stride(F.col("l_partkey"), F.lit(24)).alias("stride"),
    )


_PAPER = "CASE p_size % 6 WHEN 0 THEN 'letter' WHEN 1 THEN 'legal' WHEN 2 THEN 'tabloid' WHEN 3 THEN 'a4' WHEN 4 THEN 'a3' ELSE 'autodetect' END"


def _inches(i: int) -> str:
    return " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in X.PAPERS.items())


@query(
    "canvas_resolve",
    f"SELECT p_partkey, CASE WHEN paper = 'autodetect' THEN p_size * 10 WHEN turned THEN h ELSE w END AS width, CASE WHEN paper = 'autodetect' THEN p_size * 7 WHEN turned THEN w ELSE h END AS height FROM"
    f" (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN w < h ELSE w > h END AS turned FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, {_PAPER} AS paper, CAST(round(CASE {_PAPER} {_inches(0)} END * 300) AS BIGINT) AS w,"
    f" CAST(round(CASE {_PAPER} {_inches(1)} END * 200) AS BIGINT) AS h FROM part))",
)
def canvas_resolve(spark, d):
    paper = F.element_at(F.array(*map(F.lit, [*X.PAPERS, "autodetect"])), F.col("p_size") % 6 + 1)
    turn = F.when(F.col("p_partkey") % 2 == 0, "landscape").otherwise("portrait")
    c = X.canvas(paper, turn, F.lit(300.0), F.lit(200.0), F.col("p_size") * 10, F.col("p_size") * 7)
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.width", "c.height")


@query("movement_limit", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey + greatest(-150, least(150, l_partkey - l_suppkey)) AS placed, l_partkey - l_suppkey NOT BETWEEN -150 AND 150 AS clamped FROM lineitem")
def movement_limit(spark, d):
    placed = X.limited_move(F.col("l_suppkey"), F.col("l_partkey"), F.lit(150))
    return table(spark, d, "lineitem").select(*_KEYS, placed.alias("placed"), (placed != F.col("l_partkey")).alias("clamped"))


@query("margin_placement", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey + CAST(trunc((1000 - l_suppkey - l_linenumber - l_partkey) / 2.0) AS BIGINT) ELSE l_suppkey END AS place FROM lineitem")
def margin_placement(spark, d):
    """Content of l_partkey pixels on 1000, with margins of l_suppkey before and l_linenumber after it."""
    place = X.margin_place(F.lit(1000), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_linenumber") % 2 == 0)
    return table(spark, d, "lineitem").select(*_KEYS, place.alias("place"))


_PATH = "'/in/' || p_brand || '/' || replace(p_name, ' ', '_')"
_EXT = "CASE p_size % 4 WHEN 0 THEN '.TIF' WHEN 1 THEN '.bmp' WHEN 2 THEN '.pdf' ELSE '' END"


def _paths(spark, d):
    ext = F.element_at(F.array(F.lit(".TIF"), F.lit(".bmp"), F.lit(".pdf"), F.lit("")), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("/in/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), ext).alias("path"))


@query("format_dispatch", f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'tiff' WHEN 1 THEN 'bmp' ELSE 'probe' END AS decoder FROM part")
def format_dispatch(spark, d):
    return _paths(spark, d).select("p_partkey", X.decoder_of(F.col("path")).alias("decoder"))


@query("output_paths", f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/out' ELSE '/in/' || p_brand END || '/' || replace(p_name, ' ', '_') || '_clean' || CASE WHEN p_size % 5 = 0 THEN '.png' WHEN p_size % 7 < 4 THEN '.tif' WHEN {_EXT} <> '' THEN {_EXT} ELSE '.tif' END AS path FROM part")
def output_paths(spark, d):
    folder, ext = F.when(F.col("p_size") % 3 == 0, F.lit("/out")), F.when(F.col("p_size") % 5 == 0, F.lit("png"))
    return _paths(spark, d).select("p_partkey", X.output_path(F.col("path"), folder, F.lit("_clean"), ext, F.col("p_size") % 7 < 4).alias("path"))


@query("compression_choice", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 OR p_size % 2 = 0 THEN 5 ELSE 4 END AS compression FROM part")
def compression_choice(spark, d):
    raster = F.element_at(F.array(F.lit("raw"), F.lit("lzw"), F.lit("jpeg")), F.col("p_size") % 3 + 1)
    depth = F.when(F.col("p_size") % 2 == 0, 8).otherwise(1)
    return table(spark, d, "part").select("p_partkey", X.compression(depth, raster).alias("compression"))


# pages ----------------------------------------------------------------------------------------------------------------


def bw_pages(spark, d):
    return C.pages_of(bits(pixels(spark, d)), W, H, 1)


def gray_pages(spark, d):
    return C.pages_of(tiles(spark, d), T, T, 8)


_DENSE = (
    f"SELECT g.image_id, g.x, g.y, CASE WHEN p.v < 128 THEN 1 ELSE 0 END AS v FROM (SELECT DISTINCT image_id, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM pixels, range({W}) AS a(gx), range({H}) AS b(gy)) g"
    " LEFT JOIN pixels p ON p.image_id = g.image_id AND p.x = g.x AND p.y = g.y"
)

for _how in ("raw", "packbits", "lzw", "g4"):

    @query(f"tiff_roundtrip_{_how}", _with(_DENSE, PIXELS))
    def tiff_roundtrip(spark, d, how=_how):
        return C.pixels_of(codec_udfs.decoded(codec_udfs.encoded(bw_pages(spark, d), "tiff", how), "tiff"))


@query("bmp_roundtrip", _with("SELECT image_id, x, y, v FROM tiles", TILES))
def bmp_roundtrip(spark, d):
    return C.pixels_of(codec_udfs.decoded(codec_udfs.encoded(gray_pages(spark, d), "bmp"), "bmp"))


@query("tiff_multipage", _with("SELECT image_id, x, y, v FROM tiles", TILES))
def tiff_multipage(spark, d):
    """Ten pages a file; the pages read back are numbered as they were."""
    pages = gray_pages(spark, d).withColumns({"file": R.div(F.col("image_id"), 10), "page_index": (F.col("image_id") % 10).cast("int")})
    read = codec_udfs.split_files(codec_udfs.joined_files(pages, "lzw"))
    return C.pixels_of(read.withColumn("image_id", F.col("file") * 10 + F.col("page_index")))


@query("tiff_tags", _with(f"SELECT image_id, CAST({W} AS BIGINT) AS width, CAST({H} AS BIGINT) AS height, CAST(4 AS BIGINT) AS compression, CAST(300 AS DOUBLE) AS dpi_x, CAST(0 AS BIGINT) AS photometric, 'pagemill' AS software FROM (SELECT DISTINCT image_id FROM pixels)", PIXELS))
def tiff_tags(spark, d):
    return codec_udfs.tags(codec_udfs.encoded(bw_pages(spark, d), "tiff", "g4")).select("image_id", "width", "height", "compression", "dpi_x", "photometric", "software")


@query("pdf_objects", _with("SELECT image_id, CAST(5 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS pages FROM (SELECT DISTINCT image_id FROM tiles)", TILES))
def pdf_objects(spark, d):
    text = F.decode("bytes", "ISO-8859-1")
    found = codec_udfs.encoded(gray_pages(spark, d), "pdf").select("image_id", text.alias("t"))
    return found.select("image_id", F.regexp_count("t", F.lit(r"\d+ 0 obj\n")).cast("bigint").alias("objects"), F.regexp_count("t", F.lit(r"/Type /Page ")).cast("bigint").alias("pages"))


def _profile(**more):
    inch = lambda v: {"value": v, "unit": "pixels"}
    canvas = {"preset": "custom", "width": inch(96), "height": inch(80), "orientation": "landscape"}
    base = {"canvas": canvas, "subimage": {"min_width_px": 1, "min_height_px": 1}, "margins": [{"left": {"distance": inch(7)}, "top": {"distance": inch(5)}}], "keep_outside_subimage": True}
    return profiles.merge(profiles.profile(**base), more)


@query("apply_margins", _with("SELECT image_id, x + 7 - mx AS x, y + 5 - my AS y FROM pixels JOIN (SELECT image_id, min(x) AS mx, min(y) AS my FROM pixels WHERE v < 128 GROUP BY image_id) USING (image_id) WHERE v < 128", PIXELS))
def apply_margins(spark, d):
    done = page_pipeline.run_pages(bw_pages(spark, d), _profile())
    return C.pixels_of(done).filter("v = 1").select("image_id", "x", "y")


@query("apply_resize", _with("SELECT image_id, CAST(2 * x + a AS INTEGER) AS x, CAST(2 * y + b AS INTEGER) AS y, v FROM tiles, range(2) AS p(a), range(2) AS q(b)", TILES))
def apply_resize(spark, d):
    """Pages of 8 x 8 onto canvases of 16 x 16 without margins: every pixel becomes four."""
    px = lambda v: {"value": v, "unit": "pixels"}
    resize = {"enabled": True, "source": "full_page", "canvas": {"preset": "custom", "width": px(16), "height": px(16)}}
    return C.pixels_of(page_pipeline.run_pages(gray_pages(spark, d), profiles.profile(resize=resize), only="resize"))


def _results(spark, d):
    more = {"deskew": {"enabled": True}, "despeckle": {"mode": "single_pixel"}, "blank_page": {"enabled": True, "threshold_percent": 9.0}, "edge_cleanup": {"enabled": True, "set1": {"top": {"value": 1, "unit": "px"}}}}
    return page_pipeline.run_pages(bw_pages(spark, d), _profile(**more))


@query("pipeline_steps")
def pipeline_steps(spark, d):
    return _results(spark, d).select("image_id", F.posexplode("steps").alias("position", "step")).select("image_id", "position", "step.name", "step.applied", "step.detail")


@query("pipeline_run_step", _with("SELECT image_id, 'rotated CW 90 degrees' AS detail, 48 AS width, 64 AS height FROM (SELECT DISTINCT image_id FROM pixels)", PIXELS))
def pipeline_run_step(spark, d):
    done = page_pipeline.run_pages(bw_pages(spark, d), profiles.profile(rotation="cw90"), only="rotate")
    return done.select("image_id", F.col("steps")[0].detail.alias("detail"), "width", "height")


_BLANKS = f"(SELECT image_id, sum(CASE WHEN v < 128 THEN 1 ELSE 0 END) / {W * H} * 100.0 < 9.0 AS is_blank FROM pixels GROUP BY image_id)"


def _blank_results(spark, d):
    return page_pipeline.run_pages(bw_pages(spark, d), _profile(blank_page={"enabled": True, "threshold_percent": 9.0}))


@query("batch_summary", _with(f"SELECT count(*) AS total, count(*) AS succeeded, CAST(0 AS BIGINT) AS failed, count(*) FILTER (is_blank) AS blank, true AS success, CAST(NULL AS VARCHAR) AS error FROM {_BLANKS}", PIXELS))
def batch_summary(spark, d):
    return page_pipeline.batch_summary(_blank_results(spark, d))


@query("collected_pages", _with(f"SELECT image_id FROM {_BLANKS} WHERE NOT is_blank", PIXELS))
def collected_pages(spark, d):
    return page_pipeline.collected(_blank_results(spark, d)).select("image_id")


@query("good_list")
def good_list(spark, d):
    return page_pipeline.good_list(_results(spark, d))


_PLAIN_STEPS = (
    ("rotate", "false", "'no rotation'"), ("edge_cleanup", "false", "'disabled'"), ("deskew", "false", "'disabled'"), ("hole_cleanup", "false", "'disabled'"), ("despeckle", "false", "'disabled'"),
    ("detect_subimage", "true", "'content at (' || mx || ',' || my || ') ' || (1 + bx - mx) || 'x' || (1 + b_y - my) || ' px, ' || parts || ' components'"), ("blank_page", "false", "'disabled'"),
    ("margins", "true", "'positioned content at (7,5) on 96x80 canvas'"),
)
_PLAIN_LOG = " UNION ALL ".join(f"SELECT image_id, {i} AS position, '{n}' AS name, {a} AS applied, {t} AS detail FROM pages" for i, (n, a, t) in enumerate(_PLAIN_STEPS))
_PLAIN_PAGES = (
    "pages AS (SELECT image_id, min(x) AS mx, min(y) AS my, max(x) AS bx, max(y) AS b_y, any_value(parts) AS parts FROM pixels"
    " JOIN (SELECT image_id, count(*) AS parts FROM labelled GROUP BY image_id) USING (image_id) WHERE v < 128 GROUP BY image_id)"
)


def _plain_results(spark, d):
    return page_pipeline.run_pages(bw_pages(spark, d), _profile())


@query("pipeline_log", _with(_PLAIN_LOG, PIXELS, SPANS, _parts(), _PLAIN_PAGES, recursive=True))
def pipeline_log(spark, d):
    return _plain_results(spark, d).select("image_id", F.posexplode("steps").alias("position", "step")).select("image_id", "position", "step.name", "step.applied", "step.detail")


_STEP_JSON = "'{\"name\":\"' || name || '\",\"applied\":' || applied || ',\"detail\":\"' || detail || '\"}'"


@query(
    "good_list_plain",
    _with(
        "SELECT image_id, 0 AS page_index, '{\"image_id\":' || image_id || ',\"page_index\":0,\"is_blank\":false,\"steps_applied\":[\"detect_subimage\",\"margins\"],\"step_details\":[' ||"
        f" string_agg({_STEP_JSON}, ',' ORDER BY position) || ']}}' AS json FROM ({_PLAIN_LOG}) GROUP BY image_id",
        PIXELS, SPANS, _parts(), _PLAIN_PAGES, recursive=True,
    ),
)
def good_list_plain(spark, d):
    return page_pipeline.good_list(_plain_results(spark, d))


@query("quality_exceptions", _with("SELECT image_id, 0 AS page_index, 'unknown step: bleach' AS reason FROM (SELECT DISTINCT image_id FROM tiles)", TILES))
def quality_exceptions(spark, d):
    return directory.quality_lists(page_pipeline.run_pages(gray_pages(spark, d), profiles.profile(), only="bleach"))[0]


@query(
    "steps_alone",
    _with(
        "SELECT image_id, step, applied, detail FROM (SELECT DISTINCT image_id FROM tiles), (VALUES ('rotate', false, 'no rotation'), ('color_dropout', false, 'disabled'), ('resize', false, 'no resize applied'),"
        " ('hole_cleanup', false, 'disabled'), ('despeckle', false, 'skipped (not BW1)')) AS s(step, applied, detail)",
        TILES,
    ),
)
def steps_alone(spark, d):
    """Steps on their own look at whether they are enabled, as all of them together do."""
    off = profiles.profile(color_dropout={"enabled": False, "color": "red"}, resize={"enabled": False}, despeckle={"mode": "single_pixel"})
    done = directory.investigated(gray_pages(spark, d), off, ("rotate", "color_dropout", "resize", "hole_cleanup", "despeckle"))
    return done.select("image_id", "step", F.inline("steps")).select("image_id", "step", "applied", "detail")


@query(
    "viewer_file_filter",
    "SELECT p_partkey, p_size % 4 < 2 AS pages, p_size % 4 = 0 AS tiff, p_size % 4 = 1 AS bmp, true AS every FROM part",
)
def viewer_file_filter(spark, d):
    kinds = [X.file_filter(F.col("path"), k).alias(k) for k in ("pages", "tiff", "bmp", "every")]
    return _paths(spark, d).select("p_partkey", *kinds)


@query("exception_list", _with("SELECT image_id, 0 AS page_index, '{\"image_id\":' || image_id || ',\"page_index\":0,\"error\":\"unknown step: bleach\"}' AS json FROM (SELECT DISTINCT image_id FROM tiles)", TILES))
def exception_list(spark, d):
    return page_pipeline.exception_list(page_pipeline.run_pages(gray_pages(spark, d), profiles.profile(), only="bleach"))


@query("projection_profile", _with(f"SELECT image_id, round(sum(c * c) / CAST({H + 2} AS DOUBLE) - pow(sum(c) / CAST({H + 2} AS DOUBLE), 2), 6) AS variance FROM (SELECT image_id, y, count(*) AS c FROM pixels WHERE v < 128 GROUP BY image_id, y) GROUP BY image_id", PIXELS))
def projection_profile(spark, d):
    return R.projection_profile(ink(pixels(spark, d)), H + 2)


@query("skew_angle")
def skew_angle(spark, d):
    done = page_pipeline.run_pages(bw_pages(spark, d), profiles.profile(deskew={"enabled": True}), only="deskew")
    return done.select("image_id", F.col("steps")[0].detail.alias("detail"))


@query("deskew")
def deskew(spark, d):
    done = page_pipeline.run_pages(bw_pages(spark, d), profiles.profile(deskew={"enabled": True, "max_angle": 5.0}), only="deskew")
    return done.select("image_id", "width", "height", F.sha2("data", 256).alias("data_sha256"))


@query("rotate_arbitrary")
def rotate_arbitrary(spark, d):
    return codec_udfs.turned(gray_pages(spark, d), 30.0).select("image_id", "width", "height", F.sha2("data", 256).alias("data_sha256"))


def _turned_sql(degrees: float) -> str:
    """Ink of pages turned by an angle: each pixel of the new canvas takes the nearest one of the old."""
    a = math.radians(degrees)
    cos, sin = (f"CAST({v!r} AS DOUBLE)" for v in (math.cos(a), math.sin(a)))
    w, h = math.ceil(W * abs(math.cos(a)) + H * abs(math.sin(a))), math.ceil(W * abs(math.sin(a)) + H * abs(math.cos(a)))
    near = lambda v: f"CAST(CASE WHEN {v} < 0 THEN -floor(abs({v}) + 0.5) ELSE floor({v} + 0.5) END AS INTEGER)"
    return _with(
        "SELECT image_id, t.x, t.y FROM taken t JOIN (SELECT image_id, x AS ix, y AS iy FROM pixels WHERE v < 128) USING (image_id, ix, iy)",
        PIXELS,
        f"sheet AS (SELECT image_id, CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, a - {w / 2.0} AS rx, b - {h / 2.0} AS ry FROM (SELECT DISTINCT image_id FROM pixels), range({w}) AS p(a), range({h}) AS q(b))",
        f"placed AS (SELECT image_id, x, y, rx * {cos} + ry * {sin} + {W / 2.0} AS sx, -rx * {sin} + ry * {cos} + {H / 2.0} AS sy FROM sheet)",
        f"taken AS MATERIALIZED (SELECT image_id, x, y, {near('sx')} AS ix, {near('sy')} AS iy FROM placed)",
    )


@query("rotate_arbitrary_ink", _turned_sql(30.0))
def rotate_arbitrary_ink(spark, d):
    return C.pixels_of(codec_udfs.turned(bw_pages(spark, d), 30.0)).filter("v = 1").select("image_id", "x", "y")


@query("profile_roundtrip", "SELECT 'a4' AS preset, 'cw90' AS rotation, 'millimeters' AS unit, 2.5 AS left_margin, true AS same")
def profile_roundtrip(spark, d):
    said = '{"canvas": {"preset": "A4"}, "rotation": "CW90", "margins": [{"left": {"distance": {"value": 2.5, "unit": "mm"}}}], "unknown": 1}'
    p = profiles.from_json(said)
    left = p["margins"][0]["left"]["distance"]
    row = (p["canvas"]["preset"], p["rotation"], left["unit"], left["value"], profiles.from_json(profiles.to_json(p)) == p)
    return spark.createDataFrame([row], "preset string, rotation string, unit string, left_margin double, same boolean")
