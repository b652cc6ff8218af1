"""Raster operators on the pixel relation (image_id, x, y, v): projections, joins and windows, so Catalyst plans them."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("image_id", "x", "y")


def div(a: Column, b) -> Column:
    """Whole-number division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def grid(images: DataFrame, width: int, height: int) -> DataFrame:
    """All places of pages of one size, one row of places exploded for each page."""
    xs = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return xs.select("image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))


def dense(pixels: DataFrame, width: int, height: int, missing: int = 255) -> DataFrame:
    """Pages with all their pixels."""
    places = grid(pixels.select("image_id").distinct(), width, height)
    return places.join(pixels, list(KEY), "left").select(*KEY, F.coalesce("v", F.lit(missing)).alias("v"))


# values ---------------------------------------------------------------------------------------------------------------


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def dropped(channel: Column, one: Column, two: Column, threshold: int) -> Column:
    """Whether a pixel is dropped: its channel exceeds the mean of the others by more than the threshold."""
    return channel - div(one + two, 2) > threshold


# histograms -----------------------------------------------------------------------------------------------------------


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def _running(hist: DataFrame) -> DataFrame:
    """With the counts and sums of values up to each bin; a page has 256 bins at most."""
    up = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy("image_id")
    s = F.col("v").cast("bigint") * F.col("n")
    return hist.select("image_id", "v", "n", F.sum("n").over(up).alias("c"), F.sum(s).over(up).alias("s"), F.sum("n").over(all_).alias("total"), F.sum(s).over(all_).alias("all_s"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    r = _running(hist)
    return r.groupBy("image_id").agg(
        F.round(F.max("all_s") / F.max("total"), 6).alias("mean"), F.min(F.when(F.col("c") > div(F.col("total"), 2), F.col("v"))).alias("median"), F.min("v").alias("least"), F.max("v").alias("most")
    )


def otsu(hist: DataFrame) -> DataFrame:
    """The threshold of largest variance between classes; ties go to the least; a page of one value has 0."""
    r = _running(hist)
    rest = F.col("total") - F.col("c")
    gap = F.col("s") / F.col("c") - (F.col("all_s") - F.col("s")) / F.when(rest > 0, rest)
    var = F.when(rest > 0, F.col("c").cast("double") * rest * gap * gap)
    best = F.max_by(F.struct("v", "var"), F.struct(F.col("var"), -F.col("v")))
    got = r.select("image_id", "v", var.alias("var")).groupBy("image_id").agg(best.alias("b"))
    return got.select("image_id", F.when(F.col("b.var") > 0, F.col("b.v")).otherwise(0).cast("int").alias("threshold"))


# places ---------------------------------------------------------------------------------------------------------------


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    x, y = max(x, 0), max(y, 0)
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.filter(inside).select("image_id", (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "v")


def rotate(pixels: DataFrame, how: str, width: int, height: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    to = {"cw90": (height - 1 - y, x), "ccw90": (y, width - 1 - x), "180": (width - 1 - x, height - 1 - y)}[how]
    return pixels.select("image_id", to[0].alias("x"), to[1].alias("y"), "v")


def pad(pixels: DataFrame, width: int, height: int, top: int, left: int, right: int, bottom: int, value: int) -> DataFrame:
    moved = pixels.select("image_id", (F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), "v")
    return dense(moved, width + left + right, height + top + bottom, value)


def blit(dst: DataFrame, src: DataFrame, x: int, y: int) -> DataFrame:
    over = src.select("image_id", (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("v").alias("over"))
    return dst.join(over, list(KEY), "left").select(*KEY, F.coalesce("over", "v").alias("v"))


def scale_nearest(pixels: DataFrame, width: int, height: int, to_w: int, to_h: int) -> DataFrame:
    places = grid(pixels.select("image_id").distinct(), to_w, to_h)
    at = lambda c, n, m: F.least(F.floor(F.col(c) * (n / m)), F.lit(n - 1)).cast("int")
    src = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return places.withColumns({"sx": at("x", width, to_w), "sy": at("y", height, to_h)}).join(src, ["image_id", "sx", "sy"]).select(*KEY, "v")


def _sent(size: int, to: int, weight: str) -> Column:
    """For each place of a side of ``size`` the places of a side of ``to`` that it is a corner of, each with its weight."""
    places: list[list[dict]] = [[] for _ in range(size)]
    for at in range(to):
        f = at * ((size - 1) / max(to - 1, 1))
        low = math.floor(f)
        places[low].append({"to": at, weight: 1 - (f - low)})
        places[min(low + 1, size - 1)].append({"to": at, weight: f - low})
    return F.from_json(F.lit(json.dumps(places)), f"array<array<struct<to:int,{weight}:double>>>")


def scale_bilinear(pixels: DataFrame, width: int, height: int, to_w: int, to_h: int) -> DataFrame:
    """Every pixel is sent to the places that it is one of the four weighted corners of and summed there: no join, one sum.

    Pixels without a page or outside it are left out.
    """
    across = pixels.filter("image_id is not null").select("image_id", "y", "v", F.inline(F.get(_sent(width, to_w, "wx"), F.col("x")))).withColumnRenamed("to", "to_x")
    parts = across.select("image_id", F.col("to_x").alias("x"), "wx", "v", F.inline(F.get(_sent(height, to_h, "wy"), F.col("y")))).withColumnRenamed("to", "y")
    # summed in tenths of a millionth, so that the order of the corners makes no difference
    total = F.sum(F.round(F.col("wx") * F.col("wy") * F.col("v") * 1e7).cast("bigint"))
    return parts.groupBy(*KEY).agg(F.floor((total + 5_000_000) / 1e7).cast("int").alias("v"))


CROSS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))
SQUARE = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def morph(bits: DataFrame, how: str, width: int, height: int, shape=SQUARE) -> DataFrame:
    """Dilate or erode: every pixel is sent to its neighbours' places and summed there; outside there is no ink."""
    moves = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in shape])
    sent = bits.select("image_id", "x", "y", "v", F.inline(moves)).select("image_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "v")
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    n = F.sum("v")
    return sent.filter(inside).groupBy(*KEY).agg(F.when(n > 0 if how == "dilate" else n == len(shape), 1).otherwise(0).alias("v"))


def edge_cleanup(pixels: DataFrame, width: int, height: int, top: int, left: int, right: int, bottom: int, white: int = 255) -> DataFrame:
    edge = (F.col("x") < left) | (F.col("x") >= width - right) | (F.col("y") < top) | (F.col("y") >= height - bottom)
    return pixels.select(*KEY, F.when(edge, F.lit(white)).otherwise(F.col("v")).alias("v"))


def blank(bits: DataFrame, total: int, threshold_percent: float) -> DataFrame:
    got = bits.groupBy("image_id").agg(F.sum("v").cast("bigint").alias("foreground"))
    percent = F.col("foreground") / F.lit(total) * 100.0
    return got.select("image_id", "foreground", F.round(percent, 6).alias("percent"), (percent < threshold_percent).alias("is_blank"))


def spans(ink: DataFrame) -> DataFrame:
    """(image_id, row, col_start, col_end) of runs of the ink pixels (image_id, x, y): islands in each row."""
    by = Window.partitionBy("image_id", "y").orderBy("x")
    runs = ink.select("image_id", "y", "x", (F.col("x") - F.row_number().over(by)).alias("island"))
    return runs.groupBy("image_id", F.col("y").alias("row"), "island").agg(F.min("x").alias("col_start"), (F.max("x") + 1).alias("col_end")).drop("island")


def projection_profile(ink: DataFrame, bins: int) -> DataFrame:
    """Variance of the ink counts of the rows (the profile at no angle) over ``bins`` bins."""
    rows = ink.groupBy("image_id", "y").agg(F.count("*").alias("c"))
    got = rows.groupBy("image_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    mean = F.col("n") / F.lit(float(bins))
    return got.select("image_id", F.round(F.col("q") / F.lit(float(bins)) - mean * mean, 6).alias("variance"))
