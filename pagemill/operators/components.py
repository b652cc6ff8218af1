"""Components and rectangles: per page over its spans, and as relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.schema import COMPONENT


def components(spans: DataFrame, connectivity: int = 4, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Connected parts of each page (schema COMPONENT), labelled 0, 1, ... by their first span. A page's spans are one group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        from pagemill.functions.page import components as parts

        rows = np.stack([table[c].to_numpy() for c in ("row", "col_start", "col_end")], 1).astype(np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        got = parts(rows, roi or (0, 0, int(rows[:, 2].max()), int(rows[:, 0].max()) + 1), connectivity)
        cols = [pa.array([key[0].as_py()] * len(got), pa.int64()), pa.array(np.arange(len(got)))] + [pa.array(got[:, i].astype(np.int32)) for i in range(4)] + [pa.array(got[:, 4])]
        return pa.table(cols, names=[c.split()[0] for c in COMPONENT.split(", ")])

    return spans.select("image_id", "row", "col_start", "col_end").groupBy("image_id").applyInArrow(run, COMPONENT)


def sized(parts: DataFrame, min_w: int, min_h: int, max_w: float = 0, max_h: float = 0) -> DataFrame:
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    keep = (w >= min_w) & (h >= min_h)
    keep = keep & (w <= int(max_w)) if max_w > 0 else keep
    return parts.filter(keep & (h <= int(max_h)) if max_h > 0 else keep)


def bounds(parts: DataFrame) -> DataFrame:
    return parts.groupBy("image_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("parts"))


def erased(ink: DataFrame, boxes: DataFrame) -> DataFrame:
    """Ink pixels outside all ``boxes`` of their page: a box is spread over its rows, so the join is on page and row."""
    rows = boxes.select("image_id", "left", "right", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)).alias("y"))
    inside = (ink.image_id == rows.image_id) & (ink.y == rows.y) & (ink.x >= rows.left) & (ink.x < rows.right)
    return ink.join(rows, inside, "left_anti")


def holes(parts: DataFrame, scale: float) -> DataFrame:
    """Parts of about the size of punch holes, not long."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    low, high = int(15 * scale + 0.5), int(60 * scale + 0.5)
    return parts.filter((F.least(w, h) >= low) & (F.greatest(w, h) <= high) & (F.greatest(w, h) <= 2.0 * F.least(w, h)))


def sort_order(axis: str) -> list:
    """left_right, right_left, top_bottom or bottom_top; equal ones by the other edge, then as they came (``label``)."""
    first = {"left_right": F.col("left").asc(), "right_left": F.col("left").desc(), "top_bottom": F.col("top").asc(), "bottom_top": F.col("top").desc()}[axis]
    return [first, F.col("top" if axis in ("left_right", "right_left") else "left").asc(), F.col("label").asc()]


def bands(parts: DataFrame) -> DataFrame:
    """With ``band``: a new one starts where a rectangle's top is at or below all bottoms before it in order of top."""
    by = Window.partitionBy("image_id").orderBy("top", "left", "label")
    reach = F.max("bottom").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("_new", F.when(reach.isNull() | (F.col("top") >= reach), 1).otherwise(0))
    return starts.withColumn("band", (F.sum("_new").over(by) - 1).cast("bigint")).drop("_new")


def pages_of(pixels: DataFrame, width: int, height: int, bits: int, dpi: float = 300.0) -> DataFrame:
    """Pages (schema PAGE) of dense pixels: one group is one page, bounded by its size."""
    from pagemill.schema import PAGE

    def run(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        from pagemill.functions.page import blank

        p = blank(width, height, bits, dpi, dpi)
        p.pixels[table["y"].to_numpy(), table["x"].to_numpy()] = np.asarray(table["v"].to_numpy(), np.uint8)
        row = [key[0].as_py(), 0, width, height, bits, dpi, dpi, p.to_bytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PAGE.split(", ")])

    return pixels.select("image_id", "x", "y", F.col("v").cast("int").alias("v")).groupBy("image_id").applyInArrow(run, PAGE)


def pixels_of(pages: DataFrame) -> DataFrame:
    """(image_id, x, y, v) of one-bit and grey pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from pagemill.functions.page import Page

        for b in batches:
            for r in b.to_pylist():
                p = Page.from_bytes(r["data"], r["width"], r["height"], r["format"])
                y, x = np.indices(p.pixels.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(x.size, r["image_id"], np.int64)), pa.array(x.ravel().astype(np.int32)), pa.array(y.ravel().astype(np.int32)), pa.array(p.pixels.ravel().astype(np.int32))], names=["image_id", "x", "y", "v"]
                )

    return pages.select("image_id", "width", "height", "format", "data").mapInArrow(run, "image_id bigint, x int, y int, v int")
