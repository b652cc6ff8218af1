"""The page pipeline: a list of steps made on the driver from a profile, run in one pass over Arrow batches of pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import page as P
from pagemill.functions.page import Page


@dataclass
class State:
    """What a page carries from step to step."""

    page: Page
    profile: dict
    index: int
    box: tuple[int, int, int, int] | None = None
    content: tuple[int, int, int, int] | None = None
    canvas: tuple[int, int] = (0, 0)
    blank: P.Blank = field(default_factory=P.Blank)
    log: list[tuple[str, bool, str]] = field(default_factory=list)

    @property
    def second(self) -> bool:
        return self.profile["odd_even_mode"] and self.index % 2 == 1

    @property
    def edge_set(self) -> tuple[str, int]:
        return ("set2", 2) if self.second else ("set1", 1)


Step = Callable[[State], tuple[bool, str]]


def rotate(s: State) -> tuple[bool, str]:
    how = s.profile["rotation"]
    if how == "none":
        return False, "no rotation"
    s.page = P.rotate(s.page, how)
    return True, {"cw90": "rotated CW 90 degrees", "ccw90": "rotated CCW 90 degrees", "180": "rotated 180 degrees"}[how]


def color_dropout(s: State) -> tuple[bool, str]:
    c = s.profile["color_dropout"]
    if not c["enabled"] or c["color"] == "none":
        return False, "disabled"
    s.page = P.color_dropout(s.page, c["color"], c["threshold"])
    return True, f"dropped {c['color']}"


def edge_cleanup(s: State) -> tuple[bool, str]:
    c = s.profile["edge_cleanup"]
    if not c["enabled"]:
        return False, "disabled"
    name, n = s.edge_set
    s.page = P.edge_cleanup(s.page, c[name])
    return True, f"cleaned edges (set {n})"


def deskew(s: State) -> tuple[bool, str]:
    c = s.profile["deskew"]
    if not c["enabled"]:
        return False, "disabled"
    s.page, angle, confidence, done = P.deskew(s.page, c["min_angle"], c["max_angle"])
    return done, f"angle={angle:g} deg, confidence={confidence:g}, {'' if done else 'not '}corrected"


def hole_cleanup(s: State) -> tuple[bool, str]:
    c = s.profile["hole_cleanup"]
    if not c["enabled"]:
        return False, "disabled"
    if s.page.format != P.BW1:
        return False, "skipped (not BW1)"
    name, n = s.edge_set
    s.page = P.hole_cleanup(s.page, c[name])
    return True, f"cleaned punch holes (set {n})"


def despeckle(s: State) -> tuple[bool, str]:
    c = s.profile["despeckle"]
    if c["mode"] == "none":
        return False, "disabled"
    if s.page.format != P.BW1:
        return False, "skipped (not BW1)"
    s.page = P.despeckle(s.page, c["mode"], c["object_min"], c["object_max"])
    return True, "removed single-pixel noise" if c["mode"] == "single_pixel" else f"removed objects {c['object_min']}-{c['object_max']} px"


def detect_subimage(s: State) -> tuple[bool, str]:
    """Always logged as applied, also when it finds nothing; then the whole page is the content."""
    box, parts = P.subimage(s.page, s.profile["subimage"])
    s.box = box or (0, 0, s.page.width, s.page.height)
    if box is None:
        return True, "no content detected"
    return True, f"content at ({box[0]},{box[1]}) {box[2] - box[0]}x{box[3] - box[1]} px, {len(parts)} components"


def blank_page(s: State) -> tuple[bool, str]:
    c = s.profile["blank_page"]
    if not c["enabled"]:
        return False, "disabled"
    b = s.blank = P.blank_page(s.page, c)
    parts = f", {b.parts} components" if c["min_components"] > 0 else ""
    return True, f"{'BLANK' if b.is_blank else 'not blank'} ({b.percent:g}% foreground, {b.ink}/{b.total} px{parts})"


def margins(s: State) -> tuple[bool, str]:
    p = s.profile
    s.canvas = P.canvas_of(p["canvas"], s.page.dpi_x, s.page.dpi_y, s.page.width, s.page.height)
    if not p["position_image"]:
        return False, "positioning disabled"
    box = s.box or (0, 0, s.page.width, s.page.height)
    s.page, s.content = P.place_by_margins(s.page, box, p["margins"][int(s.second)], s.canvas, p["keep_outside_subimage"])
    return True, f"positioned content at ({s.content[0]},{s.content[1]}) on {s.canvas[0]}x{s.canvas[1]} canvas"


def movement_limit(s: State) -> tuple[bool, str]:
    c, (x, y, r, b) = s.profile["movement_limit"], s.content
    moved = (x - s.box[0], y - s.box[1])
    most = (P.half_up(P.pixels_of(c["max_horizontal"], s.page.dpi_x)), P.half_up(P.pixels_of(c["max_vertical"], s.page.dpi_y)))
    to = P.limited(moved, most)
    pair = lambda v: f"({v[0]},{v[1]})"
    if to == moved:
        return False, f"within limits {pair(moved)}, max={pair(most)}"
    dx, dy = to[0] - moved[0], to[1] - moved[1]
    s.page = P.blit(P.blank(s.page.width, s.page.height, s.page.format, s.page.dpi_x, s.page.dpi_y), s.page, dx, dy)
    s.content = (x + dx, y + dy, r + dx, b + dy)
    return True, f"clamped displacement from {pair(moved)} to {pair(to)}, max={pair(most)}"


def resize(s: State) -> tuple[bool, str]:
    """Takes the content's box from before margins, on the page as it is after them."""
    got = P.resize(s.page, s.box or (0, 0, s.page.width, s.page.height), s.profile["resize"], s.second)
    if got is None:
        return False, "resize produced empty result"
    s.page, (x, y, _, _) = got
    return True, f"resized to {s.page.width}x{s.page.height}, content at ({x},{y})"


def plan(profile: dict) -> list[tuple[str, Step, Callable[[State], bool]]]:
    """The steps a profile asks for, in order; a step with a condition on the page is skipped where it fails, unlogged."""
    always = lambda s: True
    edge = ("edge_cleanup", edge_cleanup, always)
    early = profile["edge_cleanup"]["order"] == "before_deskew"
    dropout = profile["color_dropout"]
    return [
        ("rotate", rotate, always),
        *([("color_dropout", color_dropout, always)] if dropout["enabled"] and dropout["color"] != "none" else []),
        *([edge] if early else []),
        ("deskew", deskew, always),
        ("hole_cleanup", hole_cleanup, always),
        ("despeckle", despeckle, always),
        *([] if early else [edge]),
        ("detect_subimage", detect_subimage, always),
        ("blank_page", blank_page, always),
        ("margins", margins, always),
        *([("movement_limit", movement_limit, lambda s: s.content is not None and s.content[0] < s.content[2] and s.content[1] < s.content[3])] if profile["movement_limit"]["enabled"] else []),
        *([("resize", resize, always)] if profile["resize"]["enabled"] else []),
    ]


def resize_alone(s: State) -> tuple[bool, str]:
    """The step on its own looks at whether resizing is enabled, and says less."""
    done = s.profile["resize"]["enabled"] and resize(s)[0]
    return done, "resized" if done else "no resize applied"


SINGLE = {f.__name__: f for f in (rotate, color_dropout, edge_cleanup, hole_cleanup, despeckle, deskew, blank_page, detect_subimage, margins)} | {"resize": resize_alone}


def run_page(page: Page, profile: dict, index: int = 0, only: str | None = None) -> tuple[State, str]:
    """(state, error) of the whole pipeline, or of one step by its name."""
    if page.empty:
        return State(page, profile, index), "empty source image"
    if only is not None and only not in SINGLE:
        return State(page, profile, index), f"unknown step: {only}"
    if page.dpi_x <= 0 or page.dpi_y <= 0:
        dpi = float(profile["detected_dpi"]) if profile["detected_dpi"] > 0 else 300.0
        page = page.of(page.pixels, dpi_x=dpi, dpi_y=dpi)
    s = State(page, profile, index)
    if only in ("margins", "resize"):
        detect_subimage(s)
    for name, step, fits in plan(profile) if only is None else [(only, SINGLE[only], lambda s: True)]:
        if fits(s):
            s.log.append((name, *step(s)))
    return s, ""


RESULT = (
    "image_id bigint, page_index int, success boolean, error string, is_blank boolean, left int, top int, right int, bottom int, canvas_width int, canvas_height int, "
    "foreground_percent double, component_count int, total_pixels bigint, foreground_pixels bigint, steps array<struct<name: string, applied: boolean, detail: string>>, "
    "width int, height int, format int, dpi_x double, dpi_y double, data binary, elapsed_ms double"
)


def run_pages(pages: DataFrame, profile: dict, only: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Results of ``pages`` (schema PAGE), one row a page, in one pass; the profile travels with the plan.

    The text columns ``keep`` of ``pages`` come along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 32):  # pages are large, so few results are held at once
                rows = []
                for r in pdf.iloc[at : at + 32].itertuples(index=False):
                    began = time.perf_counter()
                    page = Page.from_bytes(r.data or b"", r.width, r.height, r.format, r.dpi_x, r.dpi_y)
                    s, error = run_page(page, profile, int(r.page_index), only)
                    box, b, q = s.box or (0, 0, 0, 0), s.blank, s.page
                    log = [{"name": n, "applied": a, "detail": d} for n, a, d in s.log]
                    rows.append((r.image_id, r.page_index, not error, error, b.is_blank, *box, *s.canvas, b.percent, b.parts, b.total, b.ink, log, q.width, q.height, q.format, q.dpi_x, q.dpi_y, q.to_bytes(), 1000 * (time.perf_counter() - began), *(getattr(r, c) for c in keep)))
                yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in _columns()), *keep])

    schema = RESULT + "".join(f", {c} string" for c in keep)
    return pages.select("image_id", "page_index", "width", "height", "format", "dpi_x", "dpi_y", "data", *keep).mapInPandas(run, schema)


def _columns() -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(RESULT + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(RESULT[start:i].strip())
            start = i + 1
    return out


def batch_summary(results: DataFrame, submitted: int | None = None) -> DataFrame:
    """total, succeeded, failed, blank, success and the first error, in one aggregation."""
    first = F.min(F.when(~F.col("success"), F.struct("page_index", "error"))).alias("first")
    got = results.agg(F.count("*").alias("n"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if("is_blank").alias("blank"), first)
    total = F.col("n") if submitted is None else F.lit(submitted).cast("bigint")
    return got.select(total.alias("total"), "succeeded", "failed", "blank", ((F.col("failed") == 0) & (F.col("n") == total)).alias("success"), F.col("first.error").alias("error"))


def cancelled_after(pages: DataFrame, last_index: int) -> DataFrame:
    """Pages of a batch that is cancelled after the page at ``last_index``."""
    return pages.filter(F.col("page_index") <= last_index)


def collected(results: DataFrame, include_blank: bool = False) -> DataFrame:
    return results.filter(F.col("success") & (F.lit(include_blank) | ~F.col("is_blank")) & (F.col("width") > 0) & (F.col("height") > 0))


def times(results: DataFrame) -> DataFrame:
    """elapsed_ms of all pages and mean_ms of one; of no pages 0 and null."""
    return results.agg(F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)).alias("elapsed_ms"), F.avg("elapsed_ms").alias("mean_ms"))


def _listed(results: DataFrame) -> list:
    """What names a page in the lists: source, output and time where the results have paths."""
    paths = [F.col("path").alias("source"), F.col("output"), F.round("elapsed_ms", 1).alias("elapsed_ms")] if {"path", "output"} <= set(results.columns) else []
    return [F.col("image_id"), F.col("page_index"), *paths]


def good_list(results: DataFrame) -> DataFrame:
    """JSON of each page that succeeded: the names of its applied steps, and name, applied and detail of all."""
    names = F.transform(F.filter("steps", lambda s: s.applied), lambda s: s["name"]).alias("steps_applied")
    return results.filter("success").select("image_id", "page_index", F.to_json(F.struct(*_listed(results), "is_blank", names, F.col("steps").alias("step_details"))).alias("json"))


def exception_list(results: DataFrame) -> DataFrame:
    return results.filter("not success").select("image_id", "page_index", F.to_json(F.struct(*_listed(results), "error", *(["is_blank"] if "path" in results.columns else []))).alias("json"))
