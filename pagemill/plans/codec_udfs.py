"""Codecs over pages in Arrow batches: page rows to bytes and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.functions.page import Page, rotate_arbitrary
from pagemill.schema import PAGE

_NAMES = [c.split()[0] for c in PAGE.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]


def _page(r: dict) -> Page:
    return Page.from_bytes(r["data"] or b"", r["width"], r["height"], r["format"], r["dpi_x"], r["dpi_y"])


def _row(image_id: int, index: int, p: Page) -> tuple:
    return image_id, index, p.width, p.height, p.format, float(p.dpi_x), float(p.dpi_y), p.to_bytes()


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _bytes_of(p: Page, kind: str, how: str) -> bytes:
    from pagemill.sources.codecs import bmp, pdf, tiff

    return {"tiff": lambda: tiff.write([p], tiff.COMPRESSIONS[how]), "bmp": lambda: bmp.write(p), "pdf": lambda: pdf.write([p])}[kind]()


def page_from(data: bytes, kind: str) -> Page | None:
    """A page by its decoder; ``probe`` tries TIFF, then BMP."""
    from pagemill.sources.codecs import bmp, tiff

    got = tiff.read_page(data) if kind in ("tiff", "probe") else None
    return bmp.read(data) if got is None and kind in ("bmp", "probe") else got


def encoded(pages: DataFrame, kind: str, how: str = "raw") -> DataFrame:
    """(image_id, page_index, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["image_id"], r["page_index"], _bytes_of(_page(r), kind, how)) for r in b.to_pylist()]
            yield _batch(rows, ["image_id", "page_index", "bytes"], [pa.int64(), pa.int32(), pa.binary()])

    return pages.select(*_NAMES).mapInArrow(run, "image_id bigint, page_index int, bytes binary")


def decoded(files: DataFrame, kind: str) -> DataFrame:
    """Pages (schema PAGE) of (image_id, page_index, bytes); what can't be decoded is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(r, page_from(r["bytes"], kind)) for r in b.to_pylist()]
            yield _batch([_row(r["image_id"], r["page_index"], p) for r, p in got if p is not None], _NAMES, _KINDS)

    return files.select("image_id", "page_index", "bytes").mapInArrow(run, PAGE)


def joined_files(pages: DataFrame, how: str) -> DataFrame:
    """(file, bytes): a TIFF of the pages of each ``file`` in order; one group is one file."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        from pagemill.sources.codecs import tiff

        rows = sorted(table.to_pylist(), key=lambda r: r["page_index"])
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "bytes": pa.array([tiff.write([_page(r) for r in rows], tiff.COMPRESSIONS[how])], pa.binary())})

    return pages.select("file", *_NAMES).groupBy("file").applyInArrow(run, "file bigint, bytes binary")


def split_files(files: DataFrame) -> DataFrame:
    """(file, PAGE) with a row for each page of each file, up to the first that can't be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagemill.sources.codecs import tiff

        for b in batches:
            for r in b.to_pylist():
                rows = [(r["file"], *_row(0, i, p)) for i, p in enumerate(tiff.read_pages(r["bytes"]))]
                yield _batch(rows, ["file", *_NAMES], [pa.int64(), *_KINDS])

    return files.select("file", "bytes").mapInArrow(run, f"file bigint, {PAGE}")


TAGS = "image_id bigint, page int, width bigint, height bigint, compression bigint, photometric bigint, orientation bigint, bits bigint, dpi_x double, dpi_y double, software string, tags array<struct<tag: int, type: int, ints: array<bigint>, doubles: array<double>, text: string>>"


def tags(files: DataFrame) -> DataFrame:
    """A row for each page's tags, without decoding pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagemill.sources.codecs import tiff as t

        names = ["image_id", "page", "width", "height", "compression", "photometric", "orientation", "bits", "dpi_x", "dpi_y", "software", "tags"]
        field = pa.list_(pa.struct([("tag", pa.int32()), ("type", pa.int32()), ("ints", pa.list_(pa.int64())), ("doubles", pa.list_(pa.float64())), ("text", pa.string())]))
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.float64(), pa.float64(), pa.string(), field]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for i, d in enumerate(t.read_tags(r["bytes"]) or []):
                    ints = [t.get_int(d, k) for k in (t.WIDTH, t.LENGTH, t.COMPRESSION, t.PHOTOMETRIC, t.ORIENTATION, t.BITS)]
                    fields = [{"tag": k, "type": f.kind, "ints": f.ints, "doubles": f.doubles, "text": f.text} for k, f in sorted(d.items())]
                    rows.append((r["image_id"], i, *ints, t.get_double(d, t.X_RES), t.get_double(d, t.Y_RES), t.get_text(d, t.SOFTWARE), fields))
            yield _batch(rows, names, kinds)

    return files.select("image_id", "bytes").mapInArrow(run, TAGS)


def turned(pages: DataFrame, degrees: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_row(r["image_id"], r["page_index"], rotate_arbitrary(_page(r), degrees)) for r in b.to_pylist()], _NAMES, _KINDS)

    return pages.select(*_NAMES).mapInArrow(run, PAGE)
