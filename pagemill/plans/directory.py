"""A folder of page files through a profile: decode, run, choose format and path, report conflicts, encode, write, list."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.expressions import output_path
from pagemill.plans import page_pipeline
from pagemill.sources import pages as files
from pagemill.sources.shared import saved


def results_of(spark: SparkSession, folder: str, profile: dict) -> DataFrame:
    """Results of all pages of all files, with their path; every page has its own index, so page parity counts.

    A file without a page that can be decoded has one result, an error.
    """
    done = page_pipeline.run_pages(files.read_pages(spark, folder, unreadable=True), profile, keep=("path",))
    unread = ~F.col("success") & (F.col("width") == 0) & (F.col("page_index") == 0)
    return done.withColumn("error", F.when(unread, "cannot read image").otherwise(F.col("error")))


def target_path(source: Column, output: dict, page: Column) -> Column:
    """Where a page goes; pages after the first of a file are numbered."""
    folder = F.lit(output["output_directory"] if output["save_to_different_dir"] else "")
    suffix = F.when(page > 0, F.concat(F.lit("_"), (page + 1).cast("string"))).otherwise("")
    return output_path(source, folder, suffix, F.lit(output["new_extension"]), F.lit(output["tiff_output"]))


def with_target(results: DataFrame, output: dict) -> DataFrame:
    """``results`` with ``output``, the path of each page."""
    return results.withColumn("output", target_path(F.regexp_replace("path", "^file:", ""), output, F.col("page_index")))


def unchanged() -> Column:
    """Whether no step was applied to a page that succeeded."""
    return F.col("success") & ~F.exists("steps", lambda s: s["applied"])


def copied(results: DataFrame, contents: DataFrame) -> DataFrame:
    """(image_id, page_index, path, bytes) of the first pages that no step has changed: the bytes of their file (path, content)."""
    kept = results.filter(unchanged() & (F.col("page_index") == 0))
    return kept.join(contents, "path").select("image_id", "page_index", F.col("output").alias("path"), F.col("content").alias("bytes"))


def encoded(results: DataFrame, output: dict) -> DataFrame:
    """(image_id, page_index, path, bytes) of pages (with ``output``) that succeeded, in the format of their path."""
    from pagemill.plans.codec_udfs import _bytes_of, _page

    raster = output["raster_format"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ext = r["output"].rpartition(".")[2].lower()
                how = "raw" if raster == "raw" else "lzw" if raster == "lzw" or r["format"] != 1 else "g4"
                rows.append((r["image_id"], r["page_index"], r["output"], _bytes_of(_page(r), ext if ext in ("bmp", "pdf") else "tiff", how)))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["image_id", "page_index", "path", "bytes"])

    good = results.filter("success and width > 0 and height > 0")
    return good.select("image_id", "page_index", "output", "width", "height", "format", "dpi_x", "dpi_y", "data").mapInArrow(run, "image_id bigint, page_index int, path string, bytes binary")


def clashing(results: DataFrame, existing: DataFrame) -> DataFrame:
    """``results`` (with ``output``) in which pages whose output is among ``existing`` (path) have become exceptions."""
    there = existing.select(F.col("path").alias("output")).distinct().withColumn("_there", F.lit(True))
    hit = F.col("success") & F.col("_there").isNotNull()
    marked = results.join(there, "output", "left")
    return marked.withColumn("error", F.when(hit, F.concat(F.lit("output file already exists: "), "output")).otherwise(F.col("error"))).withColumn("success", F.col("success") & ~hit).drop("_there")


def process(spark: SparkSession, folder: str, profile: dict) -> dict:
    """Run a folder; returns its counts and times, the lists of good pages and exceptions, and what was written."""
    done = with_target(results_of(spark, folder, profile), profile["output"])
    if profile["output"]["conflict_policy"] == "report":
        targets = saved(done)
        done = clashing(targets, files.existing(spark, _folders(targets)))
    done = saved(done)
    changed = encoded(done.filter(~unchanged()), profile["output"])
    plain = copied(done, files.list_files(spark, folder))
    written = saved(files.write_files(changed.select("path", "bytes").unionByName(plain.select("path", "bytes"))))
    return {
        "summary": page_pipeline.batch_summary(done).first().asDict() | page_pipeline.times(done).first().asDict(), "written": written, "good": page_pipeline.good_list(done),
        "exceptions": page_pipeline.exception_list(done), "conflicts": done.filter(F.col("error").startswith("output file already exists")),
    }


def _folders(results: DataFrame) -> list[str]:
    """The folders that outputs go to; they are few, whatever the number of pages."""
    return [r.f for r in results.select(F.regexp_extract("output", r"^(.*)/[^/]*$", 1).alias("f")).distinct().collect()]


def list_document(rows: DataFrame, total: int, count: int, what: str, stamp: str) -> Iterator[str]:
    """The parts of one JSON document of a list (json): time, total, the number of entries as ``what``, and the entries."""
    yield f'{{"timestamp":"{stamp}","total_processed":{total},"{what}":{count},"files":['
    for i, r in enumerate(rows.toLocalIterator()):
        yield f",{r.json}" if i else r.json
    yield "]}"


def investigated(pages: DataFrame, profile: dict, steps: tuple[str, ...] = tuple(page_pipeline.SINGLE)) -> DataFrame:
    """(step, results) of each of ``steps`` on its own, applied to the pages as they are."""
    each = [page_pipeline.run_pages(pages, profile, only=s).select(F.lit(s).alias("step"), "*") for s in steps]
    return reduce(DataFrame.unionByName, each)


def quality_lists(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a reviewer looks through: exceptions with their reason, and good pages."""
    rows = results.select("image_id", "page_index", "is_blank", "width", "height", "error", "success")
    return rows.filter("not success").select("image_id", "page_index", F.col("error").alias("reason")), rows.filter("success").drop("error", "success")
