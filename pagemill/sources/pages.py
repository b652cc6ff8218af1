"""Page files: folders to pages, and results to files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.expressions import decoder_of
from pagemill.functions.page import BW1, blank
from pagemill.plans import codec_udfs
from pagemill.schema import PAGE

#: Page files, in any case; files of other names are not listed, so they are not read.
GLOB = "*.{[tT][iI][fF],[tT][iI][fF][fF],[bB][mM][pP]}"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the page files of a folder, not below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder).select("path", "content")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the page files of a folder in order of the path; contents are not read."""
    return list_files(spark, folder).select("path").orderBy("path")


def existing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path) of the files in ``folders``, those that there are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    there = [f for f, p in zip(folders, paths, strict=True) if p.getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:", "").alias("path"))


def read_pages(spark: SparkSession, folder: str, unreadable: bool = False) -> DataFrame:
    """(path, PAGE): a row for each page of each file, up to the first that can't be decoded; image_id is a hash of the path.

    With ``unreadable`` a file without pages has one row, an empty page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagemill.sources.codecs import tiff

        for b in batches:
            for r in b.to_pylist():
                pages = tiff.read_pages(r["content"]) if r["decoder"] in ("tiff", "probe") else []
                if not pages and r["decoder"] != "tiff":
                    one = codec_udfs.page_from(r["content"], "bmp")
                    pages = [one] if one is not None else []
                if unreadable and not pages:
                    pages = [blank(0, 0, BW1)]
                rows = [(r["path"], *codec_udfs._row(r["image_id"], i, p)) for i, p in enumerate(pages)]
                yield codec_udfs._batch(rows, ["path", *codec_udfs._NAMES], [pa.string(), *codec_udfs._KINDS])

    files = list_files(spark, folder).select("path", F.xxhash64("path").alias("image_id"), decoder_of(F.col("path")).alias("decoder"), "content")
    return files.mapInArrow(run, f"path string, {PAGE}")


def read_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of all pages of TIFF files, without decoding pixels."""
    return codec_udfs.tags(list_files(spark, folder).select(F.xxhash64("path").alias("image_id"), F.col("content").alias("bytes")))


def write_files(outputs: DataFrame) -> DataFrame:
    """Write (path, bytes) each to a file by way of a temporary name and a rename; (path, size) of what was written.

    For folders that all executors share. A repeated task writes the same bytes under the same name again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for b in batches:
            rows = []
            for r in b.to_pylist():
                path = r["path"].removeprefix("file:")
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(r["bytes"])
                os.replace(part, path)
                rows.append((r["path"], len(r["bytes"])))
            yield codec_udfs._batch(rows, ["path", "size"], [pa.string(), pa.int64()])

    return outputs.select("path", "bytes").mapInArrow(run, "path string, size bigint")
