"""Jobs as JSON: fixed key order, nulls written, times with microseconds; reading is all or nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.expressions import iso_text, iso_time, state_of
from pagemill.schema import JOB_STATES

_TIMES = ("created_at", "updated_at", "last_attempt_at", "due_at")
_SCHEMA = (
    "id string, state string, payload struct<source_path: string, profile_name: string, attachments: array<string>, tags: array<string>>, "
    "created_at string, updated_at string, correlation_id string, error_message string, priority int, attempt_count bigint, last_attempt_at string, due_at string, _bad string"
)


def job_struct() -> Column:
    time = lambda c: iso_text(F.col(c)).alias(c)
    payload = F.struct("source_path", "profile_name", "attachments", "tags").alias("payload")
    return F.struct("id", "state", payload, time("created_at"), time("updated_at"), "correlation_id", "error_message", "priority", "attempt_count", time("last_attempt_at"), time("due_at"))


def to_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def with_json(jobs: DataFrame, name: str = "json") -> DataFrame:
    return jobs.withColumn(name, to_json(job_struct()))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Jobs from JSON objects, one a row, with ``valid``: known state, a source path and well-formed times. Unknown keys are skipped, missing ones default."""
    r = F.from_json(column, _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    got = rows.select(r.alias("r"))
    times = {c: iso_time(F.col(f"r.{c}")) for c in _TIMES}
    good = F.col("r._bad").isNull() & state_of(F.coalesce("r.state", F.lit("submitted"))).isNotNull() & (F.coalesce("r.payload.source_path", F.lit("")) != "")
    for c, t in times.items():
        good = good & (F.col(f"r.{c}").isNull() | t.isNotNull())
    empty = F.array().cast("array<string>")
    return got.select(
        "r.id", state_of(F.coalesce("r.state", F.lit("submitted"))).alias("state"), "r.payload.source_path", "r.payload.profile_name",
        F.coalesce("r.payload.attachments", empty).alias("attachments"), F.coalesce("r.payload.tags", empty).alias("tags"),
        times["created_at"].alias("created_at"), times["updated_at"].alias("updated_at"), "r.correlation_id", "r.error_message",
        F.coalesce("r.priority", F.lit(0)).alias("priority"), F.coalesce("r.attempt_count", F.lit(0)).cast("bigint").alias("attempt_count"),
        times["last_attempt_at"].alias("last_attempt_at"), times["due_at"].alias("due_at"), F.coalesce(good, F.lit(False)).alias("valid"),
    )


def from_json_array(rows: DataFrame, column: str = "value") -> DataFrame:
    """Jobs of JSON arrays, one array a row. A single invalid record makes the read fail."""
    items = rows.select(F.explode(F.from_json(column, "array<string>")).alias("json"))
    got = from_json(items)
    return got.filter(F.when(F.col("valid"), True).otherwise(F.raise_error(F.lit("a job record is invalid")).cast("boolean"))).drop("valid")


def read_json(spark, path: str) -> DataFrame:
    return from_json_array(spark.read.text(path, wholetext=True))


def write_json(jobs: DataFrame, path: str) -> None:
    """Jobs as lines of JSON, spread over files; :func:`array_parts` and :func:`array_text` give one array."""
    jobs.select(to_json(job_struct()).alias("value")).write.text(path)


def array_parts(jobs: DataFrame) -> Iterator[str]:
    """One JSON array in parts, a job each; the driver holds a partition at a time."""
    yield "["
    for i, r in enumerate(jobs.select(to_json(job_struct()).alias("j")).toLocalIterator()):
        yield f",{r.j}" if i else r.j
    yield "]"


def array_text(jobs: DataFrame) -> str:
    """One JSON array as one string."""
    return "".join(array_parts(jobs))


def summary_json(summary: DataFrame) -> DataFrame:
    times = [iso_text(F.col(c)).alias(c) for c in ("oldest_created", "oldest_outstanding", "latest_update", "next_due")]
    return summary.select(to_json(F.struct("total", *JOB_STATES, "outstanding", *times)).alias("json"))


def tsv() -> Column:
    """The human-readable line of a job; missing times and texts are a dash."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return F.concat_ws("\t", "id", "state", F.col("priority").cast("string"), dash(F.date_format("due_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "source_path", dash(F.col("profile_name")), dash(F.col("correlation_id")))
