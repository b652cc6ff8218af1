"""Jobs in relational form: a table of jobs with microsecond times, and child tables of attachments and tags.

The tables may come from any source; :func:`read_jdbc` reads them from a database. Children are aggregated once and joined,
so there is no query for each job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import jobs as J
from pagemill.schema import JOB, JOB_COLUMNS

TIMES = ("created_at", "updated_at", "last_attempt_at", "due_at")
#: The tables, and the value column of the child tables.
TABLES = {"jobs": None, "attachments": "path", "tags": "value"}


def to_micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def from_tables(jobs: DataFrame, attachments: DataFrame, tags: DataFrame) -> DataFrame:
    """Jobs (schema JOB) of the three tables; jobs without children have empty lists, children of unknown jobs are left out."""
    kinds = dict(c.split(" ", 1) for c in JOB.split(", "))
    own = [F.timestamp_micros(F.col(c).cast("bigint")).cast("timestamp_ntz").alias(c) if c in TIMES else F.col(c).cast(kinds[c]).alias(c) for c in JOB_COLUMNS if c not in TABLES]
    out = jobs.select(*own)
    for name, rows in (("attachments", attachments), ("tags", tags)):
        lists = J.collected(rows.select("job_id", "idx", F.col(TABLES[name]).alias(name)), name)
        out = out.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select(*JOB_COLUMNS)


def to_tables(jobs: DataFrame) -> dict[str, DataFrame]:
    """The three tables of ``jobs``."""
    flat = jobs.select(*[to_micros(F.col(c)).alias(c) if c in TIMES else F.col(c) for c in JOB_COLUMNS if c not in TABLES])
    return {"jobs": flat} | {name: J.exploded(jobs, name, column) for name, column in TABLES.items() if column}


def in_created_order(jobs: DataFrame) -> DataFrame:
    """The order of a store that lists by age: created, then id."""
    return jobs.orderBy(F.col("created_at").asc(), F.col("id").asc())


def read_jdbc(spark: SparkSession, url: str, state: str | None = None, **options: str) -> DataFrame:
    """Jobs of a database, all or of one state; the filter on the state is the database's work, where it can compare texts.

    ``options`` are those of Spark's JDBC source (driver, user, partitionColumn, pushDownPredicate and so on) for all three
    tables.
    """
    read = lambda name: _lower(spark.read.format("jdbc").options(url=url, dbtable=name, **options).load())
    return from_tables(J.in_state(read("jobs"), state), read("attachments"), read("tags"))


def write_jdbc(jobs: DataFrame, url: str, mode: str = "append", **options: str) -> None:
    for name, rows in to_tables(jobs).items():
        rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def _lower(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[c.lower() for c in rows.columns])
