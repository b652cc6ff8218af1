"""Job events as a stream, beyond the batch operators: counts in event-time windows, and the state of each job.

Events are (ts, job_id, state, message). Late data is dropped by the watermark in the windowed counts; the state of a job
follows the order of time, so a late event never undoes a newer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, job_id string, state string, message string"
STATE = "job_id string, state string, message string, ts timestamp, changes bigint"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(folder)


def counts(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, state, n) of tumbling windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", every), "state").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "state", "n")


def job_states(events: DataFrame) -> DataFrame:
    """The newest state of each job, in update mode; a row whenever it changes."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, now, message, changes = state.get if state.exists else (0, None, None, 0)
        before = now, at
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples(index=False):
                if r.ts.value >= at:
                    at, now, message = r.ts.value, r.state, r.message if isinstance(r.message, str) else None
                    changes += 1
        state.update((at, now, message, changes))
        if (now, at) != before:
            yield pd.DataFrame([(key[0], now, message, pd.Timestamp(at), changes)], columns=["job_id", "state", "message", "ts", "changes"])

    return events.groupBy("job_id").applyInPandasWithState(fold, STATE, "at bigint, now string, message string, changes bigint", "update", "NoTimeout")
