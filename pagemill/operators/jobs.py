"""Queue operators: filters, order, claims, summaries, mutations. DataFrame in, DataFrame out; clocks are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.schema import ACTIVE, FINISHED, JOB_STATES
from pagemill.sources.shared import saved

Time = Column


# order -------------------------------------------------------------------------------------------------------------


def queue_order() -> list[Column]:
    """The one total order: urgent first, then due (none last), then age, then id."""
    return [F.col("priority").desc(), F.col("due_at").asc_nulls_last(), F.col("created_at").asc(), F.col("id").asc()]


def in_queue_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*queue_order())


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their position (from 1) in a total order, without bringing them to one task.

    A range-partitioned sort is saved; the row counts of its partitions, one number each, give the offsets.
    """
    sorted_rows = saved(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted_rows.groupBy(part.alias("p")).count().collect()
    offsets, total = {}, 0
    for p, n in sorted((r.p, r["count"]) for r in counts):
        offsets[p] = total
        total += n
    if not offsets:
        return sorted_rows.withColumn(name, F.lit(0).cast("bigint")).drop("_at")
    base = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in offsets.items() for x in pair]), part)
    return sorted_rows.withColumn(name, base + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")


def ranked(jobs: DataFrame, name: str = "rank") -> DataFrame:
    return numbered(jobs, queue_order(), name)


# filters -----------------------------------------------------------------------------------------------------------


def outstanding() -> Column:
    """Neither completed nor cancelled; jobs in exception are outstanding."""
    return ~F.col("state").isin(*FINISHED)


def active() -> Column:
    return F.col("state").isin(*ACTIVE)


def activity_time() -> Column:
    return F.coalesce("updated_at", "created_at")


def in_state(jobs: DataFrame, state: str | None = None) -> DataFrame:
    return jobs if state is None else jobs.filter(F.col("state") == state)


def has_tags(required: Sequence[str]) -> Column:
    """All of ``required`` (repeats count once) are among the tags; none required always holds."""
    out = F.lit(True)
    for tag in dict.fromkeys(required):
        out = out & F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return out


def with_tags(jobs: DataFrame, required: Sequence[str], state: str | None = None, correlation_id: str | None = None) -> DataFrame:
    """State and correlation reach the scan; the tags filter what is read. A null correlation never matches one."""
    found = in_state(jobs, state)
    if correlation_id is not None:
        found = found.filter(F.col("correlation_id") == correlation_id)
    return found.filter(has_tags(required))


def fetch(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def purgeable(state: str, cutoff: Time) -> Column:
    return (F.col("state") == state) & (activity_time() < cutoff)


def purge(jobs: DataFrame, state: str, cutoff: Time) -> DataFrame:
    """What stays."""
    return jobs.filter(~purgeable(state, cutoff))


# summary -----------------------------------------------------------------------------------------------------------


def summarize(jobs: DataFrame) -> DataFrame:
    """One row: counts by state and four times, in one pass; of no jobs zeros and nulls."""
    open_ = outstanding()
    return jobs.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("state") == s).alias(s) for s in JOB_STATES],
        F.count_if(open_).alias("outstanding"),
        F.min("created_at").alias("oldest_created"),
        F.min(F.when(open_, F.col("created_at"))).alias("oldest_outstanding"),
        F.max(activity_time()).alias("latest_update"),
        F.min(F.when(open_, F.col("due_at"))).alias("next_due"),
    )


# mutations ---------------------------------------------------------------------------------------------------------


def changed(jobs: DataFrame, where: Column, now: Time, **to: Column) -> DataFrame:
    """Rows where ``where`` holds get the columns ``to`` and ``updated_at`` = ``now``; the others stay as they are."""
    hit = F.coalesce(where, F.lit(False))
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in {**to, "updated_at": now}.items()})


def transition(jobs: DataFrame, where: Column, state: str, now: Time, message: Column | None = None) -> DataFrame:
    """Any state to any state; the error message is overwritten, and cleared without one."""
    return changed(jobs, where, now, state=F.lit(state), error_message=message if message is not None else F.lit(None).cast("string"))


def transition_joined(jobs: DataFrame, ids: DataFrame, state: str, now: Time, message: Column | None = None) -> DataFrame:
    """:func:`transition` of the jobs whose id is in ``ids``."""
    marked = jobs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return transition(marked, F.col("_hit"), state, now, message).select(jobs.columns)


def resume_active(jobs: DataFrame, now: Time) -> DataFrame:
    return transition(jobs, active(), "submitted", now)


def retry(jobs: DataFrame, where: Column, now: Time, clear_error: bool = True) -> DataFrame:
    """Back to submitted from any state; attempts are kept."""
    keep = {} if clear_error is False else {"error_message": F.lit(None).cast("string")}
    return changed(jobs, where, now, state=F.lit("submitted"), **keep)


def set_priority(jobs: DataFrame, where: Column, priority: int, now: Time) -> DataFrame:
    return changed(jobs, where & ~F.col("priority").eqNullSafe(priority), now, priority=F.lit(priority))


def set_due(jobs: DataFrame, where: Column, due: Time, now: Time) -> DataFrame:
    return changed(jobs, where & ~F.col("due_at").eqNullSafe(due), now, due_at=due)


def set_correlation(jobs: DataFrame, where: Column, value: str | None, now: Time) -> DataFrame:
    return changed(jobs, where & ~F.col("correlation_id").eqNullSafe(F.lit(value)), now, correlation_id=F.lit(value).cast("string"))


def add_item(jobs: DataFrame, column: str, where: Column, item: str, now: Time) -> DataFrame:
    """Append to ``tags`` or ``attachments`` where it is missing; rows that have it are not touched."""
    return changed(jobs, where & ~F.array_contains(column, item), now, **{column: F.array_append(column, F.lit(item))})


def remove_item(jobs: DataFrame, column: str, where: Column, item: str, now: Time) -> DataFrame:
    return changed(jobs, where & F.array_contains(column, item), now, **{column: F.array_remove(column, item)})


def clear_items(jobs: DataFrame, column: str, where: Column, now: Time) -> DataFrame:
    return changed(jobs, where & (F.size(column) > 0), now, **{column: F.array().cast("array<string>")})


def claim(jobs: DataFrame, n: int, now: Time, next_state: str = "validating") -> DataFrame:
    """The first ``n`` submitted jobs of the queue, as they are once claimed. Plans as a top-n."""
    first = jobs.filter(F.col("state") == "submitted").orderBy(*queue_order()).limit(n)
    return first.withColumns(
        {"state": F.lit(next_state), "updated_at": now, "last_attempt_at": now, "error_message": F.lit(None).cast("string"), "attempt_count": F.col("attempt_count") + 1}
    )


def upsert(jobs: DataFrame, new: DataFrame, now: Time) -> DataFrame:
    """``new`` replaces rows of equal id, whole; it is stamped ``now`` (of repeated new ids one row is kept)."""
    fresh = new.withColumn("updated_at", now).dropDuplicates(["id"])
    return jobs.join(fresh.select("id"), "id", "left_anti").select(jobs.columns).unionByName(fresh.select(jobs.columns))


def delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("id"), "id", "left_anti").select(jobs.columns)


def imported(jobs: DataFrame, now: Time, salt: str = "import") -> DataFrame:
    """New submitted jobs with fresh ids from old ones; keeps payload, correlation, priority and due; ``source_id`` maps back."""
    return jobs.select(
        F.sha2(F.concat_ws("|", F.lit(salt), "id"), 256).substr(1, 32).alias("id"), F.lit("submitted").alias("state"), "source_path", "profile_name", "attachments", "tags",
        now.alias("created_at"), now.alias("updated_at"), "correlation_id", F.lit(None).cast("string").alias("error_message"), "priority", F.lit(0).cast("bigint").alias("attempt_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"), "due_at", F.col("id").alias("source_id"),
    )


def create(payloads: DataFrame, now: Time) -> DataFrame:
    """Submitted jobs with random ids from rows (source_path, profile_name, attachments, tags, correlation_id, priority, due_at)."""
    return imported(payloads.withColumn("id", F.uuid()), now, "create").drop("source_id")


# children and events -------------------------------------------------------------------------------------------------


def exploded(jobs: DataFrame, column: str, name: str) -> DataFrame:
    return jobs.select(F.col("id").alias("job_id"), F.posexplode(column).alias("idx", name))


def collected(children: DataFrame, name: str) -> DataFrame:
    """(id, array) from child rows (job_id, idx, name): one aggregation, no query per job."""
    rows = F.array_sort(F.collect_list(F.struct("idx", name)))
    return children.groupBy(F.col("job_id").alias("id")).agg(rows.alias("r")).select("id", F.col(f"r.{name}").alias(name))


def events_between(before: DataFrame, after: DataFrame, message: str | None = None) -> DataFrame:
    """(job_id, state, message) of each job that is new or has changed; a job in exception says its error, unless ``message`` is given.

    Removed jobs have no event. Only a hash of each row is joined.
    """
    own = F.xxhash64(*[c for c in after.columns if c != "id"])
    was = before.select("id", F.xxhash64(*[c for c in after.columns if c != "id"]).alias("_was"))
    touched = after.withColumn("_now", own).join(was, "id", "left").filter(~F.col("_now").eqNullSafe(F.col("_was")))
    said = F.lit(message).cast("string") if message is not None else F.col("error_message")
    return touched.select(F.col("id").alias("job_id"), "state", said.alias("message"))


def latest(events: DataFrame) -> DataFrame:
    """Of each job the state and message of its last event."""
    last = F.max_by(F.struct("state", "message"), "seq")
    return events.groupBy("job_id").agg(last.alias("e"), F.max("seq").alias("seq")).select("job_id", "seq", "e.state", "e.message")


def folded(jobs: DataFrame, events: DataFrame, now: Time) -> DataFrame:
    """``jobs`` with the last event of each applied; events of unknown ids are ignored."""
    last = latest(events).select(F.col("job_id").alias("id"), F.col("state").alias("_state"), F.col("message").alias("_message"))
    joined = jobs.join(last, "id", "left")
    return transition_columns(joined, F.col("_state").isNotNull(), F.col("_state"), F.col("_message"), now).select(jobs.columns)


def transition_columns(rows: DataFrame, where: Column, state: Column, message: Column, now: Time) -> DataFrame:
    return changed(rows, where, now, state=state, error_message=message)


def run_batch(jobs: DataFrame, n: int, now: Time, handler) -> DataFrame:
    """Claim ``n`` jobs, run ``handler(row) -> (outcome, message)`` on executors, and return them with their outcome folded.

    Outcomes are completed, failed and cancelled. A handler that raises fails its job with the exception's text; a
    failure without message says "job failed".
    """
    claimed = claim(jobs, n, now)
    kinds = {"completed": "completed", "failed": "exception", "cancelled": "cancelled"}

    def run(batches):
        for pdf in batches:
            got = []
            for row in pdf.to_dict("records"):
                try:
                    outcome, message = handler(row)
                except Exception as e:  # the job fails, not the batch
                    outcome, message = "failed", str(e)
                got.append((kinds[outcome], message if outcome != "failed" or message else "job failed"))
            pdf["state"] = [s for s, _ in got]
            pdf["error_message"] = [m if s != "completed" else None for s, m in got]
            yield pdf

    return claimed.mapInPandas(run, claimed.schema)
