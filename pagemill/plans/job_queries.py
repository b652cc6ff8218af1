"""Queries over the queue, with the SQL that states their results. Jobs are derived from orders and their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import expressions as X
from pagemill.operators import job_json, jobs as J, policy as P
from pagemill.plans import handlers
from pagemill.schema import JOB_STATES
from pagemill.sources import job_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = "1999-06-01 12:00:00"


def now():
    """The clock of all queries."""
    return F.lit(NOW).cast("timestamp_ntz")



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_of(spark: SparkSession, sf_dir: str, children: bool = True) -> DataFrame:
    """A job for each order; its lines, aggregated once, give times, attachments and tags."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    aggs = [F.max("l_shipdate").alias("updated_at")]
    if children:
        aggs += [F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("part-"), x.l_partkey.cast("string"))).alias("attachments"), F.array_sort(F.collect_set(F.lower("l_returnflag"))).alias("tags")]
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*aggs)
    none = F.array().cast("array<string>")
    joined = o.join(lines, "o_orderkey", "left")
    state = F.element_at(F.array(*map(F.lit, JOB_STATES)), (k % 6 + 1).cast("int"))
    arrays = [F.coalesce("attachments", none).alias("attachments"), F.coalesce("tags", none).alias("tags")] if children else [none.alias("attachments"), none.alias("tags")]
    return joined.select(
        F.concat(F.lit("job-"), k.cast("string")).alias("id"), state.alias("state"), F.concat(F.lit("/in/"), k.cast("string"), F.lit(".tif")).alias("source_path"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("profile-"), (F.col("o_custkey") % 7).cast("string"))).alias("profile_name"), *arrays,
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("batch-"), (F.col("o_custkey") % 50).cast("string"))).alias("correlation_id"),
        F.when(k % 6 == 3, F.lit("paper jam")).alias("error_message"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), (k % 4).cast("bigint").alias("attempt_count"),
        F.when(k % 4 > 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("last_attempt_at"),
        F.when(k % 4 > 0, F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval((k % 30).cast("int"))).alias("due_at"),
    )


_STATE = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(JOB_STATES)) + " END"
WITH_JOBS = f"""WITH lines AS (SELECT l_orderkey, max(l_shipdate) AS updated_at,
  list('part-' || CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS attachments,
  list_sort(list_distinct(list(lower(l_returnflag)))) AS tags FROM lineitem GROUP BY l_orderkey),
jobs AS (SELECT 'job-' || CAST(o_orderkey AS VARCHAR) AS id, {_STATE} AS state, '/in/' || CAST(o_orderkey AS VARCHAR) || '.tif' AS source_path,
  CASE WHEN o_custkey % 3 > 0 THEN 'profile-' || CAST(o_custkey % 7 AS VARCHAR) END AS profile_name,
  coalesce(attachments, CAST([] AS VARCHAR[])) AS attachments, coalesce(tags, CAST([] AS VARCHAR[])) AS tags,
  o_orderdate AS created_at, updated_at, CASE WHEN o_custkey % 5 > 0 THEN 'batch-' || CAST(o_custkey % 50 AS VARCHAR) END AS correlation_id,
  CASE WHEN o_orderkey % 6 = 3 THEN 'paper jam' END AS error_message, 6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  CAST(o_orderkey % 4 AS BIGINT) AS attempt_count, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS last_attempt_at,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS due_at
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)
"""
_QUEUE = "priority DESC, due_at ASC NULLS LAST, created_at ASC, id ASC"
_FLAT = ("id", "state", "profile_name", "created_at", "updated_at", "correlation_id", "error_message", "priority", "attempt_count", "last_attempt_at", "due_at")
_FLAT_SQL = ", ".join(_FLAT) + ", array_to_string(tags, ',') AS tags, CAST(len(attachments) AS BIGINT) AS n_attachments"
_NOW = f"TIMESTAMP '{NOW}'"


def flat(jobs: DataFrame) -> DataFrame:
    return jobs.select(*_FLAT, F.array_join("tags", ",").alias("tags"), F.size("attachments").cast("bigint").alias("n_attachments"))


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` starts with the jobs relation unless it has its own WITH."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return put


def _with(select: str) -> str:
    return WITH_JOBS + select


def _changed(set_to: dict[str, str], where: str) -> str:
    """All jobs with columns replaced where a condition holds, flat."""
    cols = {c: c for c in (*_FLAT, "tags", "attachments")} | {}
    out = [f"CASE WHEN {where} THEN {set_to[c]} ELSE {c} END AS {c}" if c in set_to else c for c in cols]
    return _with(f"SELECT {_FLAT_SQL} FROM (SELECT {', '.join(out)} FROM jobs)")


_SUMMARY = (
    "SELECT count(*) AS total, " + ", ".join(f"CAST(count(*) FILTER (state = '{s}') AS BIGINT) AS {s}" for s in JOB_STATES)
    + ", CAST(count(*) FILTER (state NOT IN ('completed', 'cancelled')) AS BIGINT) AS outstanding, min(created_at) AS oldest_created,"
    " min(created_at) FILTER (state NOT IN ('completed', 'cancelled')) AS oldest_outstanding, max(coalesce(updated_at, created_at)) AS latest_update,"
    " min(due_at) FILTER (state NOT IN ('completed', 'cancelled')) AS next_due FROM jobs"
)


@query("job_summary", _with(_SUMMARY))
def job_summary(spark, d):
    return J.summarize(jobs_of(spark, d, children=False))


@query("jobs_by_state", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE state = 'exception'"))
def jobs_by_state(spark, d):
    return flat(J.in_state(jobs_of(spark, d), "exception"))


@query("jobs_queue_order", _with(f"SELECT id, row_number() OVER (ORDER BY {_QUEUE}) AS position FROM jobs"))
def jobs_queue_order(spark, d):
    return J.ranked(jobs_of(spark, d, children=False).select("id", "priority", "due_at", "created_at"), "position").select("id", "position")


@query("job_rank", _with(f"SELECT id, row_number() OVER (ORDER BY {_QUEUE}) AS queue_rank FROM jobs WHERE state = 'submitted'"))
def job_rank(spark, d):
    return J.ranked(J.in_state(jobs_of(spark, d, children=False), "submitted").select("id", "priority", "due_at", "created_at"), "queue_rank").select("id", "queue_rank")


def _claim_sql(n: int) -> str:
    return _with(
        f"SELECT id, 'validating' AS state, {_NOW} AS updated_at, {_NOW} AS last_attempt_at, attempt_count + 1 AS attempt_count, CAST(NULL AS VARCHAR) AS error_message"
        f" FROM (SELECT * FROM jobs WHERE state = 'submitted' ORDER BY {_QUEUE} LIMIT {n})"
    )


for _n, _name in ((1, "claim_top1"), (100, "claim_top100")):

    @query(_name, _claim_sql(_n))
    def claim_top(spark, d, n=_n):
        return J.claim(jobs_of(spark, d, children=False), n, now()).select("id", "state", "updated_at", "last_attempt_at", "attempt_count", "error_message")


@query("jobs_with_all_tags", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE list_contains(tags, 'a') AND list_contains(tags, 'n')"))
def jobs_with_all_tags(spark, d):
    return flat(J.with_tags(jobs_of(spark, d), ["a", "n", "a"]))


@query("jobs_tags_and_correlation", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE list_contains(tags, 'r') AND correlation_id = 'batch-7' AND state = 'submitted'"))
def jobs_tags_and_correlation(spark, d):
    return flat(J.with_tags(jobs_of(spark, d), ["r"], "submitted", "batch-7"))


@query("purge_preview", _with(f"SELECT count(*) AS purged FROM jobs WHERE state = 'completed' AND coalesce(updated_at, created_at) < {_NOW}"))
def purge_preview(spark, d):
    return jobs_of(spark, d, children=False).filter(J.purgeable("completed", now())).agg(F.count("*").alias("purged"))


@query("purge_remaining", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE NOT (state = 'completed' AND coalesce(updated_at, created_at) < {_NOW})"))
def purge_remaining(spark, d):
    return flat(J.purge(jobs_of(spark, d), "completed", now()))


_CLEAR = {"error_message": "NULL", "updated_at": _NOW}


@query("resume_active", _changed({"state": "'submitted'", **_CLEAR}, "state IN ('validating', 'rendering')"))
def resume_active(spark, d):
    return flat(J.resume_active(jobs_of(spark, d), now()))


@query("retry_failed", _changed({"state": "'submitted'", **_CLEAR}, "state = 'exception'"))
def retry_failed(spark, d):
    return flat(J.retry(jobs_of(spark, d), F.col("state") == "exception", now()))


@query("transition_batch", _changed({"state": "'exception'", "error_message": "'lamp failure'", "updated_at": _NOW}, "correlation_id = 'batch-11'"))
def transition_batch(spark, d):
    return flat(J.transition(jobs_of(spark, d), F.col("correlation_id") == "batch-11", "exception", now(), F.lit("lamp failure")))


POLICY = P.parse("within-minutes=2880 priority=25\nwithin-minutes=28800,priority=7 ; wide\nminutes=720 priority=75\noverdue=100\n")
_LEFT = f"date_diff('second', {_NOW}, due_at)"
_TARGET = f"CASE WHEN {_LEFT} <= 0 THEN {{overdue}} WHEN {_LEFT} <= 43200 THEN 75 WHEN {_LEFT} <= 172800 THEN 25 WHEN {_LEFT} <= 1728000 THEN 7 END"
_OPEN_DUE = "state NOT IN ('completed', 'cancelled') AND due_at IS NOT NULL"


def _escalated(overdue: int) -> str:
    t = _TARGET.format(overdue=overdue)
    return _with(f"SELECT id, greatest(priority, {t}) AS priority, ({t} > priority) AS raised FROM jobs WHERE {_OPEN_DUE} AND {t} IS NOT NULL")


def _escalate(spark, d, policy):
    before = jobs_of(spark, d, children=False)
    after = P.escalate(before.withColumn("was", F.col("priority")), policy, now())
    to = P.target_priority(policy, P.remaining_seconds(F.col("due_at"), now()))
    return after.filter(J.outstanding() & F.col("due_at").isNotNull() & to.isNotNull()).select("id", "priority", (F.col("priority") > F.col("was")).alias("raised"))


@query("escalate_policy", _escalated(100))
def escalate_policy(spark, d):
    return _escalate(spark, d, POLICY)


@query("escalate_overdue_fallback", _escalated(7))
def escalate_overdue_fallback(spark, d):
    return _escalate(spark, d, P.Policy(POLICY.windows))


@query(
    "escalate_policy_table",
    _with(
        f"SELECT id, CASE WHEN {_LEFT} <= 0 THEN 40 ELSE (SELECT arg_min(r_regionkey * 10, r_regionkey) FROM region WHERE {_LEFT} <= (r_regionkey + 1) * 432000) END AS target FROM jobs"
        f" WHERE {_OPEN_DUE} AND ({_LEFT} <= 0 OR {_LEFT} <= 5 * 432000)"
    ),
)
def escalate_policy_table(spark, d):
    windows = table(spark, d, "region").select(((F.col("r_regionkey") + 1) * 432000).alias("within_seconds"), (F.col("r_regionkey") * 10).alias("priority"))
    return P.escalate_by_table(jobs_of(spark, d, children=False), windows, now(), 40)


@query("policy_layer_merge", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(7200 AS BIGINT), 40), (1, 1800, 80), (2, 0, 120)) AS t(item, within_seconds, priority)")
def policy_layer_merge(spark, d):
    merged = P.layered([P.parse("within=120 priority=40\noverdue=90"), P.parse("no-overdue-escalation"), P.parse("within=30 priority=80\nescalate-overdue=true"), P.parse("overdue=120")])
    rows = [(i, w, p) for i, (w, p) in enumerate(merged.windows)] + [(len(merged.windows), 0, merged.overdue)]
    return spark.createDataFrame(rows, "item bigint, within_seconds bigint, priority int")


@query("jobs_from_tables", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE state = 'submitted'"))
def jobs_from_tables(spark, d):
    """Jobs put apart into the tables of a database and together again."""
    parts = job_tables.to_tables(jobs_of(spark, d))
    return flat(J.in_state(job_tables.from_tables(parts["jobs"], parts["attachments"], parts["tags"]), "submitted"))


@query("jobs_created_order", _with("SELECT id, row_number() OVER (ORDER BY created_at ASC, id ASC) AS position FROM jobs"))
def jobs_created_order(spark, d):
    order = [F.col("created_at").asc(), F.col("id").asc()]
    return J.numbered(jobs_of(spark, d, children=False).select("id", "created_at"), order, "position").select("id", "position")


@query("fetch_job", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE id = 'job-7'"))
def fetch_job(spark, d):
    return flat(J.fetch(jobs_of(spark, d), "job-7"))


@query("job_json_arrays", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE correlation_id = 'batch-2'"))
def job_json_arrays(spark, d):
    """Arrays of two records each, a job and its copy, of which one is kept."""
    one = F.col("json")
    arrays = job_json.with_json(J.with_tags(jobs_of(spark, d), [], None, "batch-2")).select(F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]")).alias("value"))
    return flat(job_json.from_json_array(arrays).dropDuplicates(["id"]))


@query("create_jobs", _with(f"SELECT 'submitted' AS state, source_path, priority, due_at, correlation_id, CAST(0 AS BIGINT) AS attempt_count, {_NOW} AS created_at, {_NOW} AS updated_at, 32 AS id_length, CAST(NULL AS VARCHAR) AS error_message FROM jobs"))
def create_jobs(spark, d):
    made = J.create(jobs_of(spark, d).drop("id"), now())
    return made.select("state", "source_path", "priority", "due_at", "correlation_id", "attempt_count", "created_at", "updated_at", F.length("id").alias("id_length"), "error_message")


@query("events_of_changes", _with("SELECT id AS job_id, 'submitted' AS state, 'to the queue' AS message FROM jobs WHERE state = 'exception'"))
def events_of_changes(spark, d):
    """The events that a store sends when failed jobs go back to the queue."""
    jobs = jobs_of(spark, d)
    return J.events_between(jobs, J.retry(jobs, F.col("state") == "exception", now()), "to the queue")


_NEW = "SELECT * REPLACE (42 AS priority, 'rendering' AS state) FROM jobs WHERE id LIKE '%7'"


@query("upsert_snapshot", _with(f"SELECT {_FLAT_SQL} FROM (SELECT * FROM jobs WHERE id NOT LIKE '%7' UNION ALL SELECT * REPLACE ({_NOW} AS updated_at) FROM ({_NEW}))"))
def upsert_snapshot(spark, d):
    jobs = jobs_of(spark, d)
    return flat(J.upsert(jobs, jobs.filter(F.col("id").endswith("7")).withColumns({"priority": F.lit(42), "state": F.lit("rendering")}), now()))


@query("delete_snapshot", _with(f"SELECT {_FLAT_SQL} FROM jobs WHERE id NOT LIKE '%3'"))
def delete_snapshot(spark, d):
    jobs = jobs_of(spark, d)
    return flat(J.delete(jobs, jobs.filter(F.col("id").endswith("3")).select("id")))


@query("attachments_explode", _with("SELECT id AS job_id, CAST(i - 1 AS BIGINT) AS idx, attachments[i] AS path FROM (SELECT id, attachments, unnest(range(1, len(attachments) + 1)) AS i FROM jobs)"))
def attachments_explode(spark, d):
    return J.exploded(jobs_of(spark, d), "attachments", "path").withColumn("idx", F.col("idx").cast("bigint"))


@query("attachments_collect", _with("SELECT id, array_to_string(attachments, '|') AS attachments FROM jobs WHERE len(attachments) > 0"))
def attachments_collect(spark, d):
    children = J.exploded(jobs_of(spark, d), "attachments", "path")
    return J.collected(children, "path").select("id", F.array_join("path", "|").alias("attachments"))


@query("tags_add", _changed({"tags": "list_append(tags, 'n')", "updated_at": _NOW}, "priority > 2 AND NOT list_contains(tags, 'n')"))
def tags_add(spark, d):
    return flat(J.add_item(jobs_of(spark, d), "tags", F.col("priority") > 2, "n", now()))


@query("tags_remove", _changed({"tags": "list_filter(tags, lambda x: x <> 'a')", "updated_at": _NOW}, "list_contains(tags, 'a')"))
def tags_remove(spark, d):
    return flat(J.remove_item(jobs_of(spark, d), "tags", F.lit(True), "a", now()))


@query("attachments_clear", _changed({"attachments": "CAST([] AS VARCHAR[])", "updated_at": _NOW}, "state = 'cancelled' AND len(attachments) > 0"))
def attachments_clear(spark, d):
    return flat(J.clear_items(jobs_of(spark, d), "attachments", F.col("state") == "cancelled", now()))


@query("set_priority", _changed({"priority": "4", "updated_at": _NOW}, "correlation_id = 'batch-3' AND priority <> 4"))
def set_priority(spark, d):
    return flat(J.set_priority(jobs_of(spark, d), F.col("correlation_id") == "batch-3", 4, now()))


@query("reschedule", _changed({"due_at": "TIMESTAMP '2000-01-01'", "updated_at": _NOW}, "state = 'submitted' AND due_at IS DISTINCT FROM TIMESTAMP '2000-01-01'"))
def reschedule(spark, d):
    return flat(J.set_due(jobs_of(spark, d), F.col("state") == "submitted", F.lit("2000-01-01").cast("timestamp_ntz"), now()))


@query("correlate", _changed({"correlation_id": "'batch-9'", "updated_at": _NOW}, "priority = 5 AND correlation_id IS DISTINCT FROM 'batch-9'"))
def correlate(spark, d):
    return flat(J.set_correlation(jobs_of(spark, d), F.col("priority") == 5, "batch-9", now()))


_QUOTE = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_JTIME = lambda c: f"coalesce('\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ') || '\"', 'null')"
_JLIST = lambda c: f"CASE WHEN len({c}) = 0 THEN '[]' ELSE '[\"' || array_to_string({c}, '\",\"') || '\"]' END"
_JOB_JSON = (
    f"'{{\"id\":' || {_QUOTE('id')} || ',\"state\":' || {_QUOTE('state')} || ',\"payload\":{{\"source_path\":' || {_QUOTE('source_path')} || ',\"profile_name\":' || {_QUOTE('profile_name')}"
    f" || ',\"attachments\":' || {_JLIST('attachments')} || ',\"tags\":' || {_JLIST('tags')} || '}},\"created_at\":' || {_JTIME('created_at')} || ',\"updated_at\":' || {_JTIME('updated_at')}"
    f" || ',\"correlation_id\":' || {_QUOTE('correlation_id')} || ',\"error_message\":' || {_QUOTE('error_message')} || ',\"priority\":' || priority || ',\"attempt_count\":' || attempt_count"
    f" || ',\"last_attempt_at\":' || {_JTIME('last_attempt_at')} || ',\"due_at\":' || {_JTIME('due_at')} || '}}'"
)


@query("job_json", _with(f"SELECT id, {_JOB_JSON} AS json FROM jobs"))
def job_json_query(spark, d):
    return job_json.with_json(jobs_of(spark, d)).select("id", "json")


@query("job_json_roundtrip", _with(f"SELECT {_FLAT_SQL} FROM jobs"))
def job_json_roundtrip(spark, d):
    return flat(job_json.from_json(job_json.with_json(jobs_of(spark, d)).select("json")).filter("valid"))


_STIME = lambda c: f"coalesce('\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ') || '\"', 'null')"


@query(
    "summary_json",
    _with(
        "SELECT '{\"total\":' || total || " + " || ".join(f"',\"{s}\":' || {s}" for s in (*JOB_STATES, "outstanding"))
        + " || " + " || ".join(f"',\"{c}\":' || {_STIME(c)}" for c in ("oldest_created", "oldest_outstanding", "latest_update", "next_due")) + f" || '}}' AS json FROM ({_SUMMARY})"
    ),
)
def summary_json(spark, d):
    return job_json.summary_json(J.summarize(jobs_of(spark, d, children=False)))


@query(
    "import_jobs",
    _with(
        f"SELECT substr(sha256('import|' || id), 1, 32) AS id, 'submitted' AS state, id AS source_id, source_path, priority, due_at, correlation_id, {_NOW} AS created_at, CAST(0 AS BIGINT) AS attempt_count"
        " FROM jobs WHERE state IN ('completed', 'exception')"
    ),
)
def import_jobs(spark, d):
    old = jobs_of(spark, d, children=False).filter(F.col("state").isin("completed", "exception"))
    return J.imported(old, now()).select("id", "state", "source_id", "source_path", "priority", "due_at", "correlation_id", "created_at", "attempt_count")


_KINDS = {"signup": "submitted", "view": "validating", "click": "rendering", "error": "exception", "purchase": "completed"}


def events_of(spark, d):
    """Job events in the order of their time: a user is a job."""
    state = X.normalized(F.col("event_type"), _KINDS)
    return table(spark, d, "events").select(F.struct("ts", "event_id").alias("seq"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), state.alias("state"), F.when(F.col("event_type") == "error", F.col("props")).alias("message"))


_EVENT_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"


@query(
    "event_fold_latest",
    f"SELECT 'job-' || CAST(user_id AS VARCHAR) AS job_id, {_EVENT_STATE} AS state, CASE WHEN event_type = 'error' THEN props END AS message FROM"
    " (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def event_fold_latest(spark, d):
    return J.latest(events_of(spark, d)).select("job_id", "state", "message")


@query(
    "worker_run_batch",
    _with(
        "SELECT id, CASE WHEN k % 5 = 0 OR k % 3 = 1 THEN 'exception' WHEN k % 3 = 0 THEN 'completed' ELSE 'cancelled' END AS state,"
        " CASE WHEN k % 5 = 0 THEN 'no paper' WHEN k % 3 = 1 THEN 'job failed' WHEN k % 3 = 2 THEN 'by hand' END AS error_message, attempt_count + 1 AS attempt_count"
        f" FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS k FROM jobs WHERE state = 'submitted' ORDER BY {_QUEUE} LIMIT 500)"
    ),
)
def worker_run_batch(spark, d):
    return J.run_batch(jobs_of(spark, d, children=False), 500, now(), handlers.by_number).select("id", "state", "error_message", "attempt_count")


@query("page_parity", "SELECT l_orderkey, CAST(row_number() OVER w - 1 AS BIGINT) AS page_index, CAST((row_number() OVER w - 1) % 2 AS BIGINT) AS set_index FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def page_parity(spark, d):
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint") - 1
    return table(spark, d, "lineitem").select("l_orderkey", at.alias("page_index")).withColumn("set_index", F.pmod("page_index", F.lit(2)))


_DASH = lambda c: f"coalesce({c}, '-')"


@query("queue_tsv", _with(f"SELECT id || chr(9) || state || chr(9) || priority || chr(9) || {_DASH("strftime(due_at, '%Y-%m-%dT%H:%M:%SZ')")} || chr(9) || source_path || chr(9) || {_DASH('profile_name')} || chr(9) || {_DASH('correlation_id')} AS line FROM jobs"))
def queue_tsv(spark, d):
    return jobs_of(spark, d, children=False).select(job_json.tsv().alias("line"))


@query(
    "timestamp_parse",
    "SELECT o_orderkey, o_orderdate + to_microseconds(120000) AS strict_time, o_orderdate AS loose_time, CAST(NULL AS TIMESTAMP) AS bad_time FROM orders",
)
def timestamp_parse(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select(
        "o_orderkey", X.iso_time(F.concat(day, F.lit(".12Z"))).alias("strict_time"), X.iso_time(day, zone_required=False).alias("loose_time"), X.iso_time(day).alias("bad_time")
    )


@query("policy_tokens", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'within', '60'), (1, 1, 'priority', '80'), (2, 0, 'no-overdue-escalation', NULL)) AS t(line, position, key, value)")
def policy_tokens(spark, d):
    text = ["# nothing here", "within=60,priority=80 ; urgent", "No-Overdue-Escalation // bare"]
    return spark.createDataFrame([(i, j, k, v) for i, line in enumerate(text) for j, (k, v) in enumerate(P.tokens(line))], "line bigint, position bigint, key string, value string")


@query("enum_parse", _with("SELECT id, state AS parsed, CAST(NULL AS VARCHAR) AS unknown, 'inches' AS unit FROM jobs"))
def enum_parse(spark, d):
    return jobs_of(spark, d, children=False).select("id", X.state_of(F.upper("state")).alias("parsed"), X.state_of(F.concat("state", F.lit("x"))).alias("unknown"), X.normalized(F.lit("IN"), X.UNITS).alias("unit"))
