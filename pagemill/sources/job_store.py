"""Job stores: versioned Parquet snapshots, a folder of text files, JDBC tables, and the choice between them.

A snapshot is a new folder. Each version has a pointer file of its own, numbered, that is published whole and only if there
is none of that number yet; the largest number is current. So readers see the old or the new state at any time, also after
a writer has died, and of two writers that start from one version one gets a :class:`Conflict`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import jobs as J
from pagemill.schema import JOB, JOB_COLUMNS
from pagemill.sources import job_tables
from pagemill.sources.shared import stored

SCHEMA_VERSION = 7


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class _Files:
    """The few file operations that commits need, through Hadoop so that any store works."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self._path(p), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def publish(self, a: str, b: str) -> None:
        """Give the complete file ``a`` the name ``b`` in one step, unless there is a ``b``: by a hard link on a local disk,
        elsewhere by a rename, which fails on an existing file.
        """
        if self.fs.getUri().getScheme() == "file":
            local = lambda p: self.jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
            try:
                self.jvm.java.nio.file.Files.createLink(local(b), local(a))
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                    raise
                raise Conflict(f"{b} exists already") from None
            finally:
                self.fs.delete(self._path(a), False)
        elif self.exists(b) or not self.fs.rename(self._path(a), self._path(b)):
            raise Conflict(f"{b} exists already")


def migrated(jobs: DataFrame) -> DataFrame:
    """Jobs of any older layout with all columns of the current one: missing ones are null, lists empty, numbers zero. Repeating it changes nothing."""
    kinds = dict(c.split(" ", 1) for c in JOB.split(", "))
    empty = {"attachments": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"), "priority": F.lit(0), "attempt_count": F.lit(0).cast("bigint")}
    out = []
    for name, kind in kinds.items():
        c = F.col(name) if name in jobs.columns else F.lit(None)
        c = c.cast(kind)
        out.append((F.coalesce(c, empty[name].cast(kind)) if name in empty else c).alias(name))
    return jobs.select(*out)


@dataclass
class SnapshotStore:
    """``sink`` gets a frame (job_id, state, message) of the events of each change; see :func:`event_folder`."""

    spark: SparkSession
    root: str
    sink: Callable[[DataFrame], None] | None = None

    def _pointer(self, version: int | None = None) -> dict | None:
        files = _Files(self.spark, self.root)
        found = sorted(n for n in files.names(self.root) if re.fullmatch(r"version-\d{10}\.json", n))
        if version is not None:
            found = [n for n in found if n == f"version-{version:010d}.json"]
        return json.loads(files.read(f"{self.root}/{found[-1]}")) if found else None

    def version(self) -> int:
        return (self._pointer() or {"version": 0})["version"]

    def jobs(self, version: int | None = None) -> DataFrame:
        """The current snapshot, or that of ``version``; an older layout is migrated as it is read, a newer one is refused."""
        p = self._pointer(version)
        if p is None:
            return self.spark.createDataFrame([], JOB)
        if p["schema"] > SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema {p['schema']}; {SCHEMA_VERSION} is supported")
        return migrated(self.spark.read.parquet(f"{self.root}/{p['path']}"))

    def commit(self, jobs: DataFrame, based_on: int) -> int:
        """Write a snapshot and make it current, unless the store has moved on from ``based_on``."""
        name = f"snapshot-{based_on + 1:08d}-{uuid.uuid4().hex[:8]}"
        jobs.select(*JOB_COLUMNS).write.parquet(f"{self.root}/{name}")
        if self.version() != based_on:
            raise Conflict(f"version {based_on} is not current any more")
        files = _Files(self.spark, self.root)
        files.write(f"{self.root}/next-{name}.json", json.dumps({"version": based_on + 1, "path": name, "schema": SCHEMA_VERSION}))
        files.publish(f"{self.root}/next-{name}.json", f"{self.root}/version-{based_on + 1:010d}.json")
        return based_on + 1

    def apply(self, change, message: str | None = None) -> int:
        """Commit ``change(jobs)`` and send the events of the jobs it touched to the store's sink."""
        at = self.version()
        version = self.commit(change(self.jobs(at or None)), at)
        self._emit(at, version, message)
        return version

    def _emit(self, before: int, after: int, message: str | None) -> None:
        if self.sink is not None:
            self.sink(J.events_between(self.jobs(before or None) if before else self.spark.createDataFrame([], JOB), self.jobs(after), message))

    def upsert(self, new: DataFrame, now: Column) -> int:
        return self.apply(lambda jobs: J.upsert(jobs, migrated(new), now))

    def remove(self, ids: DataFrame) -> int:
        return self.apply(lambda jobs: J.delete(jobs, ids))

    def claim(self, n: int, now: Column) -> DataFrame:
        """The claimed jobs, once the claim is committed: settled first and committed in one step, so no other batch has them."""
        at = self.version()
        jobs = self.jobs(at or None)
        claimed = stored(J.claim(jobs, n, now).select(*JOB_COLUMNS), "claim")
        if not claimed.isEmpty():
            rest = jobs.join(claimed.select("id"), "id", "left_anti").select(*JOB_COLUMNS)
            self._emit(at, self.commit(rest.unionByName(claimed), at), None)
        return claimed


def event_folder(folder: str) -> Callable[[DataFrame], None]:
    """A sink that appends events with their time as JSON files, which :mod:`pagemill.streaming.events` reads."""
    return lambda events: events.select(F.current_timestamp().alias("ts"), "job_id", "state", "message").write.mode("append").json(folder)


# text files: one job a file, lines of key=value ----------------------------------------------------------------------

_PAIR = r"(?m)^([a-z_0-9]+)=(.*)$"


def _quoted(text: str | None) -> str:
    return '"' + (text or "").replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


def _unquoted(c: Column) -> Column:
    inner = F.regexp_extract(c, r'^"((?s:.*))"$', 1)
    for escape, char in ((r"\\n", "\n"), (r"\\r", "\r")):  # an escape stands after an even number of backslashes
        inner = F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)" + escape, "$1" + char)
    return F.regexp_replace(inner, r"\\(.)", "$1")


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of the ``.job`` files of a folder, not below it; files that lack id, state or source are skipped."""
    raw = spark.read.option("pathGlobFilter", "*.job").text(folder, wholetext=True)
    keys, values = F.regexp_extract_all("value", F.lit(_PAIR), F.lit(1)), F.regexp_extract_all("value", F.lit(_PAIR), F.lit(2))
    pairs = raw.select(F.arrays_zip(keys.alias("k"), values.alias("v")).alias("p"))
    last = F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda later: later["k"] == x["k"]))  # of a repeated key the last counts
    kept = pairs.select(F.map_from_entries(last).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    text = lambda k: F.when(get(k).isNotNull(), _unquoted(get(k)))
    time = lambda k: F.timestamp_micros(F.try_to_number(get(k), F.lit("S9999999999999999999")).cast("bigint")).cast("timestamp_ntz")
    items = lambda k, n: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.coalesce(get(n).cast("int"), F.lit(0)) - 1, F.lit(0))), lambda i: F.map_contains_key("m", F.concat(F.lit(f"{k}_"), i.cast("string")))), lambda i: _unquoted(F.element_at("m", F.concat(F.lit(f"{k}_"), i.cast("string")))))
    rows = kept.select(
        text("id").alias("id"), get("state").alias("state"), text("source_path").alias("source_path"), text("profile_name").alias("profile_name"), items("attachment", "attachments_count").alias("attachments"),
        items("tag", "tags_count").alias("tags"), time("created_at").alias("created_at"), time("updated_at").alias("updated_at"), text("correlation_id").alias("correlation_id"), text("error_message").alias("error_message"),
        get("priority").cast("int").alias("priority"), get("attempt_count").cast("bigint").alias("attempt_count"), time("last_attempt_at").alias("last_attempt_at"), time("due_at").alias("due_at"),
    )
    good = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("source_path", F.lit("")) != "") & F.col("state").isNotNull() & F.col("created_at").isNotNull()
    return migrated(rows.filter(good))


def job_text(row: dict) -> str:
    """The file of one job."""
    lines = [f"id={_quoted(row['id'])}", f"state={row['state']}", f"source_path={_quoted(row['source_path'])}"]
    lines += [f"{k}={_quoted(row[k])}" for k in ("profile_name", "correlation_id", "error_message") if row.get(k) is not None]
    for k, name in (("attachments", "attachment"), ("tags", "tag")):
        values = list(row.get(k) if row.get(k) is not None else [])
        lines += [f"{k}_count={len(values)}", *(f"{name}_{i}={_quoted(v)}" for i, v in enumerate(values))]
    epoch = lambda t: round((t - t.replace(year=1970, month=1, day=1, hour=0, minute=0, second=0, microsecond=0)).total_seconds() * 1_000_000)
    lines += [f"{k}={epoch(row[k])}" for k in ("created_at", "updated_at", "last_attempt_at", "due_at") if row.get(k) is not None]
    lines += [f"priority={row.get('priority') or 0}", f"attempt_count={row.get('attempt_count') or 0}"]
    return "\n".join(lines) + "\n"


def safe_name(job_id: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", job_id) + ".job"


def open_store(spark: SparkSession):
    """The store that the session's settings ask for: ``pagemill.store.path`` (snapshots), else the jobs, read only, of
    ``pagemill.store.jdbc`` (the address of a database), else of ``pagemill.store.text`` (a folder of files), else none.
    """
    path, url, text = (spark.conf.get(f"pagemill.store.{k}", None) for k in ("path", "jdbc", "text"))
    if path:
        return SnapshotStore(spark, path)
    if url:
        return job_tables.read_jdbc(spark, url)
    return read_text(spark, text) if text else spark.createDataFrame([], JOB)
