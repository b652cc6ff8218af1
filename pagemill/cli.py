"""Command line over a snapshot store: ``python -m pagemill.cli --store PATH VERB ...``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import job_json, jobs as J, policy as P
from pagemill.plans import profile as profiles
from pagemill.schema import JOB
from pagemill.sources.job_store import SnapshotStore, event_folder
from pagemill.sources.shared import saved


#: Jobs of a batch of ``run-next --continue``.
CLAIMED_AT_ONCE = 100_000


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.removesuffix("Z"))


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagemill")
    top.add_argument("--store", default="pagemill-store")
    top.add_argument("--events", help="folder to which the events of all changes are appended")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        for a in args:
            p.add_argument(a)
        for o, kind in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind} if kind is not list else {"action": "append", "default": []}))
        return p

    verb("migrate")
    verb("submit", "path", profile=str, correlation=str, priority=int, due=_time, tag=list, attach=list)
    for name in ("list", "export"):
        verb(name, state=str, tag=list, correlation=str)
    verb("import", "file")
    verb("fail", "id", "message")
    for name in ("complete", "retry", "clear-attachments", "clear-tags"):
        verb(name, "id")
    verb("prioritize", "id", "priority")
    verb("reschedule", "id", "due")
    verb("correlate", "id", "correlation")
    for name in ("attach", "detach", "tag", "untag"):
        verb(name, "id", "item")
    rebalance = verbs.add_parser("rebalance")
    rebalance.add_argument("policies", nargs="*")
    rebalance.add_argument("--within-minutes", nargs=2, type=int, action="append", default=[], metavar=("MINUTES", "PRIORITY"))
    rebalance.add_argument("--overdue", type=int)
    rebalance.add_argument("--no-overdue-escalation", action="store_true")
    verb("report")
    verb("purge", "state", "older_than", dry_run=bool)
    verb("run-next", fail=str, cancel=str, resume=bool, **{"continue": bool})
    verb("profile-init", "file")
    verb("profile-show", "file")
    verb("profile-validate", "file")
    verb("process", "folder", "profile", good_list=str, exception_list=str)
    return top


def _changes(a: argparse.Namespace, now) -> dict:
    """Verbs that change one job: what they make of all jobs."""
    one = F.col("id") == getattr(a, "id", "")
    return {
        "fail": lambda d: J.transition(d, one, "exception", now, F.lit(a.message)),
        "complete": lambda d: J.transition(d, one, "completed", now),
        "retry": lambda d: J.retry(d, one, now),
        "prioritize": lambda d: J.set_priority(d, one, int(a.priority), now),
        "reschedule": lambda d: J.set_due(d, one, F.lit(None if a.due == "none" else _time(a.due)).cast("timestamp_ntz"), now),
        "correlate": lambda d: J.set_correlation(d, one, None if a.correlation == "none" else a.correlation, now),
        "attach": lambda d: J.add_item(d, "attachments", one, a.item, now),
        "detach": lambda d: J.remove_item(d, "attachments", one, a.item, now),
        "clear-attachments": lambda d: J.clear_items(d, "attachments", one, now),
        "tag": lambda d: J.add_item(d, "tags", one, a.item, now),
        "untag": lambda d: J.remove_item(d, "tags", one, a.item, now),
        "clear-tags": lambda d: J.clear_items(d, "tags", one, now),
        "rebalance": lambda d: P.escalate(d, _policy(a), now),
    }


def _jobs_file(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a JSON file, or with ``-`` of the standard input."""
    return job_json.from_json_array(spark.createDataFrame([(sys.stdin.read(),)], "value string")) if path == "-" else job_json.read_json(spark, path)


def _policy(a: argparse.Namespace) -> P.Policy:
    """The files' policy, with what the options say over it."""
    said = {k for k, v in (("windows", a.within_minutes), ("overdue", a.overdue is not None), ("escalate", a.no_overdue_escalation)) if v}
    own = P.Policy([(60 * m, p) for m, p in a.within_minutes], a.overdue, not a.no_overdue_escalation, frozenset(said))
    policy = own.over(P.load(a.policies))
    if not policy.stated:
        raise P.PolicyError("rebalance needs a policy file, --within-minutes or --overdue")
    return policy


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    """Exit code 0, or 1 where nothing was found or a batch had failures."""
    a = _parser().parse_args(argv)
    store, now = SnapshotStore(spark, a.store, event_folder(a.events) if a.events else None), F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    changes = _changes(a, now)
    if a.verb in changes:
        if hasattr(a, "id") and J.fetch(store.jobs(), a.id).isEmpty():
            print(f"no job {a.id}", file=out)
            return 1
        print(f"version {store.apply(changes[a.verb])}", file=out)
    elif a.verb == "migrate":
        print(f"version {store.apply(lambda d: d)}", file=out)
    elif a.verb == "submit":
        row = ("x", "submitted", a.path, a.profile, a.attach, a.tag, None, None, a.correlation, None, a.priority or 0, 0, None, a.due)
        new = saved(J.create(spark.createDataFrame([row], JOB), now))  # its random id is settled
        store.upsert(new, now)
        print(new.first().id, file=out)
    elif a.verb in ("list", "export"):
        rows = J.in_queue_order(J.with_tags(store.jobs(), a.tag, a.state, a.correlation))
        if a.verb == "export":
            for part in job_json.array_parts(rows):
                out.write(part)
            print(file=out)
        else:
            for r in rows.select(job_json.tsv().alias("line")).toLocalIterator():
                print(r.line, file=out)
    elif a.verb == "import":
        new = saved(J.imported(_jobs_file(spark, a.file), now, str(dt.datetime.now())))
        store.upsert(new.drop("source_id"), now)
        for r in new.select("source_id", "id").toLocalIterator():
            print(f"{r.source_id}\t{r.id}", file=out)
    elif a.verb == "report":
        print(job_json.summary_json(J.summarize(store.jobs())).first().json, file=out)
    elif a.verb == "purge":
        cutoff = F.lit(_time(a.older_than)).cast("timestamp_ntz")
        print(store.jobs().filter(J.purgeable(a.state, cutoff)).count(), file=out)
        if not a.dry_run:
            store.apply(lambda d: J.purge(d, a.state, cutoff))
    elif a.verb == "run-next":
        if a.resume:
            store.apply(lambda d: J.resume_active(d, now))
        # one job, or with --continue all of them: a batch is claimed in one commit and ended in another
        n = CLAIMED_AT_ONCE if getattr(a, "continue") else 1
        end = ("exception", a.fail) if a.fail else ("cancelled", a.cancel) if a.cancel else ("completed", None)
        while not (got := store.claim(n, now)).isEmpty():
            store.apply(lambda d: J.transition_joined(d, got.select("id"), end[0], now, F.lit(end[1]).cast("string")))
            for r in J.in_queue_order(got).toLocalIterator():
                print(f"{r.id}\t{end[0]}", file=out)
            if n == 1:
                break
    elif a.verb == "profile-init":
        with open(a.file, "w") as f:
            f.write(profiles.to_json(profiles.profile()) + "\n")
    elif a.verb in ("profile-show", "profile-validate"):
        with open(a.file) as f:
            p = profiles.from_json(f.read())
        print(profiles.to_json(p) if a.verb == "profile-show" else "valid", file=out)
    elif a.verb == "process":
        from pagemill.plans import directory

        with open(a.profile) as f:
            got = directory.process(spark, a.folder, profiles.from_json(f.read()))
        s, stamp = got["summary"], dt.datetime.now().isoformat(timespec="seconds")
        for path, rows, what, n in ((a.good_list, got["good"], "succeeded", s["succeeded"]), (a.exception_list, got["exceptions"], "total_exceptions", s["failed"])):
            if path:
                with open(path, "w") as f:
                    f.writelines(directory.list_document(rows, s["total"], n, what, stamp))
        print(json.dumps(s), file=out)
        return int(not s["success"])
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
