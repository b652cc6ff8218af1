"""Scheduling policies: text to windows on the driver, escalation as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.jobs import changed, outstanding

#: Words of the policy text and extensions of policy files.
MINUTE_WORDS = ("within", "within-minutes", "minutes")
OVERDUE_WORDS = ("overdue", "overdue-priority")
BARE_WORDS = ("no-overdue-escalation", "disable-overdue-escalation")
EXTENSIONS = ("", ".policy", ".cfg", ".conf", ".config", ".ini", ".txt")

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


class PolicyError(ValueError):
    pass


@dataclass
class Policy:
    """Windows (seconds, priority) in file order; whether overdue and escalation were stated matters when layers merge."""

    windows: list[tuple[int, int]] = field(default_factory=list)
    overdue: int | None = None
    escalate_overdue: bool = True
    stated: frozenset[str] = frozenset()

    def over(self, below: "Policy") -> "Policy":
        """This layer over another: its windows come after the other's, its overdue and escalation values replace them if stated."""
        pick = lambda part: self if part in self.stated else below
        return Policy(below.windows + self.windows, pick("overdue").overdue, pick("escalate").escalate_overdue, self.stated | below.stated)


def _int(text: str, line: int, low: int = -(2**31)) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", text) or not low <= int(text) < 2**31:
        raise PolicyError(f"line {line}: not a number in range: {text}")
    return int(text)


def tokens(line: str) -> list[tuple[str, str | None]]:
    """(key, value) of a line: comments cut off, commas as spaces; a word without ``=`` has no value."""
    line = re.split(r"#|;|//", line, maxsplit=1)[0]
    out = []
    for word in line.replace(",", " ").split():
        key, eq, value = word.partition("=")
        out.append((key.strip().lower(), value.strip() if eq else None))
    return out


def _truth(text: str, line: int) -> bool:
    if text.lower() not in TRUE + FALSE:
        raise PolicyError(f"line {line}: not a truth value: {text}")
    return text.lower() in TRUE


def parse(text: str) -> Policy:
    """A policy from its text. Errors name their line; unknown words on a line that has a known one are ignored."""
    out = Policy()
    stated = set()
    for number, raw in enumerate(text.splitlines(), 1):
        words = tokens(raw)
        if not words:
            continue
        said = dict(words)
        minutes = [k for k, _ in words if k in MINUTE_WORDS]
        overdue = [k for k, _ in words if k in OVERDUE_WORDS]
        bare = any(k in BARE_WORDS and v is None for k, v in words)
        for key in [*minutes, *overdue, *(k for k in ("priority", "escalate-overdue") if k in said)]:
            if said[key] is None:
                raise PolicyError(f"line {number}: missing value for {key}")
        if minutes or "priority" in said:
            if not minutes or "priority" not in said:
                raise PolicyError(f"line {number}: a window needs minutes and a priority")
            out.windows.append((60 * _int(said[minutes[-1]], number, 0), _int(said["priority"], number)))
            stated.add("windows")
        if overdue:
            out.overdue = _int(said[overdue[-1]], number)
            stated.add("overdue")
        if "escalate-overdue" in said or bare:
            out.escalate_overdue = not bare and _truth(said["escalate-overdue"], number)
            stated.add("escalate")
        if not (minutes or overdue or bare or "priority" in said or "escalate-overdue" in said):
            raise PolicyError(f"line {number}: nothing known in: {raw.strip()}")
    out.stated = frozenset(stated)
    return out


def layered(policies: Iterable[Policy]) -> Policy:
    out = Policy()
    for p in policies:
        out = p.over(out)
    return out


def load(paths: Iterable[str]) -> Policy:
    """Files, and folders of them (not below, not hidden, by path), later over earlier."""
    from pathlib import Path

    found: list[Path] = []
    for p in map(Path, paths):
        found += sorted(f for f in p.iterdir() if f.is_file() and not f.name.startswith(".") and f.suffix.lower() in EXTENSIONS) if p.is_dir() else [p]
    return layered(parse(f.read_text()) for f in found)


def remaining_seconds(due: Column, now: Column) -> Column:
    """Whole seconds to go, cut towards zero."""
    micros = F.unix_micros(due.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.call_function("div", micros, F.lit(1_000_000))


def target_priority(policy: Policy, remaining: Column) -> Column:
    """The priority asked for, null for none: the first window that a job is within; overdue ones the overdue priority, else (if it is escalated) that of the widest window."""
    windows = sorted(policy.windows, key=lambda w: (w[0], -w[1]))
    overdue = F.lit(policy.overdue)
    if policy.overdue is None:
        overdue = F.lit(windows[-1][1]) if windows and policy.escalate_overdue else F.lit(None)
    out = F.when(remaining <= 0, overdue.cast("int"))
    for within, priority in windows:
        out = out.when(remaining <= within, F.lit(priority))
    return out


def escalate(jobs: DataFrame, policy: Policy, now: Column) -> DataFrame:
    """``jobs`` with priorities raised, never lowered; finished jobs and those without due time stay."""
    if not policy.windows and policy.overdue is None:
        return jobs
    to = target_priority(policy, remaining_seconds(F.col("due_at"), now))
    return changed(jobs, outstanding() & F.col("due_at").isNotNull() & (to > F.col("priority")), now, priority=F.greatest("priority", to))


def escalate_by_table(jobs: DataFrame, windows: DataFrame, now: Column, overdue: int) -> DataFrame:
    """(id, target) by a table of windows (within_seconds, priority) of any length.

    A policy is configuration, written by people: its rows become one sorted array of the plan, in which every job finds its
    window by binary search.
    """
    least = windows.groupBy("within_seconds").agg(F.max("priority").alias("priority"))
    rows = sorted((r.within_seconds, r.priority) for r in least.collect())
    left = remaining_seconds(F.col("due_at"), now)
    to = F.when(left <= 0, F.lit(overdue))
    if rows:
        to = to.otherwise(F.get(F.lit([p for _, p in rows]).cast("array<int>"), _first_at_least(left, [w for w, _ in rows])))
    return jobs.filter(outstanding() & F.col("due_at").isNotNull()).select("id", to.cast("int").alias("target")).filter("target is not null")


def _first_at_least(value: Column, ascending: list[int]) -> Column:
    """The index of the first of ``ascending`` that is not below ``value``; their number if there is none."""
    size = 1 << len(ascending).bit_length()
    held = F.lit([*ascending, *[2**63 - 1] * (size - len(ascending))]).cast("array<bigint>")
    steps = F.lit([size >> i for i in range(1, size.bit_length())]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) < value, at + s).otherwise(at))
