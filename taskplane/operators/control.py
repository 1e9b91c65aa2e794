"""Retry rounds, placement on instances, emission policies and dead letters."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Backoff:
    """Milliseconds before the next attempt: base x factor^(attempt - 1), most ``most_ms``, less up to ``jitter`` of it."""

    base_ms: float = 0
    factor: float = 1.0
    most_ms: float = 60_000
    jitter: float = 0.0

    def delay(self, attempt: int, draw: float | None = None) -> float:
        wait = min(self.base_ms * self.factor ** max(0, attempt - 1), self.most_ms)
        return wait * (1 - min(1.0, max(0.0, self.jitter)) * (random.random() if draw is None else draw))


def selection(select: str | tuple) -> tuple:
    """A selection in its full form; names that need no more may stand alone."""
    full = (select,) if isinstance(select, str) else tuple(select)
    sizes = {"any": 1, "avoid_tried": 1, "different_instance": 1, "same_instance": 1, "same_attr": 2, "different_attr": 2, "where": 2}
    if not full or full[0] not in sizes:
        raise ValueError(f"unknown selection {select!r}")
    if len(full) != sizes[full[0]] or (full[0] == "where" and not callable(full[1])):
        raise ValueError(f"{full[0]!r} needs {'a predicate' if full[0] == 'where' else 'an attribute' if sizes[full[0]] > 1 else 'nothing more'}: {select!r}")
    return full


@dataclass
class Retry:
    """max_attempts counts the first one. ``select`` says where a retry goes unless the failure says otherwise: a name or, for
    ``same_attr``, ``different_attr`` and ``where``, a tuple of the name and the attribute or predicate. ``on_retry(task, error, attempt)`` is
    called beside the worker for each attempt that will be repeated."""

    max_attempts: int = 1
    select: str | tuple = "avoid_tried"
    backoff: Backoff = field(default_factory=Backoff)
    on_retry: Callable | None = None

    def __post_init__(self) -> None:
        selection(self.select)

    def again(self, attempt: int, fatal: bool) -> bool:
        return not fatal and attempt < self.max_attempts


@dataclass(frozen=True)
class Instance:
    """A worker's configuration: its place in the group and its attributes."""

    index: int
    attrs: Mapping[str, str] = field(default_factory=dict)


def eligible(select: tuple, last: Instance | None, tried: set[int], instances: list[Instance]) -> list[Instance]:
    """The instances that a selection allows. ``any`` and ``avoid_tried`` fall back to all; the others may allow none.

    Selections: ("any",), ("avoid_tried",), ("same_instance",), ("same_attr", key), ("different_attr", key), ("where", predicate).
    """
    kind = select[0]
    if kind == "any" or last is None and kind != "where":
        return list(instances)
    if kind == "avoid_tried" or kind == "different_instance":
        return [i for i in instances if i.index not in tried] or (list(instances) if kind == "avoid_tried" else [])
    if kind == "same_instance":
        return [i for i in instances if i.index == last.index]
    if kind == "same_attr":
        return [i for i in instances if i.attrs.get(select[1]) == last.attrs.get(select[1])]
    if kind == "different_attr":
        return [i for i in instances if i.attrs.get(select[1]) != last.attrs.get(select[1])]
    if kind == "where":
        return [i for i in instances if select[1](i.attrs)]
    raise ValueError(f"unknown selection {kind!r}")


def place(select: tuple, last: Instance | None, tried: set[int], instances: list[Instance], active: Mapping[int, int] | None = None) -> Instance | None:
    """The least active eligible instance, the first of equals; None where nothing is eligible."""
    allowed = eligible(select, last, tried, instances)
    return min(allowed, key=lambda i: ((active or {}).get(i.index, 0), i.index), default=None)


def retry_rounds(df: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], retry: Retry) -> tuple[DataFrame, DataFrame]:
    """(succeeded, dead): runs ``attempt(rows, n)`` on what failed so far, at most max_attempts times.

    ``attempt`` returns its rows with ``ok`` boolean, ``fatal`` boolean and ``error`` string. Each round is written once, so that side
    effects and random failures happen once a row and attempt. Both results have ``attempts``; dead ones ``error`` too.
    """
    from ..shared import written

    done, dead, now, n = [], [], df, 1
    while True:
        got = written(attempt(now, n).withColumn("attempts", F.lit(n)), f"attempt-{n}")
        done.append(got.where("ok").drop("ok", "fatal", "error"))
        failed = got.where("not coalesce(ok, false)")
        final = F.coalesce(F.col("fatal"), F.lit(False)) if n < retry.max_attempts else F.lit(True)
        dead.append(failed.where(final).drop("ok", "fatal"))
        now = failed.where(~final).select(*df.columns)
        if n >= retry.max_attempts or now.isEmpty():
            break
        n += 1
    join = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(join(frames[1:]))
    return join(done), join(dead)


def attempts_needed(succeeds_at: Column, retry: Retry, fatal: Column | None = None) -> tuple[Column, Column]:
    """(attempts made, succeeded) where an expression tells at which attempt a row succeeds (null: never): no rounds needed."""
    fatal = F.lit(False) if fatal is None else fatal
    most = F.lit(retry.max_attempts)
    ok = F.coalesce(~fatal & (succeeds_at <= most), F.lit(False))
    return F.when(fatal, F.lit(1)).when(ok, succeeds_at).otherwise(most).cast("int"), ok


def violations(emitted: DataFrame, allowed: Mapping[str, list[str]]) -> DataFrame:
    """Emissions (from_type, to_type) that a policy forbids; types without a policy may emit anything."""
    spark: SparkSession = emitted.sparkSession
    held = emitted.where(F.col("from_type").isin(*allowed)) if allowed else emitted.limit(0)
    edges = spark.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], "from_type string, to_type string")
    return held.join(F.broadcast(edges), ["from_type", "to_type"], "left_anti")  # as many rows as the policies have edges


def dead_letters(failed: DataFrame, task_type: str, payload: Column) -> DataFrame:
    """task, task_type, error, attempts, instance."""
    instance = F.col("instance") if "instance" in failed.columns else F.lit(None).cast("string")
    return failed.select(payload.alias("task"), F.lit(task_type).alias("task_type"), "error", "attempts", instance.alias("instance"))
