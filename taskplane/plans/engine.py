"""The engine: task types are DataFrames, workers turn one into others, routers aggregate, checkpoints make runs resumable.

A frame worker maps a DataFrame to a DataFrame for each emitted type and stays inside Catalyst: chains of frame workers are one
plan, so that columns are pruned and filters pushed down through them, and their rows are counted by the jobs that read them anyway. A frame is
written only where it is read more than once or must not be computed again: by row workers, at checkpoints, in cycles, and where several
types are made from a derived one. A row worker is a callback
``process(task, ctx)``; its rows run in Arrow batches on the executors, with retries, placement, timeouts and policies. What a row
worker emits is one table for all types, written once, so that user code runs once for each row and attempt.
"""

from __future__ import annotations

import base64
import json
import pickle
import signal
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..operators import control, provenance, relational
from ..operators.control import Backoff, Instance, Retry
from ..operators.reducers import Fold, Reducer
from ..shared import written
from .graph import EmitNotAllowed, TaskGraph
from .store import Store

META = ["_source", "_cov"]
_OUT = "kind string, type string, payload string, source string, cov array<bigint>, marker string, mkey string, claim int, row long, attempt int, instance string, error string, last int, tried array<int>, hint string, final boolean, delay double"
_HELD = ["kind", "type", "payload", "source", "cov", "marker", "mkey", "claim"]


class Fatal(Exception):
    """Fails a task at once."""


class Retryable(Exception):
    """Retries a task on an instance that ``select`` allows (see ``control.eligible``)."""

    def __init__(self, select: tuple, message: str = ""):
        super().__init__(message)
        self.select = select


def same_instance(message: str = "") -> Retryable:
    return Retryable(("same_instance",), message)


def different_instance(message: str = "") -> Retryable:
    return Retryable(("avoid_tried",), message)


def different_attr(key: str, message: str = "") -> Retryable:
    return Retryable(("different_attr", key), message)


def same_attr(key: str, message: str = "") -> Retryable:
    return Retryable(("same_attr", key), message)


def instance_where(predicate: Callable[[dict], bool], message: str = "") -> Retryable:
    return Retryable(("where", predicate), message)


class Worker:
    """Override process, and on_start and on_stop for each task's set-up and end."""

    def on_start(self) -> None: ...

    def on_stop(self) -> None: ...

    def process(self, task: Any, ctx: Any) -> None:
        raise NotImplementedError("a worker must define process(task, ctx)")


class Task(dict):
    """A row with its columns as attributes."""

    __getattr__ = dict.__getitem__


class Context:
    """What a row worker may do. Emissions are kept until the row ends and are dropped if it fails."""

    def __init__(self, source_type: str, policy: set[str] | None, cov: list[int], source: str | None, instance: Instance, attempt: int, seen: dict | None = None, cancelled: Callable[[], bool] = lambda: False):
        self.type, self.policy, self.cov, self.source, self.instance, self.attempt, self.out = source_type, policy, cov, source, instance, attempt, []
        self._seen, self._cancelled, self._claim, self._claims = {} if seen is None else seen, cancelled, None, 0

    def _add(self, kind: str, type_: str, task: Any, cov: list[int], claim: tuple | None = None) -> None:
        if kind == "emit" and self.policy is not None and type_ not in self.policy:
            raise EmitNotAllowed(self.type, type_, self.policy)
        body = task if isinstance(task, dict) else getattr(task, "__dict__", {"value": task})
        self.out.append((kind, type_, json.dumps(body, default=str), self.source, cov, *(claim or self._claim or (None, None, None))))

    def _new_claim(self, marker: str, key: Any) -> tuple:
        self._claims += 1
        return marker, str(key), self._claims

    def emit(self, type_: str, task: Any = None, **fields: Any) -> None:
        self._add("emit", type_, {**(task or {}), **fields} if isinstance(task, (dict, type(None))) else task, self.cov)

    def emit_keyed(self, ordinal: int, type_: str, task: Any = None, **fields: Any) -> None:
        self._add("emit", type_, {**(task or {}), **fields}, [int(ordinal)])

    def emit_first(self, marker: str, key: Any, type_: str, task: Any = None, **fields: Any) -> None:
        """Emits only if the key is the first of its marker in the whole run; the engine decides between tasks."""
        self._add("emit", type_, {**(task or {}), **fields}, self.cov, self._new_claim(marker, key))

    def first_seen(self, marker: str, key: Any) -> bool:
        """Whether the key is new to its marker, as far as this task can know. What the row emits or routes after a True hangs on it
        until its next question: the engine keeps it only if no other task had the key first."""
        keys = self._seen.setdefault(marker, set())
        new = str(key) not in keys
        keys.add(str(key))
        claim = self._new_claim(marker, key)
        self.out.append(("claim", None, None, self.source, self.cov, *claim))
        self._claim = claim if new else None
        return new

    @property
    def is_cancelled(self) -> bool:
        """Whether the run is being shut down: long work should end early. Looked up in the shared folder, at most five times a second."""
        return self._cancelled()

    def route(self, router: str, value: Any = None, **fields: Any) -> None:
        self._add("route", router, {**(value if isinstance(value, dict) else {} if value is None else {"value": value}), **fields}, self.cov)


class _Flag:
    """A file in the shared folder that says that a run is being shut down."""

    def __init__(self, path: str):
        self.path, self._asked, self._set = path, 0.0, False

    def __call__(self) -> bool:
        if not self._set and time.monotonic() - self._asked > 0.2:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.path)
            self._set, self._asked = store.get_file_info(path).type != fs.FileType.NotFound, time.monotonic()
        return self._set


class _Counted:
    """How many rows a frame has: those of a table are counted when asked for, those of a derived frame by the job that reads it."""

    def __init__(self, frame: DataFrame, table: bool):
        self.plain, self._observation = frame, None if table else Observation()
        self.frame = frame if table else frame.observe(self._observation, F.count(F.lit(1)).alias("n"))

    def settle(self) -> None:
        """Called before the engine reads the frame: what the worker itself read, perhaps in part, does not count."""
        if self._observation and self._read() is not None:
            self._observation = None

    def _read(self) -> int | None:
        """None: no job has read the frame; -1: one has, but the planner saw that it is empty or left it out."""
        self.plain.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        row = self._observation._jo.getRowOrEmpty()
        return (int(row.get().getLong(0)) if row.get().length() else -1) if row.isDefined() else None

    def value(self) -> int:
        n = self._read() if self._observation else None
        return self.plain.count() if n is None or n < 0 else n


@dataclass
class _RowWorker:
    make: Callable[[], Any]
    attrs: dict[str, str] = field(default_factory=dict)
    label: str | None = None
    timeout_ms: int | None = None
    retry: Retry | None = None
    requires: tuple[str, ...] = ()
    concurrency: int | None = None


@dataclass
class _Checkpoint:
    key: str
    key_only: bool = False


class Report:
    """Counters, router outputs and failures of a run."""

    def __init__(self) -> None:
        self.processed = self.retried = self.failed = self.skipped = self.unfinished = 0
        self.interrupted = False
        self.frames: dict[str, DataFrame] = {}
        self.outputs: dict[str, Any] = {}
        self.uniques: dict[str, int] = {}
        self.collected: dict[str, list[DataFrame]] = {}
        self.failures: list[DataFrame] = []
        self.by_type: dict[str, int] = {}
        self._store: Store | None = None
        self._reducers: dict[str, Reducer] = {}
        self._counts: list[tuple[str, _Counted]] = []

    def output(self, router: str) -> Any:
        """A router's value. That of a keyed router is read to the driver here, as a dict; ``frame`` has it as a table."""
        if router not in self.outputs and router in self.frames:
            self.outputs[router] = self._reducers[router].finished(self.frames[router].collect())
        return self.outputs.get(router)

    def frame(self, router: str) -> DataFrame:
        """The result of a keyed router, whatever its size."""
        return self.frames[router]

    def unique(self, marker: str) -> int:
        return self.uniques.get(marker, 0)

    def stored(self, name: str) -> DataFrame:
        return self._store.payloads(name)

    def dead_letter_frame(self) -> DataFrame | None:
        """task, task_type, error, attempts and instance of the rows that failed; None if none did."""
        return _union(self.failures) if self.failures else None

    def dead_letters(self) -> list[dict]:
        """The same in the driver."""
        return [r.asDict() for f in self.failures for r in f.collect()]

    def _settle(self) -> None:
        """Adds what the jobs have counted."""
        for task, counted in self._counts:
            n = counted.value()
            self.processed += n
            self.by_type[task] = self.by_type.get(task, 0) + n
        self._counts.clear()

    def state(self, waiting: Iterable[str] = (), running: str | None = None) -> dict[str, Any]:
        return {"processed": self.processed, "failed": self.failed, "retried": self.retried, "skipped": self.skipped, "waiting": sorted(waiting), "running": running}

    def __repr__(self) -> str:
        return f"Report(processed={self.processed}, retried={self.retried}, failed={self.failed}, skipped={self.skipped}, interrupted={self.interrupted}, unfinished={self.unfinished})"


class Engine:
    """Declare types, workers, routers and seeds, then ``run``. Declarations return the engine, so that they chain."""

    def __init__(self, spark: SparkSession, retry: Retry | None = None, store: Store | None = None, dead_letter: Callable[[list[dict]], None] | None = None, timeout_ms: int | None = None, concurrency: int | None = None, resources: dict[str, int] | None = None, monitor: Any = None, dataset: Any = None, monitor_ms: int = 200):
        self.spark, self.retry_policy, self.store, self.dead_letter, self.timeout_ms, self.concurrency, self.monitor, self.monitor_ms = spark, retry or Retry(), store, dead_letter, timeout_ms, concurrency, monitor, monitor_ms
        self._dataset, self._live = None, None
        self.graph, self.resources = TaskGraph(), dict(resources or {})
        self.schemas: dict[str, T.StructType] = {}
        self.frames: dict[str, Callable[[DataFrame], Any]] = {}
        self.rows: dict[str, list[_RowWorker]] = {}
        self.routers: dict[str, Any] = {}
        self.emitters: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {}
        self.checkpoints: dict[str, _Checkpoint] = {}
        self.collects: set[str] = set()
        self.sinks: dict[str, Callable[[DataFrame], None]] = {}
        self.seeds: list[tuple[str, DataFrame, str | None]] = []
        self.boundaries: set[str] = set()
        self._stop, self._tag = False, f"taskplane-{uuid.uuid4().hex}"
        self._flag = _Flag(shared.new_path(spark, "shutdown"))
        if dataset is not None and store is None:
            self.dataset(dataset)
        else:
            self._dataset = dataset

    # declarations ------------------------------------------------------------------------------------------------
    def type(self, name: str, schema: str | T.StructType) -> Engine:
        """The columns of a type that row workers emit or route."""
        self.schemas[name] = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return self

    def worker(self, task: str, emits: Iterable[str] = (), rows: bool = False, **options: Any) -> Callable:
        """Decorator. A function of a DataFrame, or with ``rows`` a function (task, ctx) or a Worker class."""

        def register(target: Any) -> Any:
            self.graph.declare(task, emits)
            if rows or isinstance(target, type):
                self.register(task, target, **options)
            else:
                self.frames[task] = target
            return target

        return register

    def register(self, task: str, worker: Any, emits: Iterable[str] = (), **options: Any) -> Engine:
        """One more instance of a row worker: a Worker class or object, or a function (task, ctx)."""
        self.graph.declare(task, emits)
        for name in options.get("requires", ()):
            if name not in self.resources:
                raise ValueError(f"resource {name!r} is not declared")
        group = self.rows.setdefault(task, [])
        if len(group) >= 64:
            raise ValueError(f"{task} has 64 instances already")
        if isinstance(worker, type):
            make = worker
        elif hasattr(worker, "process"):
            make = lambda worker=worker: worker
        else:
            make = lambda f=worker: type("FunctionWorker", (Worker,), {"process": lambda self, t, c: f(t, c)})()
        group.append(_RowWorker(make, **options))
        return self

    def router(self, name: str, reducer: Reducer | Fold) -> Engine:
        """An aggregation of what is routed to it (or emitted with its name); its value is ``Report.output(name)``."""
        self.routers[name] = reducer
        return self

    def batcher(self, name: str, emits: Iterable[str], flush: Callable[[DataFrame], dict[str, DataFrame]]) -> Engine:
        """A router that emits: at each quiet point ``flush`` gets what came since the last one."""
        self.graph.declare(name, emits)
        self.emitters[name] = flush
        return self

    def chunker(self, source: str, piece: str, rows: int, batch: list[str], order: list[str]) -> Engine:
        from ..operators import batching

        self.frames[source] = lambda df: {piece: batching.chunk(df, rows, batch, order)}
        self.graph.declare(source, [piece])
        return self

    def row_batch(self, name: str, group: str, rows: int, order: list[str], size: str | None = None, gather: str | None = None) -> Engine:
        """Groups what is routed to ``name`` until a group holds ``rows`` rows: in the order of ``order``, ``size`` being a column with
        the rows that each one stands for (None: each is one). Emits the same rows with ``group_id``; with ``gather``, one row a group
        (group_id, n_rows and an array of that name). Either has the union of its group's coverage, so that a checkpoint of groups
        covers all rows behind them. Only (place, size) go through the sequential fold; the rows join its result."""
        from ..operators import batching

        def flush(df: DataFrame) -> dict[str, DataFrame]:
            placed = relational.numbered(df, order, "_n")
            if size is None:
                grouped = placed.withColumn("group_id", F.floor(F.col("_n") / max(1, rows)).cast("long"))
            else:
                groups = batching.row_groups(placed.select("_n", F.col(size).cast("long").alias("_size")), [], ["_n"], "_size", rows)
                grouped = placed.join(groups.drop("_size"), "_n")
            grouped = written(grouped, f"groups-{name}")
            cover = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_cov")))).alias("_cov")
            held = F.lit(1) if size is None else F.col(size)
            if gather:
                items = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*_payload(df)).alias("row")))), lambda x: x["row"]).alias(gather)
                return {group: grouped.groupBy("group_id").agg(F.sum(held).alias("n_rows"), items, F.first("_source", ignorenulls=True).alias("_source"), cover)}
            covers = grouped.groupBy("group_id").agg(cover)
            return {group: grouped.drop("_n", "_cov").join(covers, "group_id")}

        return self.batcher(name, [group], flush)

    def stream_router(self, name: str, emits: Iterable[str], make: Callable[[], Any], shard: str | None = None, order: list[str] | None = None) -> Engine:
        """A router in Python that emits: an object with ``route(task, ctx)`` and ``flush(ctx)``, one for each value of the column ``shard``
        (None: one in all, so that its rows pass one task as a stream), in the order of ``order``. What it emits covers the
        rows that came since its last emission."""

        def flush(df: DataFrame) -> dict[str, DataFrame]:
            columns, run = _payload(df), _router_runner(name, make, shard, self.graph.policy.get(name), _payload(df))
            dealt = df.repartition(shard).sortWithinPartitions(shard, *(order or [])) if shard else df.coalesce(1).sortWithinPartitions(*order) if order else df.coalesce(1)
            got = written(dealt.select(*columns, *META).mapInPandas(run, _OUT), f"out-{name}")
            return {t: got.where(F.col("type") == t).select(F.from_json("payload", self.schemas[t]).alias("p"), F.col("source").alias("_source"), F.col("cov").alias("_cov")).select("p.*", *META) for t in emits}

        return self.batcher(name, emits, flush)

    def dedup(self, task: str, keys: list[str], out: str, order: list[str] | None = None) -> Engine:
        """Passes on the first row of each key as ``out``: the least by ``order``, else any."""
        self.graph.declare(task, [out])
        self.frames[task] = lambda df: {out: relational.first_seen(df, keys, order) if order else df.dropDuplicates(keys)}
        return self

    def read(self, task: str, target: str, registry: Any = None, **options: Any) -> Engine:
        """Seeds with the rows of a target, opened by the sources' registry."""
        from ..sources import registry as sources

        return self.seed(task, sources.read(self.spark, target, registry, **options))

    def sink(self, task: str, target: str, registry: Any = None, **options: Any) -> Engine:
        """Writes what is emitted as ``task`` to a target, by the sinks' registry. Each time that some arrives it is one write: give a
        mode or a target that appends where that happens more than once."""
        from ..sources import registry as sources

        self.sinks[task] = lambda df: sources.write(df, target, registry, **options)
        return self

    def dataset(self, dataset: Any) -> Engine:
        """Checkpoints are kept in the dataset and resumed from it; a store that was given before is not used."""
        self._dataset, self.store = dataset, dataset.store()
        return self

    def checkpoint(self, task: str, key: str, key_only: bool = False) -> Engine:
        self.checkpoints[task] = _Checkpoint(key, key_only)
        return self

    def emit_policy(self, task: str, allows: Iterable[str]) -> Engine:
        self.graph.allow(task, allows)
        return self

    def resource(self, name: str, permits: int) -> Engine:
        self.resources[name] = max(1, permits)
        return self

    def collect(self, task: str) -> Engine:
        if task in self.frames or task in self.rows:
            raise ValueError(f"collected type is terminal and cannot also have a worker: {task}")
        self.collects.add(task)
        return self

    def seed(self, task: str, rows: DataFrame | list, schema: str | None = None) -> Engine:
        self.seeds.append((task, rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema or self.schemas[task]), None))
        return self

    def source(self, task: str, source_id: str, rows: DataFrame, ordinal: str) -> Engine:
        """Seeds whose rows have an ordinal: what checkpoints cover is not read again."""
        self.seeds.append((task, rows.withColumns({"_source": F.lit(source_id), "_cov": F.array(F.col(ordinal).cast("bigint"))}), source_id))
        return self

    def select_tasks(self, *names: str) -> Engine:
        """Stop at these checkpoints: they are stored, their consumers do not run."""
        for name in names:
            if name not in self.checkpoints:
                raise ValueError(f"unknown task {name!r} (available: {sorted(self.checkpoints)})")
        self.boundaries = set(names)
        return self

    def shutdown(self, grace_s: float | None = None) -> None:
        """Ends a run after the node that is running; what is left counts as unfinished. Row workers see it as ``ctx.is_cancelled`` and may
        end early. With a grace period the running jobs are cancelled when it is over."""
        self._stop = True
        shared.touch(self.spark, self._flag.path)
        if grace_s is not None:
            timer = threading.Timer(grace_s, lambda: self.spark.sparkContext.cancelJobsWithTag(self._tag))
            timer.daemon = True
            timer.start()

    # running -----------------------------------------------------------------------------------------------------
    def tasks(self) -> DataFrame:
        """(name, worker, n_stored, n_done) of the checkpoints."""
        rows = [(n, n in self.frames or n in self.rows) for n in self.checkpoints]
        names = self.spark.createDataFrame(rows, "name string, has_worker boolean")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        if not self.store:
            return names.select("name", "has_worker", F.lit(0).cast("long").alias("n_stored"), F.lit(0).cast("long").alias("n_done"))
        return names.join(self.store.statuses(), "name", "left").select("name", "has_worker", zero("n_stored"), zero("n_done"))

    def run(self, catch_ctrl_c: bool = False, grace_s: float = 30) -> Report:
        """Runs to the end. With catch_ctrl_c the first Ctrl-C shuts down with the grace period."""
        self.spark.sparkContext.addJobTag(self._tag)
        old = signal.signal(signal.SIGINT, lambda *_: self.shutdown(grace_s)) if catch_ctrl_c else None
        report, over = Report(), threading.Event()
        self._waiting: dict[str, list[tuple[DataFrame, bool]]] = {}
        self._running: str | None = None

        def watch() -> None:
            while not over.wait(self.monitor_ms / 1000):
                self.monitor.sample(report.state(list(self._waiting), self._running))

        if self.monitor:
            threading.Thread(target=watch, name="taskplane-monitor", daemon=True).start()
        try:
            self._run(report)
            return report
        finally:
            over.set()
            if self.monitor:
                self.monitor.sample(report.state())
            self.spark.sparkContext.removeJobTag(self._tag)
            if self._stop:
                shared.delete(self.spark, self._flag.path)
            if catch_ctrl_c:
                signal.signal(signal.SIGINT, old)

    def _run(self, report: Report) -> None:
        if self.checkpoints and not self.store:
            self.store = Store(self.spark)
        report._store = self.store
        waiting = self._waiting
        routed: dict[str, list[DataFrame]] = {}
        unflushed: dict[str, list[DataFrame]] = {}
        seen: dict[str, DataFrame] = {}
        for task, df, _ in self._prepared_seeds():
            self._deliver(task, _with_meta(df), waiting, routed, unflushed, report, table=True)
        try:
            while waiting or unflushed:
                if self._stop:
                    report.interrupted = True
                    break
                if not waiting:  # quiet: routers flush, which may start new work
                    name, frames = unflushed.popitem()
                    for t, out in self.emitters[name](_with_meta(_union(frames))).items():
                        self._deliver(t, _with_meta(out), waiting, routed, unflushed, report)
                    continue
                self._running = task = self.graph.order(waiting)[0]
                frames = waiting[task]
                self._one(task, frames, waiting, routed, unflushed, seen, report)
            self._finish(routed, seen, report)
        except Exception:
            if not self._stop:
                raise
            report.interrupted = True  # cancelled after the grace period: the rows of the node and what waits are unfinished
        if report.interrupted:
            report.unfinished = sum(f.count() for fs in waiting.values() for f, _ in fs)
        report._settle()
        if self.store and not report.failed and not report.interrupted:
            for task, df, source in self.seeds:
                if source:
                    self.store.record_extent(source, df.select(F.explode("_cov").alias("ord")))
        if self.dead_letter and report.failures:
            for frame in report.failures:
                for r in frame.toLocalIterator():
                    self.dead_letter(r.asDict())

    def _finish(self, routed: dict, seen: dict, report: Report) -> None:
        """Router results: keyed ones are tables, others values."""
        for name, reducer in self.routers.items():
            frames = routed.get(name)
            df = _union(frames) if frames else self.spark.createDataFrame([], self.schemas.get(name, T.StructType([T.StructField("value", T.StringType())])))
            if isinstance(reducer, Reducer) and reducer.keys:
                keyed = all(k in df.columns for k in reducer.keys)
                report.frames[name], report._reducers[name] = written(reducer.apply(df) if keyed else df, f"routed-{name}"), reducer
            else:
                report.outputs[name] = reducer.value(df)
        for marker, keys in seen.items():
            report.uniques[marker] = keys.count()

    def _prepared_seeds(self) -> list[tuple[str, DataFrame, str | None]]:
        """Seeds without what is covered, and stored items whose consumer has not run."""
        out = []
        if not self.checkpoints:
            return [(t, df, s) for t, df, s in self.seeds]
        covered, extents = self.store.covered(), self.store.extents()
        finished = {r["source"] for r in provenance.finished_sources(extents, covered).collect()}
        for task, df, source in self.seeds:
            if source in finished:
                continue
            if source:
                ords = covered.where(F.col("source") == source).select(F.col("ord"))
                df = df.join(ords, df["_cov"][0] == ords["ord"], "left_anti")
            out.append((task, df, source))
        for name, c in self.checkpoints.items():
            if not c.key_only and name not in self.boundaries and self._has_worker(name) and self.store.index().where((F.col("name") == name) & (F.col("status") == "stored")).limit(1).count():
                out.append((name, self.store.stored_items(name).withColumn("_again", F.lit(True)), None))
        return out

    def _has_worker(self, task: str) -> bool:
        return task in self.frames or task in self.rows or task in self.sinks

    def _deliver(self, task: str, df: DataFrame, waiting: dict, routed: dict, unflushed: dict, report: Report, table: bool = False) -> None:
        if task in self.routers:
            routed.setdefault(task, []).append(df.drop(*META))
        elif task in self.emitters:
            unflushed.setdefault(task, []).append(df)
        elif task in self.collects:
            df = written(df.drop(*META), f"collected-{task}")
            report.collected.setdefault(task, []).append(df)
            if self._live:
                self._live(task, df)
        else:
            waiting.setdefault(task, []).append((df, table))

    def _stays_lazy(self, task: str, table: bool) -> bool:
        """Whether a type's rows need not be written: read by one frame worker, once, and not in a cycle."""
        once = table or len(self.graph.edges.get(task, [])) < 2
        return once and (task in self.frames or task in self.sinks) and task not in self.checkpoints and not any(task in c for c in self.graph.cycles())

    def _one(self, task: str, frames: list[tuple[DataFrame, bool]], waiting: dict, routed: dict, unflushed: dict, seen: dict, report: Report) -> None:
        frame, table = _with_meta(_union([f for f, _ in frames])), all(t for _, t in frames)
        if self._stays_lazy(task, table):
            counted = _Counted(frame, table)
            out = self._applied(task, counted.frame)
            counted.settle() if task in self.frames else None
            del waiting[task]
            report._counts.append((task, counted))
            for t, df in out.items():
                self._deliver(t, _with_meta(df), waiting, routed, unflushed, report)
            return
        frame = frame if table and task not in self.checkpoints else written(frame, f"task-{task}")
        waiting[task] = [(frame, True)]
        has_worker = self._has_worker(task)
        if task in self.checkpoints:
            frame, has_worker = self._admitted(task, frame, has_worker, report)
        n = frame.count()
        report.by_type[task] = report.by_type.get(task, 0) + n
        out: dict[str, DataFrame] = {}
        if task in self.checkpoints and not has_worker:
            report.processed += n
        elif n and not has_worker:
            report.failed += n
            report.failures.append(control.dead_letters(frame.withColumns({"error": F.lit(f"no worker registered for {task}"), "attempts": F.lit(1)}), task, F.to_json(F.struct(*_payload(frame)))))
        elif n and task in self.rows:
            del waiting[task]
            try:
                self._rows(task, frame.drop("_key", "_again"), waiting, routed, unflushed, seen, report)
            except Exception:
                waiting.setdefault(task, []).append((frame, True))
                raise
            if task in self.checkpoints:
                self.store.consume(task, frame.select("_key"))
            return
        elif n:
            out = self._applied(task, frame.drop("_key", "_again"))
            report.processed += n
        del waiting[task]
        for t, df in out.items():
            self._deliver(t, _with_meta(df), waiting, routed, unflushed, report)
        if n and has_worker and task in self.checkpoints:
            self.store.consume(task, frame.select("_key"))

    def _applied(self, task: str, frame: DataFrame) -> dict[str, DataFrame]:
        """What a frame worker or a sink makes of its rows."""
        if task in self.sinks:
            self.sinks[task](frame.drop(*META))
            return {}
        got = self.frames[task](frame)
        got = got if isinstance(got, dict) else {self.graph.edges[task][0]: got} if got is not None else {}
        for t in got:
            self.graph.check(task, t)
        return got

    def _admitted(self, task: str, frame: DataFrame, has_worker: bool, report: Report) -> tuple[DataFrame, bool]:
        c = self.checkpoints[task]
        if "_again" not in frame.columns:
            frame = frame.withColumn("_again", F.lit(None).cast("boolean"))
        if "_key" in frame.columns:
            frame = frame.withColumn("_key", F.coalesce("_key", F.col(c.key).cast("string")))
        else:
            frame = frame.withColumn("_key", F.col(c.key).cast("string"))
        old, new = frame.where("_again"), frame.where("coalesce(not _again, true)")
        arrivals = new.select(F.lit(task).alias("name"), F.col("_key").alias("key"), F.monotonically_increasing_id().alias("_n"), F.struct(*new.columns).alias("_task"))
        fresh, skipped = provenance.admit(written(arrivals, f"arrivals-{task}"), self.store.index(), ["_n"])
        fresh = written(fresh.select("_task.*"), f"fresh-{task}")
        report.skipped += int(skipped.agg(F.coalesce(F.sum("n_skipped"), F.lit(0))).first()[0])
        self.store.commit(task, fresh, None if c.key_only else [f.name for f in fresh.schema.fields if f.name not in ("_key", "_again", *META)])
        if self._dataset is not None and not c.key_only and self.store is not getattr(self._dataset, "_store", None):
            self._dataset.put_items(task, fresh.drop("_again"))
        if task in self.boundaries:
            return fresh, False
        return fresh.unionByName(old, allowMissingColumns=True), has_worker

    def _rows(self, task: str, frame: DataFrame, waiting: dict, routed: dict, unflushed: dict, seen: dict, report: Report) -> None:
        """Row workers in rounds: all rows, then those that failed and may be tried again."""
        group = self.rows[task]
        instances = [Instance(i, w.attrs) for i, w in enumerate(group)]
        permits = min([self.resources[r] for w in group for r in w.requires] + [w.concurrency for w in group if w.concurrency] + ([self.concurrency] if self.concurrency else []), default=None)
        base = written(frame.withColumn("_row", F.monotonically_increasing_id()), f"rows-{task}")
        state = base.withColumns({"_last": F.lit(None).cast("int"), "_tried": F.array().cast("array<int>"), "_hint": F.lit(None).cast("string")})
        run, attempt, outputs = _runner(task, group, instances, self.retry_policy, self.graph.policy.get(task), self.timeout_ms, _payload(base), self._flag), 1, []
        while True:
            if permits:
                state = state.coalesce(permits)
            columns = [*_payload(base), *META, "_row", "_last", "_tried", "_hint"]
            got = written(state.select(*columns).withColumn("_attempt", F.lit(attempt)).mapInPandas(run, _OUT), f"out-{task}-{attempt}")
            outputs.append(got.where("kind in ('emit', 'route', 'claim')"))
            counts = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
            report.processed += counts.get("done", 0)
            failed = got.where("kind = 'fail'")
            dead = failed.where("final")
            n_dead = dead.count()
            if n_dead:
                report.failed += n_dead
                body = base.select(F.to_json(F.struct(*_payload(base))).alias("task"), F.col("_row").alias("row"))
                report.failures.append(dead.join(body, "row").select("task", F.lit(task).alias("task_type"), "error", F.col("attempt").alias("attempts"), "instance"))
            n_again = counts.get("fail", 0) - n_dead
            if not n_again:
                break
            report.retried += n_again
            again = failed.where("not final")
            delay = again.agg(F.max("delay")).first()[0]
            again = again.select(F.col("row").alias("_row"), F.col("last").alias("_last"), F.col("tried").alias("_tried"), F.col("hint").alias("_hint"))
            state = base.join(again, "_row")
            time.sleep((delay or 0) / 1000)
            attempt += 1
        out = _union(outputs)
        for marker in [r["marker"] for r in out.where("marker is not null").select("marker").distinct().collect()]:
            mine = out.where(F.col("marker") == marker)
            claims = mine.groupBy("mkey", "row", "claim").agg(F.lit(1).alias("one")).drop("one")
            first = claims.groupBy("mkey").agg(F.min(F.struct("row", "claim")).alias("f"))
            if marker in seen:
                first = first.join(seen[marker], "mkey", "left_anti")
            first = written(first.select("mkey", "f.row", "f.claim"), f"first-{marker}")
            seen[marker] = _union([*([seen[marker]] if marker in seen else []), first.select("mkey")])
            report.skipped += claims.count() - first.count()
            self._typed(mine.where("kind <> 'claim'").join(first, ["mkey", "row", "claim"], "left_semi"), waiting, routed, unflushed, report)
        self._typed(out.where("marker is null"), waiting, routed, unflushed, report)

    def _typed(self, out: DataFrame, waiting: dict, routed: dict, unflushed: dict, report: Report) -> None:
        for name in [r["type"] for r in out.select("type").distinct().collect()]:
            if name not in self.schemas:
                raise ValueError(f"the columns of {name} are not declared: use engine.type({name!r}, schema)")
            rows = out.where(F.col("type") == name).select(F.from_json("payload", self.schemas[name]).alias("p"), F.col("source").alias("_source"), F.col("cov").alias("_cov"))
            self._deliver(name, rows.select("p.*", *META), waiting, routed, unflushed, report, table=True)


def _payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*META, "_row", "_key", "_again", "_last", "_tried", "_hint", "_attempt")]


def _with_meta(df: DataFrame) -> DataFrame:
    if "_source" not in df.columns:
        df = df.withColumn("_source", F.lit(None).cast("string"))
    return df if "_cov" in df.columns else df.withColumn("_cov", F.array().cast("array<bigint>"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _runner(task: str, group: list[_RowWorker], instances: list[Instance], default: Retry, policy: set[str] | None, timeout_ms: int | None, payload: list[str], flag: _Flag) -> Callable:
    names = [f.split()[0] for f in _OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started: dict[int, Any] = {}
        active: dict[int, int] = {}
        seen: dict[str, set] = {}

        def on_alarm(*_: Any) -> None:
            raise TimeoutError("timed out")

        old = signal.signal(signal.SIGALRM, on_alarm)
        try:
            for pdf in batches:
                out: list[tuple] = []
                for row in pdf.to_dict("records"):
                    tried, attempt = [int(x) for x in row["_tried"]], int(row["_attempt"])
                    last = None if row["_last"] is None or row["_last"] != row["_last"] else instances[int(row["_last"])]
                    select = pickle.loads(base64.b64decode(row["_hint"])) if isinstance(row["_hint"], str) else ("any",)
                    chosen = control.place(select if last else ("any",), last, set(tried), instances, active)
                    empty = (None,) * len(_HELD[1:])
                    if chosen is None:
                        out.append(("fail", *empty, row["_row"], attempt, None, f"no instance of {task} satisfies {select}", None, tried, None, True, 0.0))
                        continue
                    active[chosen.index] = active.get(chosen.index, 0) + 1
                    w = group[chosen.index]
                    retry, label = w.retry or default, w.label or f"{task}#{chosen.index}"
                    if chosen.index not in started:
                        started[chosen.index] = w.make()
                        getattr(started[chosen.index], "on_start", lambda: None)()
                    cov = [int(x) for x in row["_cov"]] if row["_cov"] is not None else []
                    ctx = Context(task, policy, cov, row["_source"], chosen, attempt, seen, flag)
                    limit = (w.timeout_ms or timeout_ms or 0) / 1000
                    tried = sorted({*tried, chosen.index})
                    body = Task({c: row[c] for c in payload})
                    try:
                        if limit:
                            signal.setitimer(signal.ITIMER_REAL, limit)
                        started[chosen.index].process(body, ctx)
                        signal.setitimer(signal.ITIMER_REAL, 0)
                        out += [(*o, row["_row"], attempt, label, None, None, None, None, None, None) for o in ctx.out]
                        out.append(("done", *empty, row["_row"], attempt, label, None, None, None, None, None, None))
                    except Exception as e:
                        signal.setitimer(signal.ITIMER_REAL, 0)
                        final = not retry.again(attempt, isinstance(e, (Fatal, EmitNotAllowed)))
                        for o in ctx.out:  # what a failed row saw first is free again for others
                            if o[0] == "claim":
                                seen[o[5]].discard(o[6])
                        hint = base64.b64encode(cloudpickle.dumps(e.select if isinstance(e, Retryable) else control.selection(retry.select))).decode()
                        if not final and retry.on_retry:
                            retry.on_retry(body, str(e), attempt)
                        out.append(("fail", *empty, row["_row"], attempt, label, str(e) or type(e).__name__, chosen.index, tried, hint, final, float(retry.backoff.delay(attempt))))
                yield pd.DataFrame(out, columns=names)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, old)
            for w in started.values():
                getattr(w, "on_stop", lambda: None)()

    return run


def _router_runner(name: str, make: Callable[[], Any], shard: str | None, policy: set[str] | None, payload: list[str]) -> Callable:
    names = [f.split()[0] for f in _OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router, key, cov, source = None, object(), set(), None
        rest = (None,) * (len(names) - len(_HELD))

        def call(f: Callable, *args: Any) -> list[tuple]:
            ctx = Context(name, policy, sorted(cov), source, Instance(0), 1)
            f(*args, ctx)
            if ctx.out:
                cov.clear()
            return [(*o, *rest) for o in ctx.out]

        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                if router is None or (shard and row[shard] != key):
                    out += call(router.flush) if router is not None else []
                    router, key = make(), row[shard] if shard else None
                cov.update(int(x) for x in (row["_cov"] if row["_cov"] is not None else []))
                source = row["_source"]
                out += call(router.route, Task({c: row[c] for c in payload}))
            yield pd.DataFrame(out, columns=names)
        if router is not None:
            yield pd.DataFrame(call(router.flush), columns=names)

    return run


__all__ = ["Backoff", "Context", "Engine", "Fatal", "Report", "Retry", "Retryable", "Task", "Worker", "different_attr", "different_instance", "instance_where", "same_attr", "same_instance"]
