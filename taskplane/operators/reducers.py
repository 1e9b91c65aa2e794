"""Routers as aggregations: partial folds on the map side, one merge, a finished value.

A reducer says how to aggregate with Column expressions. ``Fold`` takes Python callbacks for states that no expression can hold.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Reducer:
    """``aggregates`` over all rows, or by ``keys``. Without keys the result is one row even for no input."""

    aggregates: dict[str, Column]
    keys: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        columns = [c.alias(n) for n, c in self.aggregates.items()]
        return df.groupBy(*self.keys).agg(*columns) if self.keys else df.agg(*columns)

    def finished(self, rows: list) -> Any:
        """The value of the result's rows: a number, a tuple, or a dict by key."""
        pick = lambda r: r[-1] if len(self.aggregates) == 1 else tuple(r[len(self.keys) :])
        if not self.keys:
            return pick(rows[0])
        return {(r[0] if len(self.keys) == 1 else tuple(r[: len(self.keys)])): pick(r) for r in rows}

    def value(self, df: DataFrame) -> Any:
        """The finished value. Keyed results are read to the driver; use ``apply`` for large ones."""
        return self.finished(self.apply(df).collect())


def count(out: str = "n") -> Reducer:
    return Reducer({out: F.count("*")})


def total(column: str, out: str = "total") -> Reducer:
    """Sum; 0 for no rows and for nulls alone."""
    return Reducer({out: F.coalesce(F.sum(column), F.lit(0))})


def keyed_count(*keys: str, out: str = "n") -> Reducer:
    return Reducer({out: F.count("*")}, list(keys))


def count_and_sum(column: str) -> Reducer:
    return Reducer({"n": F.count("*"), "total": F.coalesce(F.sum(column), F.lit(0))})


def batches_and_items(batch: str) -> Reducer:
    return Reducer({"n_batches": F.count_distinct(F.col(batch)), "n_items": F.count("*")})


def collected(*columns: str, out: str = "items") -> Reducer:
    """All rows as one sorted array; for results that are known to be small."""
    return Reducer({out: F.sort_array(F.collect_list(F.struct(*columns)))})


@dataclass
class Fold:
    """A fold with Python callbacks: ``route(state, row)`` changes or returns the state, ``merge(a, b)`` joins two, ``finalize(state)``
    ends. States are made by ``initial`` in each task, merged in rounds of FAN_IN by tasks, and only the last one reaches the driver; they
    must not depend on the order of rows."""

    initial: Callable[[], Any]
    route: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    finalize: Callable[[Any], Any] = lambda s: s
    FAN_IN = 32

    def value(self, df: DataFrame) -> Any:
        from ..shared import written

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = self.initial()
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    got = self.route(state, row)
                    state = state if got is None else got
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

        def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = None
            for pdf in batches:
                for s in pdf["state"]:
                    s = pickle.loads(s)
                    state = s if state is None else self.merge(state, s)
            if state is not None:
                yield pd.DataFrame({"state": [pickle.dumps(state)]})

        states = written(df.mapInPandas(partial, "state binary"), "fold")
        while (n := states.count()) > self.FAN_IN:
            states = written(states.repartition(-(-n // self.FAN_IN)).mapInPandas(merged, "state binary"), "fold")
        state = self.initial()
        for r in states.collect():
            state = self.merge(state, pickle.loads(r["state"]))
        return self.finalize(state)


def from_router(router: Any) -> Fold:
    """A Fold from an object with ``route(value)``, ``merge(other)`` and ``finalize()``; it is copied into every task."""
    blank = pickle.dumps(router)

    def step(state: Any, row: dict) -> Any:
        state.route(row)

    def join(a: Any, b: Any) -> Any:
        return a.merge(b) or a

    return Fold(lambda: pickle.loads(blank), step, join, lambda s: s.finalize())


def fold_rows(rows: Iterable[dict], fold: Fold) -> Any:
    """The same fold in one process, for tests."""
    state = fold.initial()
    for row in rows:
        got = fold.route(state, row)
        state = state if got is None else got
    return fold.finalize(state)
