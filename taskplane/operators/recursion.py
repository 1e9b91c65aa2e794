"""Types that emit themselves: a frontier that is expanded until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..shared import written


def fixpoint(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], unique: list[str] | None = None, most_rounds: int | None = None) -> DataFrame:
    """All rows that seeds lead to. ``step`` gives the rows that a frontier emits; with ``unique``, rows whose key came before are dropped
    (a graph with cycles then ends). Each round is a written table: lineage does not grow, a lost executor costs its running tasks."""
    frontier = written(seeds.dropDuplicates(unique) if unique else seeds, "round-0")
    seen, n = [frontier], 0
    while most_rounds is None or n < most_rounds:
        n += 1
        new = step(frontier)
        if unique:
            new = new.dropDuplicates(unique)
            for old in seen:
                new = new.join(old.select(*unique), unique, "left_anti")
        frontier = written(new, f"round-{n}")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    out = seen[0]
    for frame in seen[1:]:
        out = out.unionByName(frame)
    return out
