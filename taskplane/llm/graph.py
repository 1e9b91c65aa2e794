"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Edges up to which one task finds the components (some 100 bytes an edge); more take distributed rounds.
ONE_TASK_EDGES = 1_000_000


def least_of_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their component's least node): each root hooks on to the least neighbouring root, then paths are halved."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: u.size], at[u.size :]
    up = np.arange(nodes.size)
    while a.size:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            rows = pa.Table.from_batches(got)
            nodes, least = least_of_components(rows["u"].to_numpy(), rows["v"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), the component being its least node.

    Each step is a grouped minimum, combined before the shuffle and written, and a join in which only the edge side can be
    skewed. Both sides of it are scans, which the adaptive join needs in order to split a hub. The number of rounds grows with the logarithm of the largest component.
    Every round is a table in the shared folder; nothing but two totals reaches the driver. Up to ONE_TASK_EDGES distinct edges need no
    rounds: one task reads them.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    if now.count() <= ONE_TASK_EDGES:
        return _in_one_task(now)
    before, k, held = None, 0, f"{name}-0"
    while True:
        # large star: every neighbour above a node meets the least node of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{k}")
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large-{k}")
        # small star: a node and its lower neighbours meet the least of them
        lowest = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lowest-{k}")
        small = large.join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("m"), F.col("u").alias("b"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = scratch.write(small, f"{name}-{k + 1}")
        scratch.drop(held, f"{name}-least-{k}", f"{name}-large-{k}", f"{name}-lowest-{k}")
        k += 1
        now, held = small, f"{name}-{k}"
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == before or not total[0]:
            break
        before = total
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
