"""Coverage of source rows, pruning of finished work, checkpoint admission and supersession, as set operations on tables.

Ordinals are namespaced by source: coverage rows are (source, ord).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_to_bytes(ordinals: Iterable[int]) -> bytes:
    """Sorted distinct ordinals as packed little-endian unsigned 64-bit numbers."""
    rows = sorted(set(ordinals))
    return struct.pack(f"<{len(rows)}Q", *rows)


def coverage_rows(data: bytes) -> list[int]:
    if len(data) % 8:
        raise ValueError(f"coverage of {len(data)} bytes is not a whole number of ordinals")
    return list(struct.unpack(f"<{len(data) // 8}Q", data))


def union(coverage: Column) -> Column:
    """Aggregate: the sorted union of coverage arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(coverage))))


def contains_all(covered: Column, coverage: Column) -> Column:
    return F.size(F.array_except(coverage, covered)) == 0


def prune_covered(seeds: DataFrame, covered: DataFrame, keys: tuple[str, ...] = ("source", "ord")) -> DataFrame:
    """Seeds whose row no checkpoint covers yet."""
    return seeds.join(covered.select(*keys).distinct(), list(keys), "left_anti")


def finished_sources(extent: DataFrame, covered: DataFrame) -> DataFrame:
    """Sources with a recorded extent (source, ord) all of whose rows are covered: they need not be read again."""
    missing = extent.join(covered.select("source", "ord").distinct(), ["source", "ord"], "left_anti").select("source").distinct()
    return extent.select("source").distinct().join(missing, "source", "left_anti")


def admit(arrivals: DataFrame, index: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new items to store and process, items skipped): one arrival of each (name, key), unless the index has it already.

    ``index`` has (name, key, status). The first in the given order wins; later ones and known ones are skipped. An item that is
    stored but not consumed is admitted again by ``pending``, not here.
    """
    keys = ["name", "key"]
    first = arrivals.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("__n"))
    known = index.select(*keys).distinct()
    fresh = first.join(known, keys, "left_anti")
    at = [F.col(f"a.{c}") == F.col(f"f.__first.{c}") for c in order]
    new = arrivals.alias("a").join(fresh.alias("f"), [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] + at, "left_semi")
    skipped = first.join(known.withColumn("__known", F.lit(1)), keys, "left").select(*keys, (F.col("__n") - F.when(F.col("__known").isNull(), 1).otherwise(0)).alias("n_skipped")).where("n_skipped > 0")
    return new, skipped


def pending(index: DataFrame) -> DataFrame:
    """Stored items that nothing consumed: the input of a consumer that is there now."""
    return index.where("status = 'stored'")


def task_status(index: DataFrame) -> DataFrame:
    """Items of each checkpoint: all that are stored, and those that were consumed."""
    return index.groupBy("name").agg(F.count("*").alias("n_stored"), F.count_if(F.col("status") == "consumed").alias("n_done"))


def live_shards(shards: DataFrame) -> DataFrame:
    """Shards (id, seq, ord) that newer ones do not cover whole; an empty coverage (null ord) keeps a shard alive.

    A shard is dead if each of its ordinals also belongs to a newer one: the least over its ordinals of the newest shard that has
    the ordinal is newer than itself. One grouping and one join.
    """
    newest = shards.where("ord is not null").groupBy("ord").agg(F.max("seq").alias("newest"))
    oldest = shards.join(newest, "ord", "left").groupBy("id", "seq").agg(F.min("newest").alias("__m"), F.count("ord").alias("n_rows"))
    return oldest.where("__m is null or __m <= seq").drop("__m")
