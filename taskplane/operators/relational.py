"""Flat-map, filter, fan-out, union, routing by type and deduplication as plain DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(df: DataFrame, text: str = "text", out: str = "word", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each lower-cased word; words are what Unicode white space separates. Null and blank texts give none."""
    return df.select(*keep, F.explode(F.split(F.lower(F.col(text)), r"(?U)\s+")).alias(out)).where(F.col(out) != "")


def fan_out(df: DataFrame, times: str | Column, out: str = "copy") -> DataFrame:
    """Each row as many times as ``times`` says, numbered from 1; none for null or less than 1."""
    n = F.col(times) if isinstance(times, str) else times
    return df.where(n >= 1).withColumn(out, F.explode(F.sequence(F.lit(1), n.cast("int"))))


def union_all(*frames: DataFrame) -> DataFrame:
    """Many producers of one type: their rows by column name, repeated rows kept."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def route(df: DataFrame, conditions: Mapping[str, Column]) -> dict[str, DataFrame]:
    """A frame for each condition. A row goes to every one that holds for it; a null condition does not hold."""
    return {name: df.where(F.coalesce(condition, F.lit(False))) for name, condition in conditions.items()}


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null is a key like any other.

    Without an order ``dropDuplicates`` is cheaper. A minimum of (order, rest) is combined before the shuffle, so that a key that
    holds a third of all rows leaves each task as one row; a window would bring all its rows into one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("__first")
    out = df.groupBy(*keys).agg(least)
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__first.`{c}`").alias(c) for c in df.columns])


def unique_count(df: DataFrame, keys: list[str], out: str = "n_unique") -> DataFrame:
    """The number of distinct keys, in one row; null counts as a key."""
    return df.select(*keys).distinct().agg(F.count("*").alias(out))


def numbered(df: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in a global order, without bringing them into one task.

    Rows are dealt by ranges of the order, written once (so that the ranges cannot change between the two passes), and each
    range's rows are numbered from the sum of the counts before it; only these counts, one a range, go through the driver.
    """
    from ..shared import written

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    low = F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33)
    held = written(ranged.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "numbered")
    counts = sorted(held.groupBy("__part").count().collect())
    before, total = [], 0
    for part, count in counts:
        before.append((part, total))
        total += count
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return held.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + low).drop("__part", "__id", "__before")


def place_in(partition: list[str], order: list[str]) -> Column:
    """0-based place of a row within its key."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
