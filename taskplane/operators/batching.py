"""Chunks, exact re-batching, fixed batches, row batches and rotation: folds over an explicit order.

Results hang on the order columns alone, not on partitions or on which task ran first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered, place_in


def chunk(df: DataFrame, rows: int, batch: list[str], order: list[str], out: str = "piece") -> DataFrame:
    """Numbers the pieces of at most ``rows`` rows of each batch from 0; the last may be smaller. rows counts as 1 at least."""
    return df.withColumn(out, F.floor(place_in(batch, order) / max(1, rows)).cast("long"))


def fixed_batches(df: DataFrame, size: int, key: list[str], order: list[str], out: str = "batch") -> DataFrame:
    """Numbers the batches of exactly ``size`` rows of each key, the remainder last."""
    return chunk(df, size, key, order, out)


def rebatch(df: DataFrame, rows: int, order: list[str], out: str = "chunk") -> DataFrame:
    """Numbers exact chunks of ``rows`` rows over the whole frame in a global order; batches are split where needed."""
    return numbered(df, order, "__n").withColumn(out, F.floor(F.col("__n") / max(1, rows)).cast("long")).drop("__n")


def row_groups(batches: DataFrame, shard: list[str], order: list[str], size: str, target: int, out: str = "group_id") -> DataFrame:
    """Groups whole batches until they hold ``target`` rows: numbers from 0 within a shard; empty batches are left out.

    The fold is sequential by nature, so that each shard is a stream in one task; its state is two numbers, whatever the shard's
    length, and only (shard, order, size) of a batch should be in the frame, not its rows.
    """
    n = max(1, target)
    schema = batches.schema

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, held = object(), 0, 0
        for pdf in parts:
            ids = []
            for row in zip(*[pdf[c] for c in shard], pdf[size]):
                if row[:-1] != key:
                    key, group, held = row[:-1], 0, 0
                ids.append(group)
                held += int(row[-1])
                if held >= n:
                    group, held = group + 1, 0
            yield pdf.assign(**{out: pd.Series(ids, index=pdf.index, dtype="int64")})

    sorted_ = batches.where(F.col(size) > 0).repartition(*shard).sortWithinPartitions(*shard, *order) if shard else batches.where(F.col(size) > 0).coalesce(1).sortWithinPartitions(*order)
    return sorted_.mapInPandas(fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", `{out}` long")


def rotation_parts(batches: DataFrame, shard: list[str], order: list[str], size: str, rotate_rows: int, out: str = "part") -> DataFrame:
    """File parts of a rotating sink: a part closes before a write once it holds ``rotate_rows`` rows. The same fold."""
    return row_groups(batches, shard, order, size, rotate_rows, out)


def part_name(stem: str, part: Column, extension: str) -> Column:
    return F.concat(F.lit(f"{stem}-"), F.lpad(part.cast("string"), 5, "0"), F.lit(f".{extension}"))


def uniform_groups(n_batches: int, batch_rows: int, target: int) -> int:
    """How many groups n batches of one size make."""
    return -(-n_batches // -(-target // batch_rows)) if batch_rows else 0
