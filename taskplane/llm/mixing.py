"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into small blocks by a keyed hash. A source's quota is a whole number of block draws;
the quotas of all sources are split among the output shards by a binary tree whose every node draws from the multivariate
hypergeometric law, so that the shards' counts add up exactly and look like a uniform shuffle of all draws. A
shard then takes its own stretch of each source's keyed block order and shuffles its documents locally. The driver holds one row
a source; tasks walk the tree, each to the shards of its own range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, bound_batches, shuffle_partitions

#: Mean documents of a block: what one task must hold to fill the last block of a source.
BLOCK_DOCS = 512
#: Words that a shard should get, and words of the shards that one task writes (8 bytes a word or so).
SHARD_WORDS, TASK_WORDS = 2_000_000, 30_000_000
#: Sources up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, and ``__size``: the number of words of the column text (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flatten(batch.column(batch.num_columns - 1))
            size = np.zeros(batch.num_rows, np.int64)
            for i, j in K.pieces(offsets):
                o = offsets[i : j + 1] - offsets[i]
                size[i:j] = np.diff(np.searchsorted(K.spans(~K.SPACE[data[offsets[i] : offsets[j]]], o)[0], o))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size)], names=[*batch.schema.names[:-1], "__size"])

    chosen = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, schema + ", __size long")


def water_fill(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Targets that share sum(sizes) by weight, none above most x its size; the excess is shared by weight again."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes)], float(sum(sizes))
    while open_:
        total = float(sum(weights[i] for i in open_))
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]] if total else open_
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = most * sizes[i] if total else 0.0
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def split_range(quotas: np.ndarray, shards: int, seed: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the shards first..end-1 (shards, sources) and how many draws of each source stand before the first of them; the path to a
    shard and what it draws are the same from wherever the tree is walked."""
    out, before = np.zeros((end - first, quotas.size), dtype=np.int64), np.zeros(quotas.size, dtype=np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, mine = todo.pop()
        if hi <= first:
            before += mine
        elif lo < end and hi - lo == 1:
            out[lo - first] = mine
        elif lo < end:
            mid, total = (lo + hi) // 2, int(mine.sum())
            take = total * (mid - lo) // (hi - lo)
            rng = np.random.default_rng([seed, lo, hi])
            left = rng.multivariate_hypergeometric(mine, take, method="marginals") if 0 < take else np.zeros_like(mine)
            todo += [(lo, mid, left), (mid, hi, mine - left)]
    return out, before


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts (shards, sources) that add up to quotas; a binary tree of multivariate-hypergeometric draws."""
    return split_range(quotas, shards, seed, 0, shards)[0]


def shard_stretches(spark: SparkSession, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(index, place, shard): the shard of each draw of each source, by the source's index in ``quotas``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            counts, before = split_range(quotas, shards, seed, int(ids[0]), int(ids[-1]) + 1)
            starts = before + np.cumsum(counts, axis=0) - counts
            shard, index = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.array(starts[shard, index]), pa.array(counts[shard, index]), pa.array(ids[0] + shard)], names=["index", "start", "n", "shard"])

    leaves = spark.range(0, shards, 1, min(shards, shuffle_partitions(spark))).mapInArrow(run, "index int, start long, n long, shard long")
    return leaves.select("index", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))


@dataclass
class Mix:
    """What was decided. sources: one row a source (__source key, source, source_size, target, n_blocks, passes, index);
    shards: how many; draws: one row for each draw of a whole block (__source, __block, pass, shard); picks: documents of the blocks that are
    taken in part (__key, pass, shard). Apply with ``taken`` or ``materialise``."""

    sources: DataFrame
    draws: DataFrame
    picks: DataFrame
    seed: int
    shards: int


def _source_key(column: Column) -> Column:
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column.cast("string")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__source": _source_key(F.col("source")), "__key": F.xxhash64(F.col("doc_id").cast("string"), F.col("source"), F.col("text"))})


def _spread(df: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    small = sources.select("__source", "__n_blocks")
    return df.join(F.broadcast(small) if n <= BROADCAST_SOURCES else small, "__source")


def plan_mix(docs: DataFrame, scratch: Scratch, weights: tuple = (1, 2, 3), most: float = 3.0, shards: int | None = None, seed: int = 11) -> tuple[Mix, DataFrame]:
    """Decide the mix of docs (doc_id, text, source); also returns the narrow table of all rows (doc_id, source, __source,
    __key, __size, __block).

    Sources in order of code points, null last, take the weights in turn. Rows that agree in doc_id, source and text
    are drawn together. A document is drawn in whole, most x at most, so that a source's words differ from its target by
    less than the smallest document that its last block did not place.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keyed = _keyed(docs.select("doc_id", "source", "text"))
    narrow = scratch.write(word_counts(keyed, ["doc_id", "source", "__source", "__key"]), "sizes")
    per_source = narrow.groupBy("__source").agg(F.first("source").alias("source"), F.sum("__size").alias("words"), F.count("*").alias("docs"))
    rows = sorted(per_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["words"]) for r in rows]
    weight = [float(weights[i % len(weights)]) for i in range(len(rows))]
    target = water_fill(sizes, weight, most)
    blocks = [max(1, -(-int(r["docs"]) // BLOCK_DOCS)) for r in rows]
    passes = [min(int(t // s), int(most)) if s else 0 for t, s in zip(target, sizes)]
    schema = "__source string, source string, source_size long, target double, __n_blocks int, passes int, index int"
    sources = spark.createDataFrame([(r["__source"], r["source"], s, t, b, p, i) for i, (r, s, t, b, p) in enumerate(zip(rows, sizes, target, blocks, passes))], schema)
    blocked = _spread(narrow, sources, len(rows)).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.col("__n_blocks").cast("long")).cast("int")).drop("__n_blocks")
    # blocks in a keyed order; those that end within the rest of the quota are drawn once more than the others
    table = blocked.groupBy("__source", "__block").agg(F.sum("__size").alias("words"))
    joined = table.join(sources.select("__source", "passes", "index", "__n_blocks", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest")), "__source")
    order = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed + 1), "__source", "__block"), "__block")
    ranked = joined.withColumns({"place": F.row_number().over(order) - 1, "until": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    state = F.when(F.col("until") <= F.col("rest") + 0.5, F.lit(2)).when(F.col("until") - F.col("words") < F.col("rest") - 0.5, F.lit(1)).otherwise(F.lit(0))
    ranked = scratch.write(ranked.withColumn("state", state), "blocks")
    drawn = {r["__source"]: int(r["n"] or 0) for r in ranked.groupBy("__source").agg(F.sum((F.col("state") > 0).cast("int")).alias("n")).collect()}
    quotas = np.array([p * b + drawn.get(r["__source"], 0) for r, p, b in zip(rows, passes, blocks)], dtype=np.int64)
    shards = shards or max(1, -(-int(sum(target)) // SHARD_WORDS))
    # the draws of a source in the order of its blocks, pass after pass; each meets the shard whose stretch it is in
    draw = ranked.select("__source", "__block", "index", "state", "passes", (F.col("rest") - (F.col("until") - F.col("words"))).alias("rest"), "place", "__n_blocks")
    times = F.col("passes") + (F.col("state") > 0).cast("int")
    draw = draw.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("place", F.col("pass").cast("long") * F.col("__n_blocks") + F.col("place"))
    draws = draw.join(shard_stretches(spark, quotas, shards, seed), ["index", "place"])
    draws = scratch.write(draws.select("__source", "__block", "pass", "shard", ((F.col("pass") == F.col("passes")) & (F.col("state") == 1)).alias("part"), "rest"), "draws")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole documents of one block, in a keyed order, as long as they fit into what is left; then one more if
        that ends nearer to the target."""
        left, chosen, best = float(pdf["rest"].iloc[0]), [], None
        for row in pdf.sort_values(["order", "__key"]).itertuples(index=False):
            if row[2] <= left + 0.5:
                left -= row[2]
                chosen.append((row[1], row[3], row[4]))
            elif best is None or row[2] < best[0]:
                best = (row[2], (row[1], row[3], row[4]))
        if best and best[0] - left < left:
            chosen.append(best[1])
        return pd.DataFrame(chosen, columns=["key", "pass", "shard"])

    parts = draws.where("part").select("__source", "__block", "pass", "shard", "rest")
    members = blocked.join(parts, ["__source", "__block"]).groupBy("__source", "__block", "__key", "pass", "shard", "rest").agg(F.sum("__size").alias("words"))
    members = members.select("__source", F.col("__key"), "words", "pass", "shard", "rest", F.xxhash64(F.lit(seed + 2), "__key").alias("order"))
    picks = members.groupBy("__source").applyInPandas(fill, "key long, pass int, shard long").toDF("__key", "pass", "shard")
    picks = scratch.write(picks, "picks")
    return Mix(sources, draws.where("not part").select("__source", "__block", "pass", "shard"), picks, seed, shards), blocked


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (size x copies), and
    for each copy its shard and its place's key in the shard's local shuffle.

    Null texts have size 0, null sources are a source of their own; repeated rows are taken together; an empty table gives an
    empty one; only doc_id, text and source are read. Reruns agree: every choice hangs on keyed hashes and the seed.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    mix, rows = plan_mix(docs, scratch, **options)
    drawn = F.collect_list(F.struct("shard", "pass"))
    whole = mix.draws.groupBy("__source", "__block").agg(drawn.alias("sa"))
    part = mix.picks.groupBy("__key").agg(drawn.alias("sb"))
    none = F.array().cast("array<struct<shard:bigint,pass:int>>")
    out = rows.join(whole, ["__source", "__block"], "left").join(part, "__key", "left").join(mix.sources.drop("source", "__n_blocks", "passes", "index"), "__source")
    out = out.withColumn("taken", F.array_sort(F.concat(F.coalesce("sa", none), F.coalesce("sb", none))))
    copies = F.size("taken").cast("long")
    orders = F.transform("taken", lambda t: _order(mix.seed, F.col("__key"), t["pass"]))
    out = out.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("__size") * copies).alias("taken"), F.transform("taken", lambda t: t["shard"]).alias("shards"), orders.alias("orders"))
    return scratch.finish(out)


def _order(seed: int, key: Column, number: Column) -> Column:
    return F.xxhash64(F.lit(seed + 3), key, number)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: every column of docs, a row for each time it is taken, and ``__shard`` and ``__order``. A shard's rows
    stand together in one partition, in the order of the local shuffle; a partition has a range of shards, in order.

    Nulls, repeated rows and empty tables as in ``mix_report``; the columns may have any names but these two.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    mix, _ = plan_mix(docs, scratch, **options)
    n = mix.sources.count()
    words = float(mix.sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    scratch.drop("sizes", "blocks")
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = _keyed(docs.select("doc_id", "source", "text", whole_row)).select("__source", "__key", "row")
    keyed = _spread(keyed, mix.sources, n).withColumn("__block", F.pmod(F.xxhash64(F.lit(mix.seed), "__key"), F.col("__n_blocks").cast("long")).cast("int"))
    whole = mix.draws.groupBy("__source", "__block").agg(F.collect_list(F.struct("pass", "shard")).alias("__a"))
    part = mix.picks.groupBy("__key").agg(F.collect_list(F.struct("pass", "shard")).alias("__b"))
    out = keyed.join(whole, ["__source", "__block"], "left").join(part, "__key", "left")
    none = F.array().cast("array<struct<pass:int,shard:bigint>>")
    out = out.select("row", "__key", F.explode(F.concat(F.coalesce("__a", none), F.coalesce("__b", none))).alias("__draw"))
    out = out.select("row", F.col("__draw.shard").alias("__shard"), _order(mix.seed, F.col("__key"), F.col("__draw.pass")).alias("__order"))
    tasks = min(mix.shards, max(shuffle_partitions(spark), int(words) // TASK_WORDS))
    each = -(-mix.shards // tasks)
    out = out.repartitionById(-(-mix.shards // each), F.floor(F.col("__shard") / each).cast("int")).sortWithinPartitions("__shard", "__order")
    return out.select("row.*", "__shard", "__order")
