"""Durable checkpoints: an index of items with status and coverage, and their payloads as Parquet.

The index is a table (name, key, status, source, cov, seq, run). Payloads are written first, the index after them, so that a
crash in between leaves a payload that nothing names rather than an index row without its payload.
"""

from __future__ import annotations

import json
import sqlite3
import time
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import provenance

INDEX = "name string, key string, event string, source string, cov array<bigint>, seq long"


class CheckpointStore(Protocol):
    """What the engine needs of a store; own ones may be passed to it."""

    def index(self) -> DataFrame: ...

    def covered(self) -> DataFrame: ...

    def extents(self) -> DataFrame: ...

    def stored_items(self, name: str) -> DataFrame: ...

    def statuses(self) -> DataFrame: ...

    def commit(self, name: str, items: DataFrame, payload: list[str] | None) -> None: ...

    def consume(self, name: str, keys: DataFrame) -> None: ...

    def record_extent(self, source: str, ordinals: DataFrame) -> None: ...


class Store:
    """A folder with ``index/`` (appended events: stored, consumed, extent) and ``data/<name>/`` (payload rows with their key)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or shared.new_path(spark, "store")).rstrip("/")

    def _events(self) -> DataFrame:
        where = f"{self.path}/index"
        return self.spark.read.schema(INDEX).parquet(where) if shared.exists(self.spark, where) else self.spark.createDataFrame([], INDEX)

    def index(self) -> DataFrame:
        """(name, key, status, source, cov, seq): the first coverage, the newest seq, consumed once an event says so."""
        e = self._events().where("event <> 'extent'")
        first = F.min(F.when(F.col("event") == "stored", F.struct("seq", "source", "cov"))).alias("f")
        return e.groupBy("name", "key").agg(first, F.max("seq").alias("seq"), F.max((F.col("event") == "consumed").cast("int")).alias("c")).select("name", "key", F.when(F.col("c") == 1, "consumed").otherwise("stored").alias("status"), "f.source", "f.cov", "seq")

    def covered(self) -> DataFrame:
        """(source, ord) of everything that is stored."""
        return self._events().where("event = 'stored'").select("source", F.explode("cov").alias("ord")).distinct()

    def extents(self) -> DataFrame:
        return self._events().where("event = 'extent'").select("source", F.explode("cov").alias("ord")).distinct()

    def _append(self, rows: DataFrame, event: str) -> None:
        seq = F.lit(time.time_ns())
        rows.select("name", "key", F.lit(event).alias("event"), "source", "cov", seq.alias("seq")).write.mode("append").parquet(f"{self.path}/index")

    def commit(self, name: str, items: DataFrame, payload: list[str] | None) -> None:
        """items has key, _source, _cov and the payload's columns; None stores keys alone."""
        if payload is not None:
            items.select(F.col("_key"), *payload, "_source", "_cov").write.mode("append").parquet(f"{self.path}/data/{name}")
        self._append(items.select(F.lit(name).alias("name"), F.col("_key").alias("key"), F.col("_source").alias("source"), F.col("_cov").alias("cov")), "stored")

    def consume(self, name: str, keys: DataFrame) -> None:
        none = F.lit(None)
        self._append(keys.select(F.lit(name).alias("name"), F.col("_key").alias("key"), none.cast("string").alias("source"), none.cast("array<bigint>").alias("cov")), "consumed")

    def record_extent(self, source: str, ordinals: DataFrame) -> None:
        """ordinals: (ord); one event row a thousand ordinals, so that no row holds an extent as a whole."""
        none = F.lit(None).cast("string")
        rows = ordinals.groupBy(F.floor(F.col("ord") / 1000).alias("k")).agg(F.array_sort(F.collect_set("ord")).alias("cov"))
        self._append(rows.select(none.alias("name"), none.alias("key"), F.lit(source).alias("source"), "cov"), "extent")

    def payloads(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{name}")

    def stored_items(self, name: str) -> DataFrame:
        """Payload rows that are stored and not consumed."""
        keys = provenance.pending(self.index()).where(F.col("name") == name).select(F.col("key").alias("_key"))
        return self.payloads(name).join(keys, "_key", "left_semi")

    def statuses(self) -> DataFrame:
        return provenance.task_status(self.index())


class MemStore(Store):
    """The index in the driver's memory, payloads in a scratch folder: for tests and for runs that need not be resumed. An index
    that does not fit into the driver needs a ``Store``."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._held: list[tuple] = []
        self._frame: tuple[int, DataFrame] | None = None

    def _events(self) -> DataFrame:
        if self._frame is None or self._frame[0] != len(self._held):  # sent to executors once for each append
            self._frame = len(self._held), self.spark.createDataFrame(self._held, INDEX)
        return self._frame[1]

    def _append(self, rows: DataFrame, event: str) -> None:
        seq = time.time_ns()
        self._held += [(r["name"], r["key"], event, r["source"], r["cov"], seq) for r in rows.select("name", "key", "source", "cov").toLocalIterator()]


class SqliteStore(Store):
    """The index in a SQLite file beside the driver, payloads as Parquet in the store's folder. A missing payload is an error when it
    is read."""

    def __init__(self, spark: SparkSession, file: str, path: str | None = None):
        super().__init__(spark, path or f"file://{file}-data")
        self._file = file
        self._frame: tuple[int, DataFrame] | None = None

    def _connect(self) -> sqlite3.Connection:
        con = sqlite3.connect(self._file)
        con.execute("pragma journal_mode = wal")
        con.execute("create table if not exists events (name text, key text, event text, source text, cov text, seq integer)")
        return con

    def _events(self) -> DataFrame:
        con = self._connect()
        try:
            (last,) = con.execute("select coalesce(max(rowid), 0) from events").fetchone()
            if self._frame is None or self._frame[0] != last:  # read once for each append
                rows = [(n, k, e, s, json.loads(c) if c else None, q) for n, k, e, s, c, q in con.execute("select name, key, event, source, cov, seq from events where rowid <= ? order by rowid", (last,))]
                self._frame = last, self.spark.createDataFrame(rows, INDEX)
        finally:
            con.close()
        return self._frame[1]

    def _append(self, rows: DataFrame, event: str) -> None:
        seq, con = time.time_ns(), self._connect()
        try:
            with con:
                con.executemany("insert into events values (?, ?, ?, ?, ?, ?)", ((r["name"], r["key"], event, r["source"], json.dumps(r["cov"]) if r["cov"] is not None else None, seq) for r in rows.select("name", "key", "source", "cov").toLocalIterator()))
        finally:
            con.close()


class DatasetStore(Store):
    """The index of a dataset: payloads are the dataset's items, what newer coverage supersedes is not read again."""

    def __init__(self, dataset: Dataset | ItemDataset):
        super().__init__(dataset.spark, f"{dataset.path}/store")
        self._items = dataset

    def commit(self, name: str, items: DataFrame, payload: list[str] | None) -> None:
        if payload is not None:
            self._items.put_items(name, items.select("_key", *payload, "_source", "_cov"))
        super().commit(name, items, None)

    def payloads(self, name: str) -> DataFrame:
        return self._items.items(name)


def _digest(columns: list[str]) -> Column:
    """Aggregate: a digest of rows in any order, of bounded size: their number and two 64-bit hashes, summed modulo 2**62."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]))
    total = lambda seed: F.hex(F.sum(F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 62)).cast("decimal(38,0)")) % (1 << 62))
    return F.sha2(F.concat_ws("-", F.count("*").cast("string"), total(1).cast("string"), total(2).cast("string")), 256)


class Dataset:
    """A self-compacting folder of content-addressed Parquet shards: a shard that newer coverage supersedes is not read any more."""

    SHARDS = "id string, name string, key string, path string, seq long, cov array<bigint>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._store = spark, path.rstrip("/"), None

    def store(self) -> DatasetStore:
        self._store = self._store or DatasetStore(self)
        return self._store

    def _shards(self) -> DataFrame:
        where = f"{self.path}/shards"
        return self.spark.read.schema(self.SHARDS).parquet(where) if shared.exists(self.spark, where) else self.spark.createDataFrame([], self.SHARDS)

    def put(self, name: str, key: str, rows: DataFrame, cov: list[int]) -> str:
        """Writes a shard and returns its file's place: the digest of its rows, so that equal shards share one."""
        digest = rows.agg(_digest(rows.columns)).first()[0]
        where = f"{self.path}/{digest[:2]}/{digest[2:]}.parquet"
        if not shared.exists(self.spark, where):
            rows.write.parquet(where)
        seq = time.time_ns()
        self.spark.createDataFrame([(f"{name}/{key}/{seq}", name, key, where, seq, sorted(set(cov)))], self.SHARDS).write.mode("append").parquet(f"{self.path}/shards")
        return where

    def put_items(self, name: str, items: DataFrame) -> None:
        """items has _key, _cov and the payload's columns: the rows of a key are one shard. All shards are written in one job, those that
        are there already (by their digest) not again; the index that names them comes last."""
        payload = [c for c in items.columns if c != "_cov"]
        folder, seq = f"{self.path}/items/{name}", time.time_ns()
        keyed = items.groupBy("_key").agg(_digest(payload).alias("_shard"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_cov")))).alias("_cover"))
        keyed = shared.written(keyed, "shards")
        new = keyed.select(F.col("_key").alias("_of"), "_shard")
        if shared.exists(self.spark, folder):
            new = new.join(self._shards().select(F.regexp_extract("path", "_shard=(.*)$", 1).alias("_shard")).distinct(), "_shard", "left_anti")
        rows = items.join(new, F.col("_key").eqNullSafe(F.col("_of"))).drop("_of")
        rows.repartition("_shard").write.mode("append").partitionBy("_shard").parquet(folder)
        place = F.concat(F.lit(f"{folder}/_shard="), "_shard")
        index = keyed.select(F.concat_ws("/", F.lit(name), "_key", F.lit(str(seq))).alias("id"), F.lit(name).alias("name"), F.col("_key").alias("key"), place.alias("path"), F.lit(seq).alias("seq"), F.col("_cover").alias("cov"))
        index.write.mode("append").parquet(f"{self.path}/shards")

    def items(self, name: str) -> DataFrame:
        """The rows of the live shards that ``put_items`` wrote, with _key, _source and _cov."""
        folder = f"{self.path}/items/{name}"
        live = self.live().where(F.col("name") == name).select(F.regexp_extract("path", "_shard=(.*)$", 1).alias("_shard")).distinct()
        return self.spark.read.parquet(folder).withColumn("_shard", F.col("_shard").cast("string")).join(live, "_shard", "left_semi").drop("_shard")

    def live(self) -> DataFrame:
        """Shards that are read: the newest of each (name, key) unless newer shards cover it whole."""
        s = self._shards()
        newest = s.groupBy("name", "key").agg(F.max("seq").alias("seq"))
        s = s.join(newest, ["name", "key", "seq"], "left_semi")
        alive = provenance.live_shards(s.select("id", "seq", F.explode_outer("cov").alias("ord")))
        return s.join(alive.select("id"), "id", "left_semi")

    def read(self, name: str | None = None) -> DataFrame:
        """The payloads of all live shards, or of those of one name."""
        if name is not None and shared.exists(self.spark, f"{self.path}/items/{name}"):
            rows = self.items(name)
            return rows.drop("_key", "_source", "_cov")
        live = self.live() if name is None else self.live().where(F.col("name") == name)
        return self.spark.read.parquet(*[r["path"] for r in live.select("path").distinct().collect()])

    def compact(self) -> int:
        """Removes shards that no live one shares; returns how many. Paths come to the driver a partition at a time."""
        dead = self._shards().select("path").distinct().join(self.live().select("path").distinct(), "path", "left_anti")
        removed = 0
        for r in dead.toLocalIterator():
            if shared.exists(self.spark, r["path"]):
                shared.delete(self.spark, r["path"])
            removed += 1
        return removed


class ItemDataset:
    """Checkpoint items as rows instead of files: ``data/<name>`` has the payloads, ``index`` the coverage of each item. What newer
    items cover whole is not read any more; nothing is opened item by item."""

    INDEX = "id string, name string, key string, seq long, cov array<bigint>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._store = spark, path.rstrip("/"), None

    def store(self) -> DatasetStore:
        self._store = self._store or DatasetStore(self)
        return self._store

    def put_items(self, name: str, items: DataFrame) -> None:
        """items has _key, _cov and the payload's columns. Payloads are written before the index that names them."""
        seq = time.time_ns()
        rows = items.withColumn("_id", F.concat_ws("/", F.lit(name), F.col("_key"), F.lit(str(seq))))
        rows.write.mode("append").parquet(f"{self.path}/data/{name}")
        rows.select(F.col("_id").alias("id"), F.lit(name).alias("name"), F.col("_key").alias("key"), F.lit(seq).alias("seq"), F.col("_cov").alias("cov")).write.mode("append").parquet(f"{self.path}/index")

    put = put_items

    def live(self) -> DataFrame:
        where = f"{self.path}/index"
        index = self.spark.read.schema(self.INDEX).parquet(where) if shared.exists(self.spark, where) else self.spark.createDataFrame([], self.INDEX)
        newest = index.groupBy("name", "key").agg(F.max("seq").alias("seq"))
        index = index.join(newest, ["name", "key", "seq"], "left_semi")
        alive = provenance.live_shards(index.select("id", "seq", F.explode_outer("cov").alias("ord")))
        return index.join(alive.select("id"), "id", "left_semi")

    def items(self, name: str) -> DataFrame:
        """The rows of live items, with _key, _source and _cov."""
        rows = self.spark.read.parquet(f"{self.path}/data/{name}")
        return rows.join(self.live().select(F.col("id").alias("_id")), "_id", "left_semi").drop("_id")

    def read(self, name: str) -> DataFrame:
        """The payloads of live items."""
        return self.items(name).drop("_key", "_source", "_cov")
