"""Bounded iterators over results and streams that run until their input is read."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import hadoop_path, new_path

_END = object()


class StreamHandle:
    """Rows of a frame while it is computed, at most ``capacity`` ahead of the reader; partitions come one after the other, so
    that the driver never holds more than one. Errors are raised at the end; ``close`` (or leaving the with block) ends it. ``rows()``
    gives an iterator or, with ``pushes``, ``rows(put)`` hands rows to put, which is False once nobody reads."""

    def __init__(self, rows: Callable[..., Any], capacity: int = 1024, finish: Callable[[], Any] | None = None, pushes: bool = False):
        self._queue: queue.Queue = queue.Queue(max(1, capacity))
        self._stop, self._error, self.report = threading.Event(), None, None
        self._rows, self._finish, self._pushes = rows, finish, pushes
        self._thread = threading.Thread(target=self._run, name="taskplane-stream", daemon=True)
        self._thread.start()

    def _put(self, item: Any) -> bool:
        while not self._stop.is_set():
            try:
                self._queue.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def _run(self) -> None:
        try:
            for row in self._rows(self._put) or () if self._pushes else self._rows():
                if not self._put(row):
                    break
            if self._finish:
                self.report = self._finish()
        except BaseException as e:
            self._error = e
        finally:
            self._put(_END)

    def __iter__(self) -> Iterator[Any]:
        while not self._stop.is_set():
            item = self._queue.get()
            if item is _END:
                self._stop.set()
                break
            yield item
        if self._error:
            raise self._error

    def __enter__(self) -> StreamHandle:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        self._stop.set()
        while not self._queue.empty():
            self._queue.get_nowait()
        self._thread.join(timeout=30)


def stream(engine: Any, capacity: int = 1024) -> StreamHandle:
    """Runs an engine in the background and hands out the rows of its collected types as each of them is there, while the run goes on. A
    reader that falls behind by ``capacity`` rows holds the run up; closing the handle shuts it down."""
    if not engine.collects:
        raise RuntimeError("stream() needs a collected type: call engine.collect(type) first")
    box: dict[str, Any] = {}

    def run(put: Callable[[Any], bool]) -> None:
        def live(_: str, frame: DataFrame) -> None:
            for row in frame.toLocalIterator(prefetchPartitions=True):
                if not put(row):
                    engine.shutdown(grace_s=0)
                    return

        engine._live = live
        try:
            box["report"] = engine.run()
        finally:
            engine._live = None

    return StreamHandle(run, capacity, lambda: box["report"], pushes=True)


def run_available(spark: SparkSession, path: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None, output: str = "append", folder: str | None = None) -> DataFrame:
    """Reads what is in a folder (or file) as a stream, in batches, into a table of ``folder``, and returns it. The query's
    own checkpoint stands beside it: the next call with the same folder goes on where this one ended, or was ended. Without one it is
    a new folder in the shared one, which no other call goes on with."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = folder.rstrip("/") if folder else new_path(spark, "stream")
    query = transform(reader.load(path)).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode(output).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out")


def stream_first_seen(frame: DataFrame, keys: list[str], event_time: str | None = None, within: str | None = None) -> DataFrame:
    """First rows of keys in a stream. Its state holds every key; with an event time it forgets keys after ``within``."""
    if event_time and within:
        return frame.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)
    return frame.dropDuplicates(keys)


def reduce_available(spark: SparkSession, path: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """A router over a stream: ``transform`` ends in an aggregation, whose state is kept between batches (and, with a ``folder``, between
    calls); returns its last result."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = folder.rstrip("/") if folder else new_path(spark, "stream")
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/{number:012d}")  # repeated after a failure: the same place again
        last[:] = [f"{where}/out/{number:012d}"]

    query = transform(reader.load(path)).writeStream.outputMode("complete").option("checkpointLocation", f"{where}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:  # nothing new: the last result of an earlier call
        fs, p = hadoop_path(spark, f"{where}/out")
        last = [max(str(f.getPath()) for f in fs.listStatus(p))]
    return spark.read.parquet(*last)


def shuffled(df: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """The same rows in an order that hangs on seed and epoch alone: a hash of the whole row, so that reruns agree."""
    key = F.xxhash64(F.lit(seed), F.lit(epoch), *df.columns)
    return df.orderBy(key, *df.columns)
