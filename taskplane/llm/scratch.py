"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder is set only where it is unset and everything runs in
    one process (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="taskplane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A folder of Parquet tables that cut lineage.

    A lost executor only costs the tasks that were running: what is written here is read again from the shared folder.
    ``finish`` writes the result and removes the other tables, so that an operator leaves one table behind.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._names: list[str] = []

    def location(self, name: str) -> str:
        self._names.append(name)
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        where = self.location(name)
        schema = df.schema
        df.write.mode("overwrite").parquet(where, compression=compression)
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._names.remove(name)
            delete_path(self.spark, f"{self.path}/{name}")

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self.write(df, name)
        self.drop(*[n for n in self._names if n != name])
        return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch of whole texts. Python and the JVM hold a few batches a task at a time.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session: with the default of 10,000 rows the copies of one batch of
    whole texts take some 300 MB a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
