"""Files as rows (key, value): trees of files or prefixes of object stores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """One file or all files below a folder; key is the path below it (the file's name for one file).
    Spark's reader leaves out files without bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split("://", 1)[-1].strip("/")
    inside = F.substring_index("path", f"{root}/", -1)
    return df.select(F.when(F.col("path").endswith(f"/{root}"), F.element_at(F.split("path", "/"), -1)).otherwise(inside).alias("key"), F.col("content").alias("value"))


def safe_key(key: str) -> str:
    """A key without root and parent parts."""
    parts = [p for p in PurePosixPath(key.replace("\\", "/")).parts if p not in ("/", "..", ".")]
    if not parts:
        raise ValueError(f"no file name in key {key!r}")
    return "/".join(parts)


def write_blobs(df: DataFrame, path: str) -> int:
    """Writes (key, value) rows as files below a folder or prefix and returns how many. A file appears whole or not at all; of equal
    keys one wins. Null values are written as empty files."""
    uri = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                where = f"{root}/{safe_key(key)}"
                store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                temp = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write(value.as_buffer() if value.is_valid else b"")
                store.move(temp, where)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    return int(df.select("key", "value").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
