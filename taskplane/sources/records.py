"""Parquet, CSV and JSON-lines through Spark's own readers and writers; rotating parts; Parquet in a column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import batching


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """With a header; types are inferred over all rows unless a schema is given, whole numbers as bigint."""
    reader = spark.read.options(header=True, **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) and not schema else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """One object a line, whatever the extension."""
    reader = spark.read.options(multiLine=False, **options)
    return (reader.schema(schema) if schema else reader).json(path)


def write_parquet(df: DataFrame, path: str, **options) -> None:
    df.write.options(**options).parquet(path)


def write_csv(df: DataFrame, path: str, **options) -> None:
    df.write.options(header=True, **options).csv(path)


def write_jsonl(df: DataFrame, path: str, **options) -> None:
    df.write.options(ignoreNullFields=False, **options).json(path)


def read_parquet_bytes(df: DataFrame, content: str, schema: str) -> DataFrame:
    """Rows of the Parquet buffers in a binary column; null buffers have none."""
    want = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                if blob.is_valid:
                    yield from pq.read_table(pa.BufferReader(blob.as_buffer()), columns=want.fieldNames()).to_batches()

    return df.select(content).mapInArrow(run, want)


def to_parquet_bytes(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content: the rows of each key as one Parquet buffer. A key's rows must fit into one task."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def pack(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        pq.write_table(rows, sink)
        return rows.slice(0, 1).select(keys).append_column("content", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    return df.groupBy(*keys).applyInArrow(pack, f"{schema}, content binary")


def write_rotating(df: DataFrame, path: str, batch: list[str], rotate_rows: int, stem: str = "part") -> DataFrame:
    """Parquet files ``stem-00000.parquet``...: whole batches in the order of ``batch``; a part closes before a write once it holds
    rotate_rows rows. Returns (part, rows). Files are written under another name and then renamed."""
    sizes = df.groupBy(*batch).agg(F.count("*").alias("__n"))
    parts = batching.rotation_parts(sizes, [], batch, "__n", rotate_rows, "__part").drop("__n")
    rows = df.join(parts, batch).repartition("__part").sortWithinPartitions("__part", *batch)
    kept = [c for c in rows.columns if c != "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        part, writer, temp, n = None, None, None, 0

        def close() -> pa.RecordBatch:
            writer.close()
            store.move(temp, f"{root}/{stem}-{part:05d}.parquet")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64())], names=["part", "rows"])

        for b in batches:
            t = pa.Table.from_batches([b])
            for p in t["__part"].unique().to_pylist():
                piece = t.filter(pa.compute.equal(t["__part"], p)).select(kept)
                if p != part:
                    if writer:
                        yield close()
                    part, temp, n = p, f"{root}/_{uuid.uuid4().hex}", 0
                    writer = pq.ParquetWriter(temp, piece.schema, filesystem=store)
                writer.write_table(piece)
                n += piece.num_rows
        if writer:
            yield close()

    import pyarrow.compute  # noqa: F401

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    return df.sparkSession.createDataFrame(rows.select(*kept, "__part").mapInArrow(run, "part long, rows long").collect(), "part long, rows long")


def file_and_chunk(chunk_rows: int) -> list[Column]:
    """The file and the chunk of each row of a file source: ``path#index``."""
    path = F.col("_metadata.file_path")
    index = F.floor(F.col("_metadata.row_index") / max(1, chunk_rows))
    return [F.concat(path, F.lit("#"), index.cast("string")).alias("key")]
