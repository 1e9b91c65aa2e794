"""Arrow IPC files, which Spark has no reader for: contents come through ``binaryFile``, so that any store that Spark reads will do."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/[_.][^/]*$"))


def _first_schema(spark: SparkSession, path: str) -> StructType:
    """The schema of the first file by path. One task reads that file, and of contents nothing comes to the driver."""
    files = _files(spark, path)
    first = files.agg(F.min_by("_metadata.file_path", "path")).first()[0]  # lists files without reading them
    if first is None:
        raise FileNotFoundError(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                schema = pa.ipc.open_file(pa.BufferReader(blob.as_buffer())).schema
                yield pa.RecordBatch.from_arrays([pa.array([schema.serialize().to_pybytes()], pa.binary())], names=["schema"])

    # Spark leaves out the other files by their metadata
    found = files.where(F.col("_metadata.file_path") == first).select("content").mapInArrow(run, "schema binary").first()
    return from_arrow_schema(pa.ipc.read_schema(pa.BufferReader(bytes(found["schema"]))))


def read_ipc(spark: SparkSession, path: str, chunk_rows: int = 8192) -> DataFrame:
    """Rows of one file or of all files below a folder; the schema is the first file's. Files may have up to 2 GB each."""
    schema = _first_schema(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(blob.as_buffer()))
                for i in range(reader.num_record_batches):
                    b = reader.get_batch(i)
                    for at in range(0, b.num_rows, max(1, chunk_rows)):
                        yield b.slice(at, max(1, chunk_rows))

    return _files(spark, path).select("content").mapInArrow(run, schema)


def write_ipc(df: DataFrame, path: str) -> None:
    """A folder of IPC files, one a partition, each renamed once it is whole; an empty frame leaves one file without rows."""
    uri = path if "://" in path else f"file://{path}"
    schema = to_arrow_schema(df.schema)
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        writer, out, n = None, None, 0
        temp = f"{root}/_{uuid.uuid4().hex}"
        for b in batches:
            if writer is None:
                out = store.open_output_stream(temp)
                writer = pa.ipc.new_file(out, schema)
            writer.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=schema) if b.schema != schema else b)
            n += b.num_rows
        if writer is not None:
            writer.close()
            out.close()
            store.move(temp, f"{root}/part-{uuid.uuid4().hex}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    if not df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]:
        with store.open_output_stream(f"{root}/part-empty.arrow") as out:
            pa.ipc.new_file(out, schema).close()
