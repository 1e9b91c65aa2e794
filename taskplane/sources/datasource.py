"""Own record formats as Spark data sources: a function from a file to Arrow batches is all that a format needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def _files(path: str) -> list[str]:
    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def register_format(spark: SparkSession, name: str, open_batches: Callable[[pa.NativeFile], Iterator[pa.RecordBatch]], schema_of: Callable[[pa.NativeFile], pa.Schema]) -> None:
    """``spark.read.format(name).load(path)`` from then on: a task reads a file; the schema is the first file's."""

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self) -> list[InputPartition]:
            return [_File(f) for f in _files(self.path)]

        def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
            store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
            with store.open_input_file(partition.path) as f:
                yield from open_batches(f)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            path = self.options["path"]
            store, _ = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            files = _files(path)
            if not files:
                raise FileNotFoundError(path)
            with store.open_input_file(files[0]) as f:
                return from_arrow_schema(schema_of(f))

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options["path"])

    spark.dataSource.register(Source)


def ipc_batches(f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
    reader = pa.ipc.open_file(f)
    for i in range(reader.num_record_batches):
        yield reader.get_batch(i)


def ipc_schema(f: pa.NativeFile) -> pa.Schema:
    return pa.ipc.open_file(f).schema
