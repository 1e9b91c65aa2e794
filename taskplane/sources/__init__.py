"""Record and blob sources and sinks behind targets such as ``data/x.csv`` or ``s3://bucket/prefix``."""

from .blobs import read_blobs, write_blobs
from .http import fetch
from .ipc import read_ipc, write_ipc
from .jdbc import postgres_options, write_postgres
from .records import read_parquet_bytes, to_parquet_bytes, write_rotating
from .registry import Registry, Target, blob_sources, read, record_sinks, record_sources, write

__all__ = [
    "Registry", "Target", "blob_sources", "fetch", "postgres_options", "read", "read_blobs", "read_ipc", "read_parquet_bytes", "record_sinks",
    "record_sources", "to_parquet_bytes", "write", "write_blobs", "write_ipc", "write_postgres", "write_rotating",
]
