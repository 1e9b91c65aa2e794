"""Graphs of task types and the engine that runs them."""

from .engine import Engine, Fatal, Report, Retry, Retryable, Worker, different_attr, different_instance, instance_where, same_attr, same_instance
from .store import CheckpointStore, Dataset, ItemDataset, MemStore, SqliteStore, Store

__all__ = [
    "CheckpointStore", "Dataset", "Engine", "Fatal", "ItemDataset", "MemStore", "Report", "Retry", "Retryable", "SqliteStore", "Store", "Worker", "different_attr", "different_instance", "instance_where", "same_attr", "same_instance",
]
