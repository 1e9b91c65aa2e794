"""Streams of results: Structured Streaming runs, bounded iterators, shuffles and an adapter for training loops."""

from .handle import StreamHandle, reduce_available, run_available, shuffled, stream, stream_first_seen
from .training import ShuffleBuffer, SnapshotTaskSet, TaskStream, default_decode, loader

__all__ = ["ShuffleBuffer", "SnapshotTaskSet", "StreamHandle", "TaskStream", "default_decode", "loader", "reduce_available", "run_available", "shuffled", "stream", "stream_first_seen"]
