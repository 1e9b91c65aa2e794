"""An adapter for training loops: a live first epoch, shuffled replays of the snapshot afterwards. Torch is optional."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .handle import shuffled

try:
    import torch
    from torch.utils.data import DataLoader, Dataset, IterableDataset
except ImportError:  # plain iterators then
    DataLoader = torch = None
    Dataset = IterableDataset = object


def default_decode(item: Any) -> Any:
    """A row as a dict of its columns; a record batch, or something that has one as ``batch``, as a dict of column tensors (NumPy arrays
    without torch); anything else as it is."""
    batch = getattr(item, "batch", item)
    if isinstance(batch, pa.RecordBatch):
        columns = {name: np.array(batch.column(i).to_numpy(zero_copy_only=False)) for i, name in enumerate(batch.schema.names)}
        return {name: torch.from_numpy(x) if torch is not None and x.dtype != object else x for name, x in columns.items()}
    return item.asDict(recursive=True) if hasattr(item, "asDict") else item


class ShuffleBuffer:
    """Mixes a stream within a window of ``size`` items and loses none; no window passes items through."""

    def __init__(self, size: int, seed: int):
        self.size, self._rng, self._held = size, random.Random(seed), []

    def mixed(self, items: Iterator[Any]) -> Iterator[Any]:
        for item in items:
            if self.size <= 0:
                yield item
                continue
            self._held.append(item)
            if len(self._held) > self.size:
                i = self._rng.randrange(len(self._held))
                self._held[i], self._held[-1] = self._held[-1], self._held[i]
                yield self._held.pop()
        self._rng.shuffle(self._held)
        while self._held:
            yield self._held.pop()


class TaskStream(IterableDataset):
    """Epoch 0 drains a live stream; later ones replay ``snapshot()`` in an order of their own."""

    def __init__(self, live: Callable[[], Any], snapshot: Callable[[], DataFrame] | None = None, decode: Callable[[Any], Any] = default_decode, shuffle: int = 0, seed: int = 0):
        self._live, self._snapshot, self._decode, self._shuffle, self._seed, self.epoch = live, snapshot, decode, shuffle, seed, 0

    def __iter__(self) -> Iterator[Any]:
        epoch, self.epoch = self.epoch, self.epoch + 1
        if epoch == 0:
            with self._live() as handle:
                yield from map(self._decode, ShuffleBuffer(self._shuffle, self._seed).mixed(iter(handle)))
        elif self._snapshot is None:
            raise RuntimeError("a second epoch needs a snapshot")
        else:
            yield from map(self._decode, shuffled(self._snapshot(), self._seed, epoch).toLocalIterator(prefetchPartitions=True))


class SnapshotTaskSet(Dataset):
    """Random access to a snapshot that fits into the driver as one Arrow table."""

    def __init__(self, snapshot: DataFrame, decode: Callable[[Any], Any] | None = None):
        self._table, self._decode = snapshot.toArrow(), decode or (lambda x: x)

    def __len__(self) -> int:
        return self._table.num_rows

    def __getitem__(self, i: int) -> Any:
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        return self._decode(self._table.slice(i % len(self), 1).to_pylist()[0])


def loader(source: Any, batch_size: int | None = None, **options: Any) -> Any:
    """A DataLoader in this process; without torch an iterator over lists of batch_size items (or over items)."""
    if options.pop("num_workers", 0):
        raise ValueError("num_workers must be 0: the stream runs in this process")
    if DataLoader:
        return DataLoader(source, batch_size=batch_size, num_workers=0, collate_fn=options.pop("collate_fn", lambda x: x), **options)

    def batches() -> Iterator[Any]:
        held: list[Any] = []
        for item in source if hasattr(source, "__iter__") else (source[i] for i in range(len(source))):
            if batch_size is None:
                yield item
                continue
            held.append(item)
            if len(held) == batch_size:
                yield held
                held = []
        if held:
            yield held

    return batches()
