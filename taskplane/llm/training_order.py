"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and slots are files and offsets.

Token streams are packed into sequences of one length. The n-th sequence goes to slot P(n), where P is a Feistel network
over the least even number of bits that holds all sequences, walked along its cycles until it comes back into the range. Range
partitions of slots are shards: raw files of fixed stride, so that slot s is at a known offset of a known file and a
reader can stop and resume anywhere, or take every n-th slot. Tokens are ids of any vocabulary (``encode_ids`` gives those of a
public one) or, without one, the bytes of the texts.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, bound_batches, shuffle_partitions

#: Token ids of the byte tokenizer: a byte of the UTF-8 text is its own id; these two never occur in UTF-8.
END, PAD = 0xFF, 0xFE
LENGTH, SHARD_SEQUENCES, ROUNDS = 2048, 8192, 6
#: Bytes of shards that a task writes, one shard after the other, where there are more than partitions.
TASK_BYTES = 1 << 30
#: Sequences that a task sends at a time; those for one shard go compressed in one row.
FLUSH = 8192


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = K.U64((1 << half) - 1), x.astype(K.U64)
    keys = K.mix(np.arange(1, ROUNDS + 1, dtype=K.U64) + K.U64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> K.U64(half), v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ (K.mix(a ^ k) & mask), a
            else:
                a, b = b, a ^ (K.mix(b ^ k) & mask)
        return (a << K.U64(half)) | b

    out = once(out)
    while (away := out >= K.U64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def byte_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after the other, each followed by END, and where each text starts."""
    data, offsets = K.flatten(column)
    n = len(offsets) - 1
    out = np.full(data.size + n, END, dtype=np.uint8)
    starts = offsets[:-1] + np.arange(n)
    body = np.ones(out.size, dtype=bool)
    body[offsets[1:] + np.arange(n)] = False
    out[body] = data
    return out, starts


def _lists(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and offsets of the rows; the rows are lists of integers or ids as bytes of dtype."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        data, offsets = K.flatten(column.fill_null(b""))
        return data.view(dtype) if data.ctypes.data % np.dtype(dtype).itemsize == 0 else np.frombuffer(data.tobytes(), dtype), offsets // np.dtype(dtype).itemsize
    if column.null_count:
        column = pa.array(column.to_pylist(), column.type) if column.offset else column
        lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        values, offsets = column.flatten(), np.concatenate(([0], np.cumsum(lengths)))
    else:
        offsets = np.asarray(column.offsets, dtype=np.int64)
        values, offsets = column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    if values.null_count:
        there = np.asarray(values.is_valid())
        offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
        values = values.drop_null()
    return np.asarray(values), offsets


def id_stream(column: pa.Array, end: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows of ids."""
    values, offsets = _lists(column, dtype)
    n = len(offsets) - 1
    out = np.full(values.size + n, end, dtype=dtype)
    body = np.ones(out.size, dtype=bool)
    body[offsets[1:] + np.arange(n)] = False
    out[body] = values
    return out, offsets[:-1] + np.arange(n)


_encodings: dict[str, object] = {}


def encode_ids(docs: DataFrame, path: str, pattern: str, dtype: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>, or with ``dtype`` the bytes of such integers) of the column text by a ``.tiktoken`` file of ranks and its
    pattern for words; special strings are ordinary text. Null and empty texts have no ids; a row gives a row; other columns are not
    read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encodings:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _encodings[path].encode_to_numpy
        for batch in batches:
            for part in K.slices(batch, 1):
                ids = [encode(t.as_py() or "", disallowed_special=()).astype(dtype or np.int32) for t in part.column(1)]
                if dtype:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])
                    continue
                offsets = np.concatenate(([0], np.cumsum([x.size for x in ids]))).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, ids {'binary' if dtype else 'array<int>'}")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_order(docs: DataFrame, folder: str, key: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, ids: str | None = None, dtype: str = "uint16", end: int | None = None, pad: int | None = None) -> DataFrame:
    """Writes the shards of docs to ``folder`` and returns a row for each sequence: slot, shard, byte_offset, doc_ids,
    starts (the places in the sequence at which the documents begin; negative: it began in an earlier one), crc32.

    ``ids`` names a column of token ids (an array of integers, or their bytes in ``dtype``), written as ``dtype`` (uint16 or uint32, little-endian) with ``end``
    after each document and ``pad`` behind the last sequence of a partition (by default the two greatest values of dtype); an id that
    does not fit or equals one of the two is an error. Without ``ids`` the bytes of the column text are the tokens.

    ``docs`` (doc_id and that column) is read twice and must deal rows to partitions alike both times, as a table does; each task
    compares what it gets with the first reading and fails if it differs, so that wrong shards are never left. Streams are packed within
    a partition. Null and empty texts or lists are one END, null ids in a list are left out; repeated rows and null doc_ids are kept; an
    empty table writes no shard; other columns are not read. A task writes its shards one after the other, each under a name of its own
    that is then renamed: a task that is repeated leaves the same files.
    """
    spark = docs.sparkSession
    if ids is None:
        dtype, end, pad = "uint8", END, PAD
        texts, stream = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), byte_stream
        sizes = texts.select(F.spark_partition_id().alias("p"), (F.octet_length("text") + 1).cast("long").alias("n"), F.lit(0).alias("wrong"))
    else:
        most = int(np.iinfo(dtype).max)
        end, pad = most if end is None else end, most - 1 if pad is None else pad
        texts, stream = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")), lambda column: id_stream(column, end, dtype)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, n, wrong = TaskContext.get().partitionId(), 0, 0
            for batch in batches:
                values, offsets = _lists(batch.column(0), dtype)
                n += values.size + len(offsets) - 1
                wrong += int(((values < 0) | (values > most) | (values == end) | (values == pad)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n], pa.int64()), pa.array([wrong], pa.int64())], names=["p", "n", "wrong"])

        sizes = texts.select("ids").mapInArrow(measure, "p int, n long, wrong long").where("n > 0")
    width = np.dtype(dtype).itemsize
    sizes = sizes.groupBy("p").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong")).collect()  # a row a partition
    if bad := sum(r["wrong"] for r in sizes):
        raise ValueError(f"{bad} ids are not in {dtype} or are the end or the padding")
    size = {r["p"]: int(r["n"]) for r in sizes}
    first, total = {}, 0
    for p in sorted(size):
        first[p] = total
        total += -(-size[p] // length)
    shards = max(1, -(-total // shard_sequences))
    tasks = min(shards, max(shuffle_partitions(spark), -(-total * length * width // TASK_BYTES)))
    each = -(-shards // tasks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        n, read = first.get(p, 0), 0
        held, ids, starts = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        null = np.zeros(0, bool)

        def cut(count: int) -> pa.RecordBatch:
            """The next sequences, those of one shard in one row."""
            lo = np.arange(count) * length
            a, b = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, lo + length, side="left")
            a = np.maximum(a, 0)
            slot = feistel(np.arange(n, n + count), total, key)
            order = np.argsort(slot, kind="stable")
            rows, slot, a, b, lo = held[: count * length].reshape(count, length)[order], slot[order], a[order], b[order], lo[order]
            docs = np.concatenate(([0], np.cumsum(b - a)))
            pick = np.repeat(a - docs[:-1], b - a) + np.arange(docs[-1])
            shard, first = np.unique(slot // shard_sequences, return_index=True)
            runs = np.append(first, count)
            lists = lambda at, values: pa.ListArray.from_arrays(at.astype(np.int32), values)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array([zstandard.compress(rows[i:j].tobytes(), 3) for i, j in zip(runs, runs[1:])], pa.binary()), lists(runs, pa.array(slot)), lists(runs, pa.array(b - a)),
                 lists(docs[runs], pa.array(ids[pick], mask=null[pick])), lists(docs[runs], pa.array(starts[pick] - np.repeat(lo, b - a)))],
                names=["shard", "tokens", "slots", "counts", "doc_ids", "starts"],
            )

        for batch in batches:
            column, own = batch.column(1), batch.column(0)
            tokens, begin = stream(column)
            read += tokens.size
            ids = np.concatenate([ids, own.fill_null(0).to_numpy(zero_copy_only=False)])
            null = np.concatenate([null, own.is_null().to_numpy(zero_copy_only=False)])
            starts = np.concatenate([starts, begin + held.size])
            held = np.concatenate([held, tokens])
            while held.size >= length:
                count = min(held.size // length, FLUSH)
                yield cut(count)
                n += count
                held, starts = held[count * length :], starts - count * length
                keep = max(0, int(np.searchsorted(starts, 0, side="right")) - 1)
                ids, null, starts = ids[keep:], null[keep:], starts[keep:]
        if held.size:
            held = np.concatenate([held, np.full(length - held.size, pad, dtype)])
            yield cut(1)
        if read != size.get(p, 0):
            raise RuntimeError(f"partition {p} has {read} tokens, {size.get(p, 0)} when first read; write the input as a table first")

    packed = texts.mapInArrow(pack, "shard int, tokens binary, slots array<long>, counts array<long>, doc_ids array<long>, starts array<long>")
    ranged = packed.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")  # a task has a range of shards

    def whole(shard: int, rows: pa.Table, store: fs.FileSystem, root: str) -> pa.RecordBatch:
        slots, counts = (np.asarray(rows[c].combine_chunks().flatten()) for c in ("slots", "counts"))
        first, size = shard * shard_sequences, min(shard_sequences, total - shard * shard_sequences)
        order = np.argsort(slots)
        if not np.array_equal(slots[order], first + np.arange(size)):
            raise RuntimeError(f"shard {shard}: slots are missing or repeated")
        out, at = np.empty((size, length), dtype=dtype), 0
        for blob in rows["tokens"]:
            tokens = np.frombuffer(zstandard.decompress(blob.as_py()), dtype).reshape(-1, length)
            out[slots[at : at + len(tokens)] - first] = tokens
            at += len(tokens)
        temp = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as f:
            f.write(memoryview(out).cast("B"))
        store.move(temp, f"{root}/shard-{shard:08d}.bin")
        begin = (np.cumsum(counts) - counts)[order]
        bounds = np.concatenate(([0], np.cumsum(counts[order]))).astype(np.int32)
        pick = pa.array(np.repeat(begin - bounds[:-1], counts[order]) + np.arange(bounds[-1]))
        lists = [pa.ListArray.from_arrays(bounds, rows[c].combine_chunks().flatten().take(pick)) for c in ("doc_ids", "starts")]
        crc = np.fromiter((zlib.crc32(t) for t in out), np.int64, size)
        return pa.RecordBatch.from_arrays([pa.array(first + np.arange(size)), pa.array(np.full(size, shard, np.int32)), pa.array(np.arange(size) * length * width), *lists, pa.array(crc)], names=["slot", "shard", "byte_offset", "doc_ids", "starts", "crc32"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        shard, parts = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for i, j in zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), numbers.size])):
                if j > i:
                    if parts and numbers[i] != shard:
                        yield whole(shard, pa.Table.from_batches(parts).combine_chunks(), store, root)
                        parts = []
                    shard = int(numbers[i])
                    parts.append(batch.slice(i, j - i))
        if parts:
            yield whole(shard, pa.Table.from_batches(parts).combine_chunks(), store, root)

    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    manifest = Scratch(spark, "training-order").write(ranged.mapInArrow(write, "slot long, shard int, byte_offset long, doc_ids array<long>, starts array<long>, crc32 long"), "manifest")
    with store.open_output_stream(f"{root}/order.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "shard_sequences": shard_sequences, "shards": shards if total else 0, "dtype": dtype, "end": end, "pad": pad, "permutation": f"feistel-{ROUNDS}"}).encode())
    return manifest


def read_slots(folder: str, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on; one seek a shard."""
    store, root = _open(folder)
    with store.open_input_stream(f"{root}/order.json") as f:
        order = json.loads(f.read())
    kind, length, per, end = np.dtype(order["dtype"]), order["length"], order["shard_sequences"], order["sequences"] if count is None else min(order["sequences"], start + count)
    while start < end:
        shard = start // per
        stop = min(end, (shard + 1) * per)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek((start % per) * length * kind.itemsize)
            for _ in range(start, stop):
                yield np.frombuffer(f.read(length * kind.itemsize), kind)
        start = stop
