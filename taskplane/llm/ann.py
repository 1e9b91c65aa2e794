"""Nearest neighbours by largest inner product: inverted lists scanned dimension block by dimension block.

Inner products become distances by one more dimension (sqrt(M^2 - |x|^2), M the largest norm), and a random rotation
spreads every vector's length evenly over its dimensions. Each list keeps its vectors in column blocks. A scan adds up
a distance block by block; after each block a hypothesis test compares the distance so far, scaled to all dimensions,
with the k-th best so far, and candidates that are very unlikely to come below it are abandoned. Survivors are ranked by the
exact inner product of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that the centroids are fitted on (the least by a hash of the vector) and their bytes, most lists, rounds of k-means. The driver
#: holds some copies of the sample, so that wide vectors (over 256 dimensions) get fewer rows; four rows a list at least.
FIT_ROWS, FIT_BYTES, MOST_LISTS, FIT_ROUNDS = 16_384, 1 << 25, 4096, 12
#: Recall that the number of probed lists is set for, on as many rows of the sample as queries.
RECALL, TRIALS = 0.96, 256
#: Vectors of a segment and queries of a block: what one step of the scan holds.
SEGMENT, QUERIES = 2048, 1024
#: Share of pairs below which distances are added up pair by pair.
FEW = 0.02
#: Dimensions that one matrix rotates; distances of rows and centroids that are held at a time.
TURN, HELD = 512, 1 << 22
#: Partial answers that a task joins at a time.
FLUSH = 100_000
#: Column blocks end at these dimensions (fixed values) and at the last one; the test's tolerance.
BLOCKS, EPSILON = (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096), 2.1


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class WideRotation:
    """``x @ WideRotation(d)`` rotates d dimensions with matrices of TURN² numbers instead of d²: twice, the dimensions are shuffled and
    then rotated in blocks, so that the second time each block holds parts of all blocks of the first."""

    __array_ufunc__ = None  # numpy leaves x @ self to __rmatmul__

    def __init__(self, d: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rounds = [np.array_split(rng.permutation(d), -(-d // TURN)) for _ in range(2)]
        self.turns = {n: rotation(n, seed) for n in {len(block) for block in self.rounds[0]}}

    def __rmatmul__(self, x: np.ndarray) -> np.ndarray:
        for blocks in self.rounds:
            x = np.hstack([x[:, block] @ self.turns[len(block)] for block in blocks])
        return x


def lift(x: np.ndarray, most: float | None, turn: np.ndarray | WideRotation) -> np.ndarray:
    """Rotated vectors with one more dimension: what makes all of one length, or 0 for queries (most is None). The distance of a
    query and a vector is then |q|^2 + most^2 - 2 q.x."""
    rest = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, rest[:, None]]) @ turn


def k_means(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        count = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int64)
    norm = np.einsum("ij,ij->i", c, c)
    step = max(1, min(4096, HELD // max(1, len(c))))
    for i in range(0, len(x), step):
        d = norm - 2 * x[i : i + step] @ c.T
        near = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
        out[i : i + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def probes_for(sample: np.ndarray, lifted: np.ndarray, centroids: np.ndarray, turn: np.ndarray | WideRotation, k: int, recall: float) -> int:
    """Lists to probe so that ``recall`` of the sample's own nearest neighbours stand in them. Among more rows the neighbours are
    nearer, so that this errs on the side of too many."""
    n = len(sample)
    if recall >= 1:
        return len(centroids)
    asked = np.linspace(0, n - 1, min(n, TRIALS)).astype(int)
    scores = sample[asked] @ sample.T
    scores[np.arange(asked.size), asked] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = nearest(lifted, centroids, 1)[:, 0]
    order = nearest(lift(sample[asked], None, turn), centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None].repeat(asked.size, axis=0), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(needed.size - 1, int(np.ceil(recall * needed.size)))]) + 1


def scan(queries: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that survive the tests; ``columns`` has a row for each dimension.

    While many pairs are left, a block's share of all distances is one matrix product; few are added up pair by pair.
    """
    d, n = columns.shape
    ends = [e for e in BLOCKS if e < d] + [d]

    def block(lo: int, hi: int) -> np.ndarray:
        q, c = queries[:, lo:hi], columns[lo:hi]
        return np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->j", c, c)[None] - 2 * q @ c

    first = ends[0]
    if n <= 2 * k or first == d:
        return np.divmod(np.arange(len(queries) * n), n)
    part = block(0, first)
    seeds = np.argpartition(part, 2 * k - 1, axis=1)[:, : 2 * k]
    whole = np.stack([((q[None] - columns[:, s].T) ** 2).sum(axis=1) for q, s in zip(queries, seeds)])
    bound = np.partition(whole, k - 1, axis=1)[:, k - 1]  # the k-th best distance can only be smaller
    limit = lambda m: bound * ((1 + EPSILON / np.sqrt(m)) ** 2 * m / d if m < d else 1 + 1e-9)
    alive = part <= limit(first)[:, None]
    for at, (lo, hi) in enumerate(zip(ends, ends[1:])):
        if alive.mean() < FEW:
            break
        part += block(lo, hi)
        alive &= part <= limit(hi)[:, None]
    else:
        # all dimensions are in: only the k nearest of each query, and what ties with the last
        part[~alive] = np.inf
        kth = np.partition(part, k - 1, axis=1)[:, k - 1]
        return np.nonzero(alive & (part <= (kth + 1e-9 * np.abs(kth) + 1e-12)[:, None]))
    qi, xi = np.nonzero(alive)
    so_far = part[qi, xi]
    for lo, hi in list(zip(ends, ends[1:]))[at:]:
        so_far = so_far + sum((queries[qi, j] - columns[j, xi]) ** 2 for j in range(lo, hi))
        keep = so_far <= limit(hi)[qi]
        qi, xi, so_far = qi[keep], xi[keep], so_far[keep]
    return qi, xi


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def usable_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows whose vector is not null, not zero, without null or non-finite components, and of the
    most frequent length (the smaller on ties)."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite).where(F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (common["d"] if common else -1))


def search(table: DataFrame, k: int = 20, is_query=lambda vec_id: vec_id % 20 == 0, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows, nearest first, ties to smaller ids.

    ``table`` has (vec_id, embedding). Rows that ``usable_vectors`` leaves out take no part; a repeated (vec_id, embedding) counts once,
    a vec_id with several vectors is a row and a query for each. Equal vectors are scanned once: only their k + 1 smallest ids
    can be in an answer, so that keeping those loses nothing. The index is fitted on at most FIT_ROWS rows of FIT_BYTES in all and
    holds every vector; lists are cut into segments and their queries into blocks, so that a hot list is spread over tasks.
    No usable rows give an empty result; other columns are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable_vectors(table)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, set] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                groups.setdefault(np.asarray(v.values, dtype=np.float64).tobytes(), set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array([sorted(g)[: k + 1] for g in groups.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k + 1)
    batched = rows.mapInArrow(distinct, "vec binary, ids array<long>")
    salted = batched.groupBy("vec", F.pmod(F.xxhash64("ids"), F.lit(32)).alias("salt")).agg(least("ids").alias("ids"))
    vectors = scratch.write(salted.groupBy("vec").agg(least("ids").alias("ids")), "vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = vectors.select(F.length("vec")).first()[0] // 8
    fit = max(2, min(FIT_ROWS, FIT_BYTES // (8 * d)))
    sample = _matrix(vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(fit).toArrow()["vec"].combine_chunks())  # FIT_BYTES at most

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))])], names=["m"])

    most = vectors.select("vec").mapInArrow(norms, "m double").agg(F.max("m")).first()[0] * (1 + 1e-12)
    turn = rotation(d + 1) if d < TURN else WideRotation(d + 1)
    lifted = lift(sample, most, turn)
    centroids = k_means(lifted, int(np.clip(round(np.sqrt(n) / 2), 1, max(1, min(MOST_LISTS, len(sample) // 4)))))
    probes = probes_for(sample, lifted, centroids, turn, k, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(lift(_matrix(batch.column(0)), most, turn), centroids, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["list", "vec", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(lift(_matrix(batch.column(0)), None, turn), centroids, probes) if batch.num_rows else np.zeros((0, probes), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(at.astype(np.int32)), pa.list_(pa.int32())), *batch.columns], names=["lists", "vec", "query"])

    assigned = scratch.write(vectors.select("vec", "ids").mapInArrow(assign, "list int, vec binary, ids array<long>"), "assigned")
    sizes = assigned.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / SEGMENT).cast("int").alias("segments"))
    sizes = F.broadcast(sizes)  # at most MOST_LISTS rows

    def pack(part: pa.Table) -> pa.Table:
        x = _matrix(part["vec"].combine_chunks())
        cols = [[part["list"][0].as_py()], [part["segment"][0].as_py()], [x.tobytes()], [np.ascontiguousarray(lift(x, most, turn).T).tobytes()], [part["ids"].to_pylist()]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))))], names=["list", "segment", "original", "columns", "ids"])

    placed = assigned.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec"), F.col("segments").cast("long")).cast("int").alias("segment"), "vec", "ids")
    segments = placed.groupBy("list", "segment").applyInArrow(pack, "list int, segment int, original binary, columns binary, ids array<array<long>>")

    def pack_queries(part: pa.Table) -> pa.Table:
        x = _matrix(part["vec"].combine_chunks())
        cols = [[part["list"][0].as_py()], [x.tobytes()], [lift(x, None, turn).tobytes()], [part["query"].to_pylist()]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=["list", "q_original", "q_turned", "queries"])

    # queries with one vector beyond its k + 1 smallest ids are queries too
    asked = rows.where(is_query(F.col("vec_id"))).select("vec_id", "vec").distinct()

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v.values, dtype=np.float64).tobytes() for v in batch.column(1)], pa.binary()), batch.column(0)], names=["vec", "query"])

    visits = asked.mapInArrow(to_bytes, "vec binary, query long").mapInArrow(visit, "lists array<int>, vec binary, query long")
    visits = scratch.write(visits, "visits")
    n_queries = visits.count()
    groups = max(1, -(-n_queries // QUERIES))
    per_list = visits.select(F.explode("lists").alias("list"), "vec", "query", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("block"))
    blocks = per_list.groupBy("list", "block").applyInArrow(pack_queries, "list int, q_original binary, q_turned binary, queries array<long>")
    blocks = blocks.join(sizes, "list").withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1))).drop("segments")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, r=r, batch=batch: batch.column(name)[r]
                ids, asked_ids = get("ids").values, np.asarray(get("queries").values)
                x, columns = (np.frombuffer(get(c).as_buffer()).reshape(s) for c, s in (("original", (-1, d)), ("columns", (d + 1, -1))))
                q, turned = (np.frombuffer(get(c).as_buffer()).reshape(s) for c, s in (("q_original", (-1, d)), ("q_turned", (-1, d + 1))))
                qi, xi = scan(turned, columns, k + 1)
                score = np.einsum("ij,ij->i", q[qi], x[xi])
                order = np.lexsort((-score, qi))
                qi, xi, score = qi[order], xi[order], score[order]
                # the k + 1 best distinct vectors of each query, and all that tie with the last one
                first = np.searchsorted(qi, np.arange(len(asked_ids) + 1))
                last = np.minimum(first[:-1] + k, first[1:] - 1)
                keep = score >= np.where(first[1:] > first[:-1], score[np.maximum(last, 0)] if score.size else 0, np.inf)[qi]
                qi, xi, score = qi[keep], xi[keep], score[keep]
                # every id that has the vector, but the query's own
                at = np.asarray(ids.offsets)
                count = np.diff(at)[xi]
                pick = np.repeat(at[xi] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                who, score, qi = np.asarray(ids.values)[pick], np.repeat(score, count), np.repeat(qi, count)
                other = who != asked_ids[qi]
                who, score, qi = who[other], score[other], qi[other]
                order = np.lexsort((who, -score, qi))
                who, score, qi = who[order], score[order], qi[order]
                first = np.searchsorted(qi, np.arange(len(asked_ids) + 1))
                top = np.arange(qi.size) - first[qi] < k
                who, score, qi = who[top], score[top], qi[top]
                lists = np.searchsorted(qi, np.arange(len(asked_ids) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids), pa.ListArray.from_arrays(lists, pa.array(who)), pa.ListArray.from_arrays(lists, pa.array(score))], names=["query_id", "ids", "scores"])

    def merge(part: pa.Table) -> pa.Table:
        who, score = (np.concatenate([np.asarray(c.flatten()) for c in part[n].chunks]) for n in ("ids", "scores"))
        order = np.lexsort((who, -score))[:k]
        return pa.table([pa.array(np.full(order.size, part["query_id"][0].as_py())), pa.array(np.arange(1, order.size + 1, dtype=np.int32)), pa.array(who[order]), pa.array(score[order])], names=["query_id", "rank", "vec_id", "score"])

    # both sides are shuffled: Spark sizes the queries as before they are exploded to lists and segments, and would broadcast them
    near = segments.hint("merge").join(blocks.hint("merge"), ["list", "segment"]).select("original", "columns", "ids", "q_original", "q_turned", "queries").mapInArrow(compare, "query_id long, ids array<long>, scores array<double>")
    # a task's partial answers of a query are joined before the shuffle
    partial = near.mapInArrow(_joined(k), "query_id long, ids array<long>, scores array<double>")
    out = partial.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
    return scratch.finish(out)


def _joined(k: int):
    """Merges (query_id, ids, scores) rows within a task: at most k pairs a query leave it for each run of FLUSH rows."""

    def best(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        q = np.concatenate([np.repeat(np.asarray(b.column(0)), np.diff(np.asarray(b.column(1).offsets))) for b in rows])
        who, score = (np.concatenate([np.asarray(b.column(c).flatten()) for b in rows]) for c in (1, 2))
        order = np.lexsort((who, -score, q))
        q, who, score = q[order], who[order], score[order]
        owner, first = np.unique(q, return_index=True)
        top = np.arange(q.size) - np.repeat(first, np.diff(np.append(first, q.size))) < k
        q, who, score = q[top], who[top], score[top]
        lists = np.append(np.searchsorted(q, owner), q.size).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.ListArray.from_arrays(lists, pa.array(who)), pa.ListArray.from_arrays(lists, pa.array(score))], names=["query_id", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= FLUSH:
                    yield best(held)
                    held, n = [], 0
        if held:
            yield best(held)

    return run
