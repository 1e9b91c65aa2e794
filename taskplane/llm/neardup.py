"""Near-duplicate groups by a signature-coordinate inverted join.

Each distinct shingle set has a MinHash signature and is posted under every coordinate-value pair. Skipped before anything is
compared: pairs that only one set has, sets that are left with fewer postings than the match threshold, all but the rarest
postings of a set (two sets that agree in at least MATCHES coordinates share one of the first m - MATCHES + 1 of either's m
postings in any common order, rarest first), and posting lists that hold the same sets as another list. What is left is
merged list by list: collisions of two sets of a list are counted over whole signatures, in the first list that both stand in,
and pairs with at least MATCHES are confirmed there on the whole shingle sets.

Only links that join what a list has not joined yet leave it, so that no list gives all its pairs. A list that is too long for one
task is cut into blocks. A first round compares each block with itself and with the first one; a second one compares the other
pairs of blocks, and only sets of different groups of the first round, in lists that still hold several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .scratch import Scratch, bound_batches, shuffle_partitions

#: Coordinates of a signature, and collisions from which a pair is kept: at a similarity of 0.8 a pair has fewer with probability 2e-7.
COORDINATES, MATCHES = 40, 18
#: Sets of a posting list, and shingles in them, that one task compares with as many others; longer lists are cut into blocks.
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000
#: Ids that may be broadcast.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(777)
_XOR = _rng.integers(0, 2**63, size=COORDINATES, dtype=np.int64).astype(K.U64)
_MUL = _rng.integers(0, 2**63, size=COORDINATES, dtype=np.int64).astype(K.U64) * K.U64(2) + K.U64(1)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each text) in runs of texts; A-Z in lower case, empty for no words."""
    data, offsets = K.flatten(column)
    for i, j in K.pieces(offsets, 1 << 19):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e = K.spans(~K.SPACE[d], o)
        yield i, K.shingles(K.hashes(d, s, e, lower=True), np.searchsorted(s, o), n)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) minima of keyed hashes; each value holds its coordinate in the top byte. Sets are not empty."""
    out = np.empty((len(sets), COORDINATES), dtype=K.U64)
    if sets:
        flat = np.concatenate(sets)
        at = np.concatenate(([0], np.cumsum([s.size for s in sets])[:-1]))
        for k in range(COORDINATES):
            out[:, k] = (np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at) >> K.U64(8)) | K.U64(k << 56)
    return out


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (16 bytes of the whole set; null if empty), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            size, digest, sig = [], [], []
            for _, sets in shingle_sets(batch.column(1), n):
                size += [s.size for s in sets]
                digest += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
                rows = iter(signatures([s for s in sets if s.size]).view(np.int64))
                sig += [next(rows) if s.size else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<long>")


def collisions(sig: np.ndarray) -> np.ndarray:
    """(sets, sets) numbers of coordinates in which two signatures agree."""
    out = np.zeros((len(sig), len(sig)), dtype=np.int8)
    for k in range(sig.shape[1]):
        out += sig[:, k, None] == sig[None, :, k]
    return out


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int, groups: np.ndarray | None = None, met: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (where side is not negative: of those between sets of different sides).

    Collisions are counted on signatures. The pairs kept are confirmed on the whole sets, most collisions first, and a pair
    whose ends are already joined is skipped: it cannot change the groups. Sets of one group are joined from the start, pairs that
    have met elsewhere are left out. Where many pairs are left, intersections are counted for all of them at once.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([s.size for s in sets])
    weight = collisions(signatures(sets))
    small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    skip = (weight < MATCHES) | (100 * small < percent * large) | ((side[:, None] == side) & (side >= 0))
    if groups is not None:
        skip |= groups[:, None] == groups
    if met is not None:
        skip |= met
    weight[skip] = 0
    a, b = np.nonzero(np.triu(weight, 1))
    if not a.size:
        return []
    order = np.argsort(-weight[a, b], kind="stable")
    a, b = a[order], b[order]
    forest, links = _Forest(n), []
    if groups is not None:
        first: dict[int, int] = {}
        for i, g in enumerate(groups.tolist()):
            forest.join(first.setdefault(g, i), i)
    if a.size > 8 * n:
        shared = _intersections(sets)
        both = shared[a, b].astype(np.int64)
        keep = 100 * both >= percent * (sizes[a] + sizes[b] - both)
        return [(i, j) for i, j in zip(a[keep].tolist(), b[keep].tolist()) if forest.join(i, j)]
    for i, j in zip(a.tolist(), b.tolist()):
        if forest.find(i) != forest.find(j):
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                forest.join(i, j)
                links.append((i, j))
    return links


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: shingles in slices, each slice a product of 0/1 matrices (exact in 32 bits)."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [s.size for s in sets])
    value, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out, step = np.zeros((len(sets), len(sets)), dtype=np.float32), 4096
    for lo in range(0, int(at[-1]) + 1 if at.size else 0, step):
        a, b = np.searchsorted(at, [lo, lo + step])
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[row[a:b], at[a:b] - lo] = 1
        out += m @ m.T
    return out


def met_before(posting: int, lists: list[np.ndarray]) -> np.ndarray | None:
    """Which pairs stand together in a list before this one; None if none does."""
    earlier = [x[x < posting] for x in lists]
    row, value = np.repeat(np.arange(len(lists)), [x.size for x in earlier]), np.concatenate(earlier)
    _, at, count = np.unique(value, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    if not keep.any():
        return None
    row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
    m = np.zeros((len(lists), int(at.max()) + 1), dtype=np.float32)
    m[row, at] = 1
    return (m @ m.T) > 0


def _links_of(units: DataFrame, percent: int) -> DataFrame:
    """(u, v) of units (posting, i, j, side, id, grp, lists, set): one streamed pass, a unit at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if rows.num_rows > 1:
                ids = rows["id"].to_numpy()
                sets = [np.frombuffer(s.as_py(), K.U64) for s in rows["set"]]
                met = met_before(rows["posting"][0].as_py(), [np.asarray(x.values) for x in rows["lists"]])
                found = linked(sets, rows["side"].to_numpy(), percent, rows["grp"].to_numpy(), met)
                if found:
                    a, b = ids[np.array(found)].T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        key = None
        for batch in batches:
            start = 0
            for at, k in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if k != key:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    if held:
                        yield from flush()
                    key, start = k, at
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield from flush()

    ordered = units.repartition(shuffle_partitions(units.sparkSession), "posting", "i", "j").sortWithinPartitions("posting", "i", "j", "id")
    return ordered.select("posting", "i", "j", "side", "id", "grp", "lists", "set").mapInArrow(run, "u long, v long")


def whole_sets(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, set) of the texts (id, text) whose id is in ``ids`` (a written table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                sets = [s.tobytes() for _, run in shingle_sets(part.column(1), n) for s in run]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(chosen, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, set binary").where(F.length("set") > 0)


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id.

    Two documents are linked where 100 x intersection >= percent x union of their sets of n-word shingles (A-Z lower-cased;
    the whole sequence where there are fewer words). component_id is the smallest doc_id reachable by links, kept marks that
    document, class_id is the smallest doc_id with the same set. Null, empty and blank texts have an empty set, are linked
    with nothing and are kept. Rows that share a doc_id are one document with the links of each; a null doc_id is linked with
    nothing, has a null component and is kept. Exact copies count as one set from the start. An empty table gives an
    empty one; other columns are not read. No cap on partners or postings: postings are skipped only where the prefix or
    an equal list proves that another one finds the same partners, pairs only where another list or a group holds both already.
    """
    spark = docs.sparkSession
    scratch, partitions = Scratch(spark, "near-duplicates"), shuffle_partitions(spark)
    bound_batches(spark)
    all_docs = scratch.write(describe(docs, n), "documents")
    usable = all_docs.where("digest is not null and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = scratch.write(classes, "classes")
    postings = classes.select("digest", "n_shingles", F.explode("signature").alias("posting"))
    # what meets a side with hot keys is written first: the adaptive join splits a hot key only between scans
    shared = scratch.write(postings.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    kept = postings.join(shared, "posting").groupBy("digest", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "posting"))).alias("p")).where(F.size("p") >= MATCHES)
    prefix = kept.select("digest", "n_shingles", F.explode(F.slice("p", F.lit(1), F.size("p") - MATCHES + 1)).alias("e")).select("digest", "n_shingles", F.col("e.posting").alias("posting"))
    prefix = scratch.write(prefix, "prefix")
    # lists of the same sets are one list: their number and two 64-bit digests of the sets agree
    same = [F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"d{k}") for k in range(2)]
    lists = prefix.groupBy("posting").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), *same).where("n > 1")
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    lists = scratch.write(lists.groupBy("n", "shingles", "d0", "d1").agg(F.min("posting").alias("posting")).select("posting", n_blocks), "lists")
    listed = prefix.join(lists, "posting").groupBy("digest").agg(F.sort_array(F.collect_list("posting")).alias("lists"), F.collect_list(F.struct("posting", "n_blocks")).alias("l"))
    members = listed.join(classes.select("digest", F.col("class_id").alias("id")), "digest").select(F.explode("l").alias("l"), "id", "lists", "digest")
    block = F.pmod(F.xxhash64("digest", F.lit(2)), F.col("l.n_blocks").cast("long")).cast("int").alias("block")
    members = scratch.write(members.select("l.posting", "l.n_blocks", block, "id", "lists"), "members")
    scratch.drop("shared", "prefix", "lists")
    ids = scratch.write(members.select("id").distinct(), "ids")
    sets = scratch.write(whole_sets(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, n), "sets")
    # first round: each block with itself and with the first block
    last = F.col("n_blocks") - 1
    units = members.withColumn("j", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), last)).otherwise(F.array("block")))).withColumns({"i": F.lit(0), "side": F.when((F.col("block") == 0) & (F.col("j") > 0), F.lit(0)).otherwise(F.lit(-1)), "grp": F.col("id")})
    first = scratch.write(components(_links_of(units.join(sets, "id"), percent), scratch, "first-groups"), "first-nodes")
    # second round: sets of different groups in the other pairs of blocks
    grouped = members.where("n_blocks > 1").join(first.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("grp", F.coalesce("component", "id")).drop("component")
    open_ = scratch.write(grouped.groupBy("posting").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a < b").select("posting"), "open")
    units = grouped.where("block > 0").join(open_, "posting").withColumn("other", F.explode(F.sequence(F.lit(1), last))).where("other <> block")
    units = units.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": F.col("block")})
    links = spark.createDataFrame([], "u long, v long") if open_.isEmpty() else _links_of(units.join(sets, "id"), percent)
    # rows that share a doc_id but not a text: the document joins its classes
    doc_class = usable.join(classes.select("digest", "class_id"), "digest").select("doc_id", "class_id")
    twice = usable.groupBy("doc_id").agg(F.count_distinct("digest").alias("sets")).where("sets > 1").select("doc_id")
    links = links.union(doc_class.join(twice, "doc_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")))
    named = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    between = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("u_", "u").alias("u"), F.coalesce("v_", "v").alias("v"))
    second = scratch.write(components(between, scratch, "second-groups"), "second-nodes").select(F.col("node").alias("component"), F.col("component").alias("final"))
    merged = first.join(second, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    alone = second.join(first, second["component"] == first["node"], "left_anti").select(F.col("component").alias("node"), F.col("final").alias("component"))
    groups = scratch.write(merged.union(alone), "groups")
    out = all_docs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes.select("digest", "class_id"), "digest", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id")).join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "class_id")
    return scratch.finish(out)
