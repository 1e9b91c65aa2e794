"""Katz backoff language model: Good-Turing discounted counts and exactly normalised backoff weights.

Texts become blocks: a sorted vocabulary of 64-bit word hashes and token numbers into it. What a block needs to know
of the corpus it asks for, n-gram by n-gram, in one binary row for each owner partition; an owner merges the training
counts of all blocks, adds its part to the model's tables and answers each block in the order of its question. Rows that
Spark moves are few and large, their number grows with the input, and no task ever holds more than its share of the
distinct n-grams: an owner is chosen by the context's number, for contexts that are too frequent for that by the
whole n-gram.

Level 1 are words, level n are pairs of a context, which is the n-gram of level n - 1 that ends before a word, and the word. P(w | h) is
the discounted relative frequency if the pair was seen in training, else alpha(h) P(w | h'), where h' is the context of the level below;
P(w) in turn is the discounted relative frequency of a known word, else the mass that the discounts leave, which stands for all unknown
words as one class. Over the known words and that class each distribution sums to 1. All levels above the first are one
function of the level below, ``order`` times; what a level has asked is dropped before the next one asks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, shuffle_partitions

#: Counts above this are not discounted (Katz's k).
CUTOFF = 5
#: Bytes of text in a block, and distinct n-grams that an owner should get.
BLOCK_BYTES, OWNER_NGRAMS = 10 << 20, 3_000_000
#: Bytes of input in a bucket of blocks, which one task answers; Spark takes at most 100,000 buckets unless it is told otherwise.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
#: Contexts with more than this share of all tokens (at most as many as its inverse, and the beginning) are spread over owners.
HEAVY_SHARE = 1 / 65_536
END = K.U64(0xE0D0E0D0E0D0E0D1)
_BEGIN = np.uint64(0xFFFFFFFFFFFFFFFF)


def good_turing(n_r: np.ndarray) -> np.ndarray:
    """Discounts d_0..d_CUTOFF (d_0 unused) from the numbers n_0.. of n-grams seen r times (n_{CUTOFF + 1} included).

    Katz's formula where it gives values inside (0, 1); else, as on tiny or odd corpora, (r - D) / r with D = n1 / (n1 + 2 n2)
    kept within 0.1 and 0.9.
    """
    n = n_r.astype(float)
    r = np.arange(1, CUTOFF + 1)
    with np.errstate(all="ignore"):
        tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        d = ((r + 1) * n[2 : CUTOFF + 2] / n[1 : CUTOFF + 1] / r - tail) / (1 - tail)
        absolute = np.clip(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.1, 0.9)
    d = np.where(np.isfinite(d) & (d > 0) & (d < 1), d, (r - absolute) / r)
    return np.concatenate(([1.0], d))


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= CUTOFF, d[np.minimum(counts, CUTOFF)], 1.0)


@dataclass
class Unigrams:
    """Totals of level 1: tokens, distinct words, discounts, the mass of unknown words, texts."""

    tokens: int
    known: int
    d: np.ndarray
    unknown: float
    texts: int

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, discounted(counts, self.d) / self.tokens, self.unknown)


def block_rows(batch: pa.RecordBatch, block_bytes: int) -> Iterator[dict]:
    """Blocks of a batch (doc_id, text, trained)."""
    data, offsets = K.flatten(batch.column(1))
    trained = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
    for i, j in K.pieces(offsets, block_bytes):
        parts, counts = [], []
        for a, b in K.pieces(offsets[i : j + 1], 1 << 19):
            a, b = a + i, b + i
            d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            s, e = K.spans(~K.SPACE[d], o)
            bounds = np.searchsorted(s, o)
            n = np.diff(bounds) + 1
            h = np.full(s.size + b - a, END, dtype=K.U64)
            doc = np.repeat(np.arange(b - a), n - 1)
            h[np.arange(s.size) + doc] = K.hashes(d, s, e, lower=True)
            parts.append(h)
            counts.append(n)
        h, n = np.concatenate(parts), np.concatenate(counts)
        vocab, tokens = np.unique(h, return_inverse=True)
        of_training = np.repeat(trained[i:j], n)
        yield {
            "block": uuid.uuid4().int >> 65, "ids": batch.column(0).slice(i, j - i).to_pylist(), "trained": trained[i:j].tolist(), "lengths": n.astype(np.int64).tolist(),
            "vocab": _blob(vocab), "tokens": _blob(tokens.astype(np.uint32)), "counts": _blob(np.bincount(tokens[of_training], minlength=vocab.size).astype(np.uint32)),
            "n_tokens": int(h.size), "n_train": int(of_training.sum()), "n_texts": int(trained[i:j].sum()),
        }


BLOCK_SCHEMA = "block long, ids array<long>, trained array<boolean>, lengths array<long>, vocab binary, tokens binary, counts binary, n_tokens long, n_train long, n_texts long"
ANSWER_SCHEMA = "kind string, block long, part int, a binary, b binary, c binary, d binary, e binary"
_ANSWER = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])


def _blob(x: np.ndarray, ascending: bool = False) -> bytes:
    """Values as compressed byte planes; of ascending integers only the steps."""
    if ascending:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def _load(blob: pa.Scalar, kind: type, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if ascending else x


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2]


class KatzModel:
    """Training and scoring in one: ``texts`` (doc_id, text, trained) are all scored, the trained ones are counted.

    After ``score`` the model's tables stand in the shared folder: ``words`` (part, hashes, counts) and ``level-2`` to ``level-<order>``
    (kind 'model': part, contexts and words as numbers, counts), each partitioned by owner.
    """

    def __init__(self, spark: SparkSession, block_bytes: int | None = None, owner_ngrams: int | None = None, order: int = 2):
        """Blocks and owners take some 15 times block_bytes and 40 bytes an n-gram of a worker's memory. The rows that move number at
        most blocks x owners: with larger executors both should grow with the corpus."""
        if order < 1:
            raise ValueError("order is at least 1")
        self.spark, self.scratch, self.order = spark, Scratch(spark, "katz"), order
        self.block_bytes, self.owner_ngrams = block_bytes or BLOCK_BYTES, owner_ngrams or OWNER_NGRAMS
        self.unigrams: Unigrams | None = None

    # level 0: blocks ---------------------------------------------------------------------------------------------
    def _blocks(self, texts: DataFrame) -> DataFrame:
        """A table that is bucketed by block, so that joins with answers leave it where it is."""

        block_bytes, names = self.block_bytes, [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in pa.Table.from_batches(held).combine_chunks().to_batches():
                for row in block_rows(whole, block_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types)], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column(1).nbytes
                if size >= block_bytes:
                    yield from made(held)
                    held, size = [], 0
            if held:
                yield from made(held)

        self._table = f"katz_blocks_{uuid.uuid4().hex[:12]}"
        rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "trained").mapInArrow(run, BLOCK_SCHEMA)
        rows.write.bucketBy(self._buckets(texts), "block").option("path", self.scratch.location("blocks")).saveAsTable(self._table)
        return self.spark.table(self._table)

    def _buckets(self, texts: DataFrame) -> int:
        """Buckets of about BUCKET_BYTES of the input, by the planner's estimate of its size (the bytes of its files); what is not
        read from files has no estimate and gets the session's number of partitions."""
        size, least = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), shuffle_partitions(self.spark)
        return least if size >= 1 << 60 else min(max(least, -(-size // BUCKET_BYTES)), MOST_BUCKETS)

    # level 1: words ----------------------------------------------------------------------------------------------
    def _words(self, blocks: DataFrame) -> DataFrame:
        parts = self._parts

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, vocab, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    vocab, counts = _load(vocab, K.U64), _load(counts, np.uint32)
                    cut = np.searchsorted(_owner_of_hash(vocab, parts), np.arange(parts + 1))  # hashes are sorted, owners are ranges of them
                    own = [p for p in range(parts) if cut[p] < cut[p + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([block] * len(own), pa.int64()), pa.array([_blob(vocab[cut[p] : cut[p + 1]]) for p in own], pa.binary()), pa.array([_blob(counts[cut[p] : cut[p + 1]]) for p in own], pa.binary())], names=["part", "block", "vocab", "counts"])

        def merge(rows: pa.Table) -> pa.Table:
            part = rows["part"][0].as_py()
            hashes = [_load(v, K.U64) for v in rows["vocab"]]
            counts = np.concatenate([_load(v, np.uint32) for v in rows["counts"]])
            word, at = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(at, weights=counts, minlength=word.size).astype(np.int64)
            number = np.arange(word.size, dtype=K.U64) + (K.U64(part) << K.U64(32))  # in the order of the hashes
            out, i = [], 0
            for block, h in zip(rows["block"].to_pylist(), hashes):
                mine = at[i : i + h.size]
                out.append(("word", block, part, _blob(number[mine], True), _blob(total[mine]), None))
                i += h.size
            n_r = _counts_of_counts(total)
            out.append(("words", None, part, np.array([total.sum(), (total > 0).sum(), *n_r], dtype=np.int64).tobytes(), None, None))
            out.append(("model", None, part, _blob(word[total > 0], True), _blob(total[total > 0]), None))
            return pa.Table.from_pylist([dict(zip(_ANSWER.names, r)) for r in out], schema=_ANSWER)

        asked = blocks.select("block", "vocab", "counts").mapInArrow(ask, "part int, block long, vocab binary, counts binary")
        answers = self.scratch.write(asked.groupBy("part").applyInArrow(merge, ANSWER_SCHEMA), "words")
        sums = sum((np.frombuffer(r["a"], np.int64) for r in answers.where("kind = 'words'").select("a").collect()), np.zeros(CUTOFF + 4, np.int64))  # a row an owner
        tokens, known, n_r = int(sums[0]), int(sums[1]), sums[2:]
        d = good_turing(n_r)
        left = float((np.arange(1, CUTOFF + 1) * n_r[1 : CUTOFF + 1] * (1 - d[1:])).sum())
        if tokens and left <= 0:  # every word is frequent: one occurrence is kept for unknown ones
            tokens_, left = tokens + 1, 1.0
        else:
            tokens_ = tokens
        self.unigrams = Unigrams(tokens_, known, d, left / tokens_ if tokens_ else 1.0, self._texts)
        self.train_tokens = tokens
        return answers

    # level n: a context of level n - 1 and a word -------------------------------------------------------------------
    def _level(self, blocks: DataFrame, below: DataFrame, level: int) -> DataFrame:
        """Asks about the n-grams of a level, knowing the answers ``below`` it, and returns the answers."""
        parts, uni, heavy, more = self._parts, self.unigrams, self._heavy, level < self.order
        known = self._known()

        def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
            b = Block(block, answers, uni)
            for n in range(2, level):
                b.climb(n, answers, known)
            b.pairs()
            owner, order, cut = b.owners(known)
            rows = []
            for p in range(parts):
                mine = order[cut[p] : cut[p + 1]]
                if mine.size:
                    lower = _blob(b.pair_lower[mine].astype(np.uint32)) if level == 2 else _blob(b.pair_lower[mine])
                    rows.append((p, int(block["block"][0].as_py()), _blob(b.pair_context[mine], True), _blob(b.pair_word[mine]), lower, _blob(b.pair_count[mine].astype(np.uint32)), _blob((b.pair_context_count[mine] > heavy).astype(np.uint8))))
            names = ["part", "block", "context", "word", "lower", "count", "heavy"]
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        def merge(rows: pa.Table) -> pa.Table:
            part = rows["part"][0].as_py()
            get = lambda name, kind, ascending=False: [_load(v, kind, ascending) for v in rows[name]]
            contexts = get("context", K.U64, True)
            context, word = np.concatenate(contexts), np.concatenate(get("word", K.U64))
            order = np.lexsort((word, context))
            first = np.ones(order.size, bool)
            first[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
            at = np.empty(order.size, np.int64)
            at[order] = np.cumsum(first) - 1
            total = np.bincount(at, weights=np.concatenate(get("count", np.uint32)), minlength=int(first.sum())).astype(np.int64)
            context, word = context[order][first], word[order][first]
            lower = np.concatenate(get("lower", np.uint32 if level == 2 else np.float64))[order][first]
            is_heavy = np.concatenate(get("heavy", np.uint8))[order][first] > 0
            # of each context: how many words followed it r times, occurrences beyond the cutoff, lower P of all words seen after it
            h, where = np.unique(context, return_inverse=True)
            seen = total > 0
            stats = np.zeros((h.size, CUTOFF + 2))
            for r in range(1, CUTOFF + 1):
                stats[:, r - 1] = np.bincount(where[total == r], minlength=h.size)
            stats[:, CUTOFF] = np.bincount(where, weights=np.where(total > CUTOFF, total, 0), minlength=h.size)
            stats[:, CUTOFF + 1] = np.bincount(where[seen], weights=uni.probability(lower[seen].astype(np.int64)) if level == 2 else lower[seen], minlength=h.size)
            whole = ~stats[:, :CUTOFF].any(axis=1)  # contexts without a discounted follower
            number = np.arange(total.size, dtype=K.U64) + (K.U64(part) << K.U64(40))
            out, i, kind = [], 0, f"level-{level}"
            for block, c in zip(rows["block"].to_pylist(), contexts):
                mine = at[i : i + c.size]
                r = total[mine]
                asked = np.unique(where[mine[(r == 0) & ~is_heavy[mine]]])  # the contexts of its unseen pairs, ascending
                out.append((kind, block, part, _blob(r.astype(np.uint32)), _blob(stats[asked, :CUTOFF].astype(np.uint32).ravel()), _blob(stats[asked, CUTOFF:].ravel()), _blob(whole[where[mine[(r > CUTOFF) & ~is_heavy[mine]]]]), _blob(number[mine]) if more else None))
                i += c.size
            out.append(("counts", None, part, _counts_of_counts(total).astype(np.int64).tobytes(), None, None, None, None))
            top = np.zeros(h.size, bool)
            top[where[is_heavy]] = True
            if top.any():
                out.append(("heavy", None, part, _blob(h[top]), _blob(stats[top].ravel()), None, None, None))
            out.append(("model", None, part, _blob(context[seen], True), _blob(word[seen]), _blob(total[seen].astype(np.uint32)), None, None))
            return pa.Table.from_pylist([dict(zip(_ANSWER.names, r)) for r in out], schema=_ANSWER)

        schema = "part int, block long, context binary, word binary, lower binary, count binary, heavy binary"
        chosen = blocks.select("block", "trained", "lengths", "tokens")
        asked = chosen.groupBy("block").cogroup(below.groupBy("block")).applyInArrow(ask, schema)
        answers = self.scratch.write(asked.groupBy("part").applyInArrow(merge, ANSWER_SCHEMA), f"level-{level}")
        n_r = sum((np.frombuffer(r["a"], np.int64) for r in answers.where("kind = 'counts'").select("a").collect()), np.zeros(CUTOFF + 2, np.int64))  # a row an owner
        self.discounts[level] = good_turing(n_r)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, x in zip(batch.column(0), batch.column(1)):
                    x = _load(x, np.float64).reshape(-1, CUTOFF + 2)
                    yield pa.RecordBatch.from_arrays([pa.array(_load(h, K.U64).view(np.int64)), *[pa.array(c) for c in x.T]], names=names)

        names = ["h", *[f"s{k}" for k in range(CUTOFF + 2)]]
        tops = answers.where("kind = 'heavy'").select("a", "b").mapInArrow(unpack, "h long, " + ", ".join(f"{c} double" for c in names[1:]))
        rows = tops.groupBy("h").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()  # at most 1 / HEAVY_SHARE + 1 rows
        self.heavy_stats[level] = {r["h"] & 0xFFFFFFFFFFFFFFFF: np.array(r[1:]) for r in rows}
        return answers.where(F.col("kind") == f"level-{level}")

    def _known(self) -> Known:
        return Known(self._parts, self._heavy, dict(self.discounts), dict(self.heavy_stats))

    # scores ------------------------------------------------------------------------------------------------------
    def score(self, texts: DataFrame) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of texts."""
        blocks = self._blocks(texts)
        totals = blocks.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("n_texts")).first()
        self._texts = int(totals[2] or 0)
        self._parts = max(4, shuffle_partitions(self.spark), -(-int(totals[0] or 0) // self.owner_ngrams))
        self.discounts: dict[int, np.ndarray] = {}
        self.heavy_stats: dict[int, dict[int, np.ndarray]] = {}
        answers = self._words(blocks).where("kind = 'word'")
        self._heavy = max(1, self.train_tokens // (4 * self._parts), int(self.train_tokens * HEAVY_SHARE))
        for level in range(2, self.order + 1):
            answers = answers.union(self._level(blocks, answers, level))
            self.spark._jvm.System.gc()  # shuffle files of the level's questions go when the JVM finds that nothing names them
        uni, train, order, known = self.unigrams, self.train_tokens, self.order, self._known()

        def evaluate(block: pa.Table, answers: pa.Table) -> pa.Table:
            b = Block(block, answers, uni)
            for level in range(2, order + 1):
                b.climb(level, answers, known)
            logp = b.log_p[b.gram_of_token]
            count = b.token_count
            base = np.log10((count + 1) / (train + uni.known + 1))
            sums = lambda x: np.add.reduceat(x, b.starts) if b.starts.size else np.zeros(0)
            trained = np.array(block["trained"][0].as_py(), dtype=bool)
            return pa.table([pa.array(block["ids"][0].as_py(), pa.int64()), pa.array(~trained), pa.array(b.lengths), pa.array(sums((count > 0).astype(np.int64))), pa.array(np.full(b.lengths.size, train)), pa.array(sums(base)), pa.array(sums(logp))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        chosen = blocks.select("block", "ids", "trained", "lengths", "tokens")
        out = chosen.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        out = self.scratch.write(out, "scores")
        self.spark.sql(f"drop table {self._table}")
        self.scratch.drop("blocks")
        return out


def _owner_of_hash(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> K.U64(32)) * K.U64(parts)) >> K.U64(32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(a * K.U64(0x9E3779B97F4A7C15) + b)


def pair_scores(seen: np.ndarray, context_count: np.ndarray, lower: np.ndarray, stats: np.ndarray, whole: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 P(w | h), one step of the recursion: seen pairs are discounted, others back off to ``lower`` with alpha(h).

    stats has, for the contexts of unseen pairs, the numbers of followers by count, the occurrences of more frequent ones and the
    lower-order mass of all followers. A context that was never seen backs off with weight 1. One without any discounted
    follower (of seen pairs: ``whole``) gets a count more, which is the mass for its unseen words.
    """
    r = np.arange(1, CUTOFF + 1)
    kept = stats[:, :CUTOFF] @ (r * d[1:]) + stats[:, CUTOFF]
    total = stats[:, :CUTOFF] @ r + stats[:, CUTOFF]
    none = total <= kept
    with np.errstate(all="ignore"):
        alpha = np.where(none, 1 / (total + 1), 1 - kept / total) / np.maximum(1 - stats[:, CUTOFF + 1], 1e-300)
        unseen = np.log10(np.where(total > 0, alpha, 1.0)) + np.log10(lower)
        return np.where(seen > 0, np.log10(discounted(seen, d) / np.maximum(context_count + whole, 1)), unseen)


@dataclass
class Known:
    """What all blocks know of the levels: owners, the count from which a context is heavy, discounts, sums of heavy contexts."""

    parts: int
    heavy: int
    discounts: dict[int, np.ndarray]
    heavy_stats: dict[int, dict[int, np.ndarray]]


class Block:
    """A block with the answers of the levels so far: of its distinct n-grams the numbers, training counts and log10 probabilities, and
    the place of each token's n-gram among them."""

    def __init__(self, block: pa.Table, answers: pa.Table, uni: Unigrams):
        self.tokens = _load(block["tokens"][0], np.uint32).astype(np.int64)
        self.lengths = np.array(block["lengths"][0].as_py(), dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        word = sorted(((p, a, c) for k, p, a, c in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["a"], answers["b"]) if k == "word"), key=lambda x: x[0])
        self.word_number = np.concatenate([_load(a, K.U64, True) for _, a, _ in word])
        count = np.concatenate([_load(c, np.int64) for _, _, c in word])
        self.token_count, self.texts = count[self.tokens], uni.texts
        self.of_training = np.repeat(np.array(block["trained"][0].as_py(), dtype=bool), self.lengths)
        self.gram_of_token, self.number, self.count, self.lower = self.tokens, self.word_number, count, count
        self.log_p = np.log10(uni.probability(count))

    def pairs(self) -> None:
        """The n-grams of the next level: distinct pairs of a context (the beginning of a text is one of its own) and a word."""
        v = self.number.size
        context = np.empty(self.tokens.size, np.int64)
        context[1:] = self.gram_of_token[:-1]
        context[self.starts] = v
        words = self.word_number.size
        key, first, self.pair_of_token = np.unique(context * words + self.tokens, return_index=True, return_inverse=True)
        h, w = np.divmod(key, words)
        below = self.gram_of_token[first]  # the same word after the shorter context
        self.pair_context, self.pair_word = np.append(self.number, _BEGIN)[h], self.word_number[w]
        self.pair_context_count = np.append(self.count, self.texts)[h]
        self.pair_lower, self.pair_log_lower = self.lower[below], self.log_p[below]
        self.pair_count = np.bincount(self.pair_of_token[self.of_training], minlength=key.size)
        if (self.pair_context[1:] >= self.pair_context[:-1]).all():
            return
        order = np.lexsort((self.pair_word, self.pair_context))  # ascending numbers take less room in a question
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        self.pair_of_token = place[self.pair_of_token]
        for name in ("pair_context", "pair_word", "pair_context_count", "pair_lower", "pair_log_lower", "pair_count"):
            setattr(self, name, getattr(self, name)[order])

    def owners(self, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The owner of each pair, the pairs in the order of their owners, and where each owner begins."""
        parts = K.U64(known.parts)
        owner = np.where(self.pair_context_count > known.heavy, _mixed(self.pair_context, self.pair_word) % parts, _mixed(self.pair_context, self.pair_context) % parts).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        return owner, order, np.searchsorted(owner[order], np.arange(known.parts + 1))

    def climb(self, level: int, answers: pa.Table, known: Known) -> None:
        """From the n-grams of the level below to those of ``level``, with its answers."""
        self.pairs()
        owner, order, cut = self.owners(known)
        seen, stats, number = np.zeros(owner.size, np.int64), np.zeros((owner.size, CUTOFF + 2)), np.zeros(owner.size, K.U64)
        heavy_stats, is_heavy, whole = known.heavy_stats[level], self.pair_context_count > known.heavy, np.zeros(owner.size, bool)
        for kind, part, r, n, rest, flags, numbers in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), *(answers[c] for c in "abcde")):
            if kind == f"level-{level}":
                mine = order[cut[part] : cut[part + 1]]
                seen[mine] = _load(r, np.uint32)
                unseen = mine[(seen[mine] == 0) & ~is_heavy[mine]]
                at = np.unique(self.pair_context[unseen], return_inverse=True)[1]
                stats[unseen] = np.hstack([_load(n, np.uint32).reshape(-1, CUTOFF), _load(rest, np.float64).reshape(-1, 2)])[at]
                whole[mine[(seen[mine] > CUTOFF) & ~is_heavy[mine]]] = _load(flags, np.bool_)
                if numbers.is_valid:
                    number[mine] = _load(numbers, K.U64)
        top = np.flatnonzero((seen > CUTOFF) & is_heavy)
        tops, at = np.unique(self.pair_context[top], return_inverse=True)
        whole[top] = np.array([not heavy_stats[h][:CUTOFF].any() for h in tops.tolist()], bool)[at]
        for i in np.flatnonzero((seen == 0) & is_heavy):
            stats[i] = heavy_stats.get(int(self.pair_context[i]), 0)
        self.log_p = pair_scores(seen, self.pair_context_count, 10.0**self.pair_log_lower, stats, whole, known.discounts[level])
        self.gram_of_token, self.number, self.count, self.lower = self.pair_of_token, number, seen, 10.0**self.log_p


def score_texts(docs: DataFrame, learn_from, order: int = 2) -> DataFrame:
    """One row for each row of docs (doc_id, text); ``learn_from`` is the condition on doc_id for training, ``order`` the longest n-gram.

    Null and empty texts are one token, the end. Repeated rows count and are scored each, null doc_ids are scored and
    learned from if the condition says so (a null condition: no). Without training texts all words are unknown. An empty table
    gives an empty one; other columns are not read. A long text is part of a block of its own and is never cut.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn_from(F.col("doc_id")), F.lit(False)).alias("trained"))
    return KatzModel(docs.sparkSession, order=order).score(texts)
