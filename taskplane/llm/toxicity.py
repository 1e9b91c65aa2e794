"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities, proximity to the second person, capitals, punctuation and obfuscation rates. The
lexicon, the trees and the calibration are learned here from a bounded sample of labelled rows, in folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, bound_batches

#: The most labelled rows that are learned from (the least by a hash of doc_id), and the most lexicon entries.
SAMPLE_ROWS, LEXICON_ENTRIES = 24_000, 8192
#: Tree ensemble: trees, depth, learning rate, bins of a feature, least rows of a leaf.
TREES, DEPTH, RATE, BINS, LEAF = 60, 4, 0.15, 32, 8
#: Folds of the sample, and what an entry of the lexicon needs: toxic documents with it, log-odds.
FOLDS, LEAST_TOXIC, LEAST_ODDS = 5, 3, 3.0

FEATURES = (
    "log_words", "word_density", "stem_density", "word_hits", "stem_hits", "weight_density", "max_weight", "second_person",
    "near_second_person", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "obfuscated", "folded_hits",
)
#: Second-person words: fixed values.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "euch", "ti", "vos", "usted", "ustedes")
#: Characters that stand for letters in obfuscated words: fixed values.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
STEMS = (4, 5, 6)
NEAR = 5

_FOLD = K.LOWER.copy()
for _a, _b in LEET.items():
    _FOLD[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STANDS = np.zeros(256, dtype=bool)
_STANDS[[ord(c) for c in LEET]] = True
_IN_WORD = _LETTER | _STANDS
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    raw = _FOLD[np.frombuffer(b"".join(data), np.uint8)]
    return np.sort(K.hashes(raw, ends - [len(w) for w in data], ends))


_YOU = _hash_of(SECOND_PERSON)


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not table.size or not values.size:
        return np.zeros(values.size, dtype=bool)
    at = np.minimum(np.searchsorted(table, values), table.size - 1)
    return table[at] == values


@dataclass
class Text:
    """Words of a run of documents: their documents, folded hashes, stems by length, and whether they mix letters with
    characters that stand for letters."""

    offsets: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    mixed: np.ndarray
    stems: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, Text]]:
    data, offsets = K.flatten(column)
    for i, j in K.pieces(offsets, 1 << 19):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e = K.spans(_IN_WORD[d], o)
        doc = np.searchsorted(o, s, side="right") - 1
        folded = _FOLD[d]
        letters = np.concatenate(([0], np.cumsum(_LETTER[d], dtype=np.int32)))
        n_letters = letters[e] - letters[s]
        t = Text(o, d, s, e, doc, K.hashes(folded, s, e), (n_letters > 0) & (n_letters < e - s))
        for k in STEMS:
            long = np.flatnonzero(e - s > k)
            t.stems[k] = long, K.hashes(folded, s[long], s[long] + k) ^ K.U64(k)
        yield i, j, t


def evidence(column: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and stems of a batch, and how many toxic and clean documents have each."""
    got = []
    for i, j, t in _texts(column):
        for where, h in ((slice(None), t.word), *t.stems.values()):
            doc = t.doc[where]
            salt = K.mix(np.arange(j - i, dtype=K.U64) + K.U64(1))
            first = np.unique(h ^ salt[doc], return_index=True)[1]
            got.append((h[first], labels[i:j][doc[first]]))
    if not got:
        return np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, y = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    key, at = np.unique(h, return_inverse=True)
    toxic = np.bincount(at, weights=y, minlength=key.size).astype(np.int64)
    return key, toxic, np.bincount(at, minlength=key.size) - toxic


def features(column: pa.Array, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """FEATURES of whole texts; zeros for texts without words."""
    out = np.zeros((len(column), len(FEATURES)), dtype=np.float64)
    for i, j, t in _texts(column):
        m = j - i
        n = np.bincount(t.doc, minlength=m).astype(float)
        per = np.maximum(n, 1.0)
        sums = lambda w, m=m, t=t: np.bincount(t.doc, weights=w, minlength=m)
        weight = np.zeros(t.word.size)
        word = _isin(t.word, lexicon)
        if word.any():
            weight[word] = weights[np.searchsorted(lexicon, t.word[word])]
        stem = np.zeros(t.word.size, dtype=bool)
        for where, h in t.stems.values():
            hit = _isin(h, lexicon)
            stem[where[hit]] = True
            weight[where[hit]] = np.maximum(weight[where[hit]], weights[np.searchsorted(lexicon, h[hit])])
        you = _isin(t.word, _YOU)
        any_hit, near = word | stem, np.zeros(t.word.size, dtype=bool)
        for k in range(1, NEAR + 1):
            if t.word.size > k:
                same = t.doc[k:] == t.doc[:-k]
                near[k:] |= any_hit[k:] & you[:-k] & same
                near[:-k] |= any_hit[:-k] & you[k:] & same
        upper = np.concatenate(([0], np.cumsum(_UPPER[t.data], dtype=np.int32)))
        shouted = (upper[t.ends] - upper[t.starts] == t.ends - t.starts) & (t.ends - t.starts > 1)
        letters = np.maximum(K.per_document(_LETTER[t.data], t.offsets), 1)
        top = np.zeros(m)
        np.maximum.at(top, t.doc, weight)
        chars = np.maximum(np.diff(t.offsets), 1)
        out[i:j] = np.stack(
            [np.log1p(n), sums(word) / per, sums(stem) / per, np.log1p(sums(word)), np.log1p(sums(stem)), sums(weight) / per, top, sums(you) / per,
             sums(near) / per, K.per_document(_UPPER[t.data], t.offsets) / letters, sums(shouted) / per, K.per_document(t.data == 33, t.offsets) / per,
             K.per_document(t.data == 63, t.offsets) / per, K.per_document(_PUNCT[t.data], t.offsets) / chars, sums(t.mixed) / per, sums(any_hit & t.mixed) / per],
            axis=1,
        )
    return out


@dataclass
class Model:
    """Trees as arrays over complete binary trees, and the calibration's steps."""

    lexicon: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    split_feature: np.ndarray
    split_bin: np.ndarray
    leaf: np.ndarray
    bias: float
    margins: np.ndarray
    levels: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], side="right") for k in range(x.shape[1])], axis=1) if x.size else np.zeros(x.shape, int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self.bins(x), np.arange(len(x)), np.full(len(x), self.bias)
        for f, c, v in zip(self.split_feature, self.split_bin, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.margins, self.levels) if len(x) else np.zeros(0)


def boost(x: np.ndarray, y: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> Model:
    """Newton boosting of the logistic loss on histograms; splits that do not help send all rows to the left."""
    n, m = x.shape
    edges = np.stack([_edges(x[:, k]) for k in range(m)])
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Model(lexicon, weights, edges, np.zeros((TREES, 2**DEPTH - 1), int), np.full((TREES, 2**DEPTH - 1), BINS), np.zeros((TREES, 2**DEPTH)), float(np.log(rate / (1 - rate))), np.zeros(1), np.full(1, rate))
    b, margin = model.bins(x), np.full(n, model.bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = p - y, np.maximum(p * (1 - p), 1e-6), np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            node = at - first
            best, choice = np.full(nodes, 1e-6), np.zeros((nodes, 2), int)
            choice[:, 1] = BINS
            for k in range(m):
                cell = node * (BINS + 1) + b[:, k]
                sg, sh, sc = (np.bincount(cell, weights=w, minlength=nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1) for w in (g, h, np.ones(n)))
                tg, th, tc = sg[:, -1:], sh[:, -1:], sc[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sc < LEAF) | (tc - sc < LEAF)] = 0
                j = gain.argmax(axis=1)
                top = gain[np.arange(nodes), j]
                better = top > best
                best[better], choice[better, 0], choice[better, 1] = top[better], k, j[better]
            model.split_feature[t, first : first + nodes] = choice[:, 0]
            model.split_bin[t, first : first + nodes] = choice[:, 1]
            at = 2 * at + 1 + (b[np.arange(n), choice[node, 0]] > choice[node, 1])
        leaf = at - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        model.leaf[t] = value
        margin += value[leaf]
    return model


def _edges(values: np.ndarray) -> np.ndarray:
    """BINS cuts of a feature; repeated quantiles are spread over the distinct values, unused cuts are infinite."""
    cuts = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, BINS // 2)), np.quantile(values[values > values.min()], np.linspace(0, 1, BINS // 2)) if (values > values.min()).any() else []]))
    out = np.full(BINS, np.inf)
    out[: min(BINS, cuts.size)] = cuts[:BINS]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins and non-decreasing probabilities between which ``score`` interpolates. Each block's rate
    counts one clean and one toxic half row more, so that none is exactly 0 or 1."""
    if not len(y):
        return np.array([-4.0, 4.0]), np.array([0.018, 0.982])
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t in zip(margin[order], y[order]):
        blocks.append([float(t), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = hi
    level = np.maximum.accumulate([(s + 0.5) / (c + 1) for s, c, _, _ in blocks])
    x = np.array([v for blk in blocks for v in (blk[2], blk[3])])
    return x, np.repeat(level, 2)


def _lexicon(h: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of the words and stems that mark toxic documents."""
    w = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    keep = (toxic >= LEAST_TOXIC) & (w > LEAST_ODDS)
    order = np.argsort(h[keep])
    return h[keep][order], w[keep][order]


def learn(labelled: DataFrame) -> Model | None:
    """A model from (text, toxic, __fold); None without rows of both classes.

    The lexicon that describes a row comes from the other folds, so that its densities mean the same as on new texts; the last fold
    calibrates what the trees learned from the others. New texts are described with the lexicon of all folds.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, fold = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=float), batch.column(2).to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                rows = np.flatnonzero(fold == f)
                h, a, b = evidence(batch.column(0).take(pa.array(rows)), y[rows])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(h.size, f, np.int32)), pa.array(a), pa.array(b)], names=["h", "f", "a", "b"])

    classes = np.zeros((FOLDS, 2))
    for r in labelled.groupBy("__fold", "toxic").count().collect():
        classes[r["__fold"], r["toxic"]] = r["count"]
    if not classes[:-1].sum(axis=0).all():
        return None
    each = [F.sum(F.when(F.col("f") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "ab" for f in range(FOLDS)]
    counted = labelled.select("text", "toxic", "__fold").mapInArrow(words, "h long, f int, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *each)
    odds = F.log((F.col("a") + 0.5) / (classes[:, 1].sum() + 1)) - F.log((F.col("b") + 0.5) / (classes[:, 0].sum() + 1))
    top = counted.where((F.col("a") >= LEAST_TOXIC) & (odds > LEAST_ODDS)).orderBy(F.desc("a"), "h").limit(LEXICON_ENTRIES).collect()
    h = np.array([r["h"] for r in top], dtype=np.int64).view(K.U64)
    seen = np.array([[[r[f"{c}{f}"] for f in range(FOLDS)] for c in "ab"] for r in top], dtype=float).reshape(-1, 2, FOLDS)
    without = [_lexicon(h, *(seen.sum(axis=2) - seen[:, :, f]).T, *(classes.sum(axis=0) - classes[f])[::-1]) for f in range(FOLDS)]
    lexicon, weights = _lexicon(h, *seen.sum(axis=2).T, *classes.sum(axis=0)[::-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                at = pa.array(np.flatnonzero(fold == f))
                x = features(batch.column(0).take(at), *without[f])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    got = labelled.select("text", "toxic", "__fold").mapInArrow(rows, "toxic int, fold int, x array<double>").toArrow()
    fold, y = got["fold"].to_numpy(), got["toxic"].to_numpy().astype(float)
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, y, fold])  # the order of rows must not change the sums
    fold, x, y = fold[order], x[order], y[order]
    model = boost(x[fold < FOLDS - 1], y[fold < FOLDS - 1], lexicon, weights)
    model.margins, model.levels = isotonic(model.margin(x[fold == FOLDS - 1]), y[fold == FOLDS - 1])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, score (0 to 1) and predicted (score >= threshold); with ``keep``, these
    columns of docs, ``__score`` and ``__predicted`` (with more underscores where docs has such columns; they are the last two).

    ``labels`` has (doc_id, toxic); ``learn_from`` maps its doc_id column to the condition for learning from a row. Of these at
    most ``sample_rows`` are used, the least by a hash of doc_id; a doc_id with several labels counts as toxic if one says so, one with
    several rows gives one of them (the least by a hash of the text); null labels and doc_ids are left out. Only the text is an input of the score. Null and empty texts have zero features and get
    the score of such a row; without rows of both classes every score is the share of toxic ones (0 without rows).
    Repeated rows and null doc_ids stay, an empty table gives an empty one, other columns are not read. The scan of docs that
    scores is the only one that keeps nothing back; the sample is written once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    bound_batches(spark)
    usable = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)")
    usable = usable.where(learn_from(F.col("__id"))).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)  # bounded, so that it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    one = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    labelled = one.select(F.col("__id").alias("doc_id"), "text", "toxic", F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(FOLDS)).cast("int").alias("__fold"))
    labelled = scratch.write(labelled, "sample")
    model = learn(labelled)
    rate = 0.0 if model else float(labelled.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])

    kept, score_name, predicted_name = (["doc_id"], "score", "predicted") if keep is None else (keep, "__score", "__predicted")
    while keep and {score_name, predicted_name} & {c.lower() for c in keep}:
        score_name, predicted_name = f"_{score_name}", f"_{predicted_name}"
    rows = docs.select(F.col("text").alias("__text"), *([F.col("doc_id").cast("long").alias("doc_id")] if keep is None else [F.col(f"`{c}`") for c in keep]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 0):
                s = model.score(features(part.column(0), model.lexicon, model.weights)) if model else np.full(part.num_rows, rate)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*kept, score_name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(score, f"{schema}, {score_name} double")
    scratch.drop("sample")
    return out.withColumn(predicted_name, (F.col(score_name) >= threshold).cast("int"))
