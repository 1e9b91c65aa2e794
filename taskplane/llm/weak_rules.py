"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust them.

The votes of one document make a pattern. All patterns of all documents are counted by Spark; there are at most
3**rules of them, whatever the number of documents, and the driver fits the model on these counts exactly. No vote is a veto:
what a bad vote says hangs on how often its rule votes bad on good text, which is learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, bound_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_digits")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC2:] = True  # the first byte of a character outside ASCII

#: Name, measure, bad from, good up to (bad below and good from, where the first is the smaller): fixed values.
RULES = (
    ("length", lambda c: c("n_words"), 9, 30),
    ("word_length", lambda c: F.abs(c("word_chars") / c("n_words") - 6.5), 4.5, 3.0),
    ("symbols", lambda c: c("n_symbols") / c("n_words"), 0.1, 0.03),
    ("dup_lines", lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), 0.5, 0.3),
    ("repeats", lambda c: c("n_repeat_words") / c("n_words"), 0.15, 0.05),
    ("capitals", lambda c: c("n_upper") / F.greatest(c("n_letters"), F.lit(1)), 0.3, 0.15),
    ("marks", lambda c: c("n_marks") / c("n_words"), 0.1, 0.03),
    ("variety", lambda c: c("n_distinct") / F.pow(c("n_words"), F.lit(0.75)), 0.5, 0.9),
    ("digits", lambda c: c("n_digits") / c("n_words"), 0.05, 0.01),
    ("lines", lambda c: c("n_words") / F.greatest(c("n_lines"), F.lit(1)), 12, 20),
    ("letters", lambda c: c("n_letters") / F.greatest(c("word_chars"), F.lit(1)), 0.9, 0.95),
)
#: Rules that many good texts break: they speak for or against a kind of junk that other rules find, and are never one's only finder.
HINTS = ("digits", "lines", "letters")

#: What the rules are taken to do on good text before any is seen: their rate of bad votes, and the votes that this belief weighs.
FALSE_ALARM, PRIOR = 0.001, 20.0
#: Bad votes that a rule should cast by chance on another kind of junk before that kind is asked alone; else all are asked together.
ENOUGH = 10


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of whole texts; see COUNTS."""
    data, offsets = K.flatten(column)
    out = {k: np.zeros(len(column), np.int64) for k in COUNTS}
    for i, j in K.pieces(offsets, 1 << 19):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        inside = ~K.SPACE[d]
        s, e = K.spans(inside, o)
        bounds = np.searchsorted(s, o)
        n = np.diff(bounds)
        doc = np.repeat(np.arange(j - i), n)
        out["n_words"][i:j] = n
        out["word_chars"][i:j] = K.per_document(inside & ((d & 0xC0) != 0x80), o)
        out["n_symbols"][i:j] = K.per_document(_SYMBOLS[d], o)
        out["n_upper"][i:j] = K.per_document(_UPPER[d], o)
        out["n_letters"][i:j] = K.per_document(_LETTER[d], o)
        out["n_marks"][i:j] = K.per_document(d == 33, o)
        out["n_digits"][i:j] = K.per_document(_DIGIT[d], o)
        ls, le = K.spans(d != 10, o)
        worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
        ls, le = ls[worded], le[worded]
        line_doc = np.searchsorted(o, ls, side="right") - 1
        salt = K.mix(np.arange(j - i, dtype=K.U64) + K.U64(1))
        lines = np.unique(K.hashes(d, ls, le) ^ salt[line_doc], return_index=True)[1]
        n_lines = np.bincount(line_doc, minlength=j - i)
        out["n_lines"][i:j] = n_lines
        out["n_dup_lines"][i:j] = n_lines - np.bincount(line_doc[lines], minlength=j - i)
        h = K.hashes(d, s, e)
        out["n_distinct"][i:j] = np.bincount(doc[np.unique(h ^ salt[doc], return_index=True)[1]], minlength=j - i)
        if h.size >= 5:
            w = K.windows(h, 5)
            at = doc[: w.size]
            whole = at == doc[4:]
            w = w ^ salt[at]
            w[~whole] = K.mix(np.flatnonzero(~whole).astype(K.U64) + K.U64(1 << 40))
            order = np.sort(w)
            again = order[1:][order[1:] == order[:-1]]
            if again.size:
                again = np.unique(again)
                at = np.minimum(np.searchsorted(again, w), again.size - 1)
                hit = np.flatnonzero((again[at] == w) & whole)
                cover = np.zeros(h.size + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + 5, -1)
                out["n_repeat_words"][i:j] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=j - i)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[k]) for k in COUNTS]], names=["doc_id", *COUNTS])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def vote(rule: tuple) -> Column:
    """-1 (bad), 0 (abstains) or 1 (good)."""
    _, value, bad, good = rule
    x = value(F.col)
    is_bad, is_good = (x >= bad, x <= good) if bad > good else (x <= bad, x >= good)
    return F.when(F.col("n_words") == 0, F.lit(0)).when(is_bad, F.lit(-1)).when(is_good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def kinds_of_junk(bad: np.ndarray, good: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], int, np.ndarray]:
    """The rules (masks) that find a kind of junk each, how many of these are shared, and the most that each rule may vote bad on good text.

    Rules whose bad votes meet at least twice as often as by chance, beyond noise, look for the same kind. Votes alone cannot
    tell a kind of junk that only these rules see from their false alarms on good text; what they do where other rules vote bad can: a
    rule is taken to vote bad on good text no oftener than on any kind of junk that others find. Rules that do so there less than half
    as often as elsewhere have a kind of their own; other linked rules share one; a rule that is neither finds none (unless there is
    no kind at all: then all rules share one). Nothing bounds those two.
    """
    n, voted = bad.shape[1], bad + good
    both, one, seen = (bad * counts[:, None]).T @ bad, (bad * counts[:, None]).T @ voted, (voted * counts[:, None]).T @ voted
    chance = one * one.T / np.maximum(seen, 1)
    linked = ((both > 2 * chance) & (both - chance > 3 * np.sqrt(chance + 1))) | np.eye(n, dtype=bool)
    for _ in range(n):
        linked = linked @ linked
    own, common, most = [], np.zeros(n, dtype=bool), np.ones(n)
    groups = np.unique(linked, axis=0)
    rate = lambda w, votes, of: (w @ votes + PRIOR * FALSE_ALARM) / (w @ of + PRIOR)
    for mine in groups:
        inside, outside = bad[:, mine].any(axis=1), bad[:, ~mine].any(axis=1)
        alone = rate(counts * ~outside, inside, np.ones(len(counts)))
        others = [counts * bad[:, g].any(axis=1) for g in groups if not (g & mine).any()]
        others = [w for w in others if alone * w.sum() >= ENOUGH] or [counts * outside]
        if outside.any() and alone > 2 * min(rate(w, inside, np.ones(len(counts))) for w in others):
            own.append(mine)
            most[mine] = np.min([rate(w, bad, voted)[mine] for w in others], axis=0)
        elif mine.sum() > 1:
            common |= mine
    if not own and not common.any():
        common[:] = True
    shared = [common] if common.any() else []
    return shared + own, len(shared), most


def _widened(values: np.ndarray, where: np.ndarray, rest: float) -> np.ndarray:
    out = np.full(where.size, rest, dtype=values.dtype)
    out[where] = values
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000, hints: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Posterior probability of good quality for each pattern, and the learned accuracies.

    One class for each kind of junk (``kinds_of_junk``) and one of good text; each rule that does not abstain votes by its
    own probabilities given the class, independently of the others; abstaining says nothing. Starts from "any bad vote is bad". A
    Beta prior of FALSE_ALARM with the weight of PRIOR votes, whatever the number of documents, says that a rule seldom votes
    bad on good text, so that false alarms are learned from the data. A kind of junk that only some rules see holds only texts on which
    one of them votes bad: how many more there are, votes cannot say. The rules of the mask ``hints`` have rates in every class like the
    others, but no kind is taken to exist for their votes alone. Add-one smoothing keeps every probability above 0.
    """
    bad, good = (patterns < 0).astype(float), (patterns > 0).astype(float)
    total, before = counts.sum(), -math.inf
    finds = np.ones(patterns.shape[1], dtype=bool) if hints is None else ~hints
    kinds, shared, limits = kinds_of_junk(bad[:, finds], good[:, finds], counts)
    kinds, most = [_widened(k, finds, False) for k in kinds], _widened(limits, finds, 1.0)
    hit = np.stack([bad[:, m].any(axis=1) for m in kinds]).astype(float)
    unseen = np.zeros((len(kinds) + 1, len(counts)), dtype=bool)
    unseen[shared:-1] = hit[shared:] == 0
    hits = hit.sum(axis=0)
    start = np.where(hits > 0, 0.9, 0.1) * np.where(hits > 0, hit / np.maximum(hits, 1), 1 / len(kinds))
    start[unseen[:-1]] = 0
    post = np.vstack([start, 1 - start.sum(axis=0)])  # kinds of junk, then good text
    weight = np.zeros((len(post), 1))
    weight[-1] = PRIOR
    wrong = prior = None
    for _ in range(rounds):
        w = counts * post
        votes_bad, votes = w @ bad, w @ (bad + good)
        wrong = (votes_bad + 1 + weight * FALSE_ALARM) / (votes + 2 + weight)  # class, rule: P(bad vote)
        wrong[-1] = np.minimum(wrong[-1], most)
        prior = (w.sum(axis=1) + 1) / (total + len(post))
        logs = np.log(prior)[:, None] + np.log(wrong) @ bad.T + np.log1p(-wrong) @ good.T
        logs[unseen] = -np.inf
        top = logs.max(axis=0)
        each = top + np.log(np.exp(logs - top).sum(axis=0))
        post = np.exp(logs - each)
        now = float((counts * each).sum())
        if abs(now - before) < 1e-9 * max(1.0, abs(now)):
            break
        before = now
    names = [r[0] for r in RULES[: patterns.shape[1]]]
    accuracy = prior[:-1] @ wrong[:-1] + prior[-1] * (1 - wrong[-1])
    return post[-1], {"prior_good": float(prior[-1]), "accuracy": dict(zip(names, accuracy.tolist())), "false_alarms": dict(zip(names, wrong[-1].tolist()))}


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, the measures, base_failed, quality and kept.

    ``base_failed``: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows. ``quality`` is the
    posterior probability of good quality given the rules' votes, ``kept`` is false where the base rules fail, else quality >=
    threshold. Null and empty texts have no words and fail; repeated rows and null doc_ids stay and count as
    documents of their own; an empty table gives an empty one; other columns are not read. Only counts of vote patterns (at most 3**11)
    reach the driver. The measures are written once to the shared folder, so that the two passes read texts once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "weak-rules")
    bound_batches(spark)
    votes = [f"v_{r[0]}" for r in RULES]
    measured = measure(docs).withColumns({v: vote(r) for v, r in zip(votes, RULES)})
    measured = scratch.write(measured, "measures")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measured.groupBy(*votes).count().collect()
    quality = F.lit(0.0)
    if rows:
        patterns = np.array([[r[v] for v in votes] for r in rows], dtype=np.int64)
        post, _ = fit(patterns, np.array([r["count"] for r in rows], dtype=float), hints=np.array([r[0] in HINTS for r in RULES]))
        model = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, post)], ", ".join(f"{v} tinyint" for v in votes) + ", quality double")
        measured = measured.join(F.broadcast(model), votes, "left")  # at most 3**11 rows
        quality = F.col("quality")
    return measured.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality"), *votes)
