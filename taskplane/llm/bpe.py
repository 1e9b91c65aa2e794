"""BPE encoding and decoding: merge ranks in a priority queue over a doubly linked list of symbols.

The vocabulary file (``tokenizers`` JSON, BPE with a word-end suffix) is a parameter and is read by the executors
once per Python worker. Distinct words are encoded once per task and kept in a bounded table. Texts with letters beyond the common
European ones are normalised and split by the vocabulary's own rules in its own library, whose Unicode tables are not Python's; the
merges are made here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from . import kernels as K
from .scratch import bound_batches

#: Texts of which no character has another form in NFC and all have the same class in every version of Unicode (fixed ranges): ASCII, Latin,
#: Greek and Cyrillic letters, dashes and quotation marks. No white space outside ASCII is among them.
_COMMON = re.compile("[\x00-\x7f\xa1-\u017e\u0388-\u038a\u038e-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027]*").fullmatch
#: Words kept by a task before its table starts anew.
CACHE_WORDS = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 256
    for b in printable:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """Encoder and decoder for a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab.update(self.special)
        self.strings = {i: s for s, i in self.vocab.items()}
        alphabet = byte_alphabet()
        self._inner = [self.vocab.get(c) for c in alphabet]
        self._final = [self.vocab.get(c + suffix) for c in alphabet]
        self._rank: dict[int, int] = {}
        self._left, self._right, self._made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._rank[self.vocab[a] << 32 | self.vocab[b]] = rank
            self._left.append(self.vocab[a])
            self._right.append(self.vocab[b])
            self._made.append(self.vocab[a + b])
        split = next(t for t in spec["pre_tokenizer"]["pretokenizers"] if t["type"] == "Split")
        self._common_words = regex.compile(split["pattern"]["Regex"]).findall
        self._split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"]).pre_tokenize_str
        self._normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._cache: dict[str, tuple[bytes, str]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word: the pair of least rank, leftmost first, is merged until no pair has a rank.

        A queue entry is stale when the symbols at its place are no longer the pair that it names.
        """
        ids = [self._inner[b] for b in data[:-1]]
        ids.append(self._final[data[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        rank, left, right, made = self._rank.get, self._left, self._right, self._made
        queue = []
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                queue.append(r << 40 | i)
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            r, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or ids[i] != left[r] or ids[j] != right[r]:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = rank(ids[i] << 32 | ids[k])
                if q is not None:
                    heapq.heappush(queue, q << 40 | i)
            h = before[i]
            if h >= 0:
                q = rank(ids[h] << 32 | ids[i])
                if q is not None:
                    heapq.heappush(queue, q << 40 | h)
        return [i for i in ids if i >= 0]

    def _miss(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word.encode("utf-8", "replace"))
        if len(self._cache) >= CACHE_WORDS:
            self._cache.clear()
        got = self._cache[word] = (struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids]))
        return got

    def words(self, text: str) -> list[str]:
        """The words whose symbols are merged: normalised, without the white space between them."""
        if text.isascii():
            return self._common_words(text.lower())
        if _COMMON(text):
            return self._common_words(text.replace("Σ", "σ").lower())  # each letter by itself, wherever it stands
        return [w for w, _ in self._split(self._normalise(text))]

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if "<|" in text and self._special_split:
            made = []
            for part in self._special_split(text):
                if part in self.special:
                    made.append((struct.pack("<I", self.special[part]), part))
                elif part:
                    made.append(self.both(part) if "<|" not in part else self._plain(part))
            made = [x for x in made if x[0]]
            return b"".join([x[0] for x in made]), " ".join([x[1] for x in made])
        return self._plain(text)

    def _plain(self, text: str) -> tuple[bytes, str]:
        get, miss = self._cache.get, self._miss
        got = [get(w) or miss(w) for w in self.words(text)]
        got = [x for x in got if x[0]]
        return b"".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.both(text)[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings one after the other; without a decoder the library puts a space between them."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (binary) and decoded (string).

    Every row gives one row: null and empty texts give no tokens; repeated rows stay repeated; null doc_ids pass
    through; other columns are not read, so their names cannot clash. Rows are independent, so that a long text costs
    time in proportion and a lost executor only its running tasks. The rows that come in decide the partitions.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")

    def coded(tok: WordBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b, ids, decoded = [], [], [], [], []
        for text in batch.column(1):
            i, d = tok.both(text.as_py() or "")
            n.append(len(i) // 4)
            a.append(hashlib.sha256(i).hexdigest())
            b.append(hashlib.sha256(d.encode()).hexdigest())
            if keep_ids:
                ids.append(i)
                decoded.append(d)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        try:
            for batch in batches:
                for part in K.slices(batch, 1):
                    yield coded(tok, part)
        finally:
            tok._cache.clear()  # a worker is used again by other tasks: it keeps the vocabulary, not the words

    bound_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)
