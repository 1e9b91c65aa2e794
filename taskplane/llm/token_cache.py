"""Token counts through a digest cache: only distinct contents that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, bound_batches

_models: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer: its file's bytes and the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    h = hashlib.sha256(library.encode())
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Token counts as the file's library gives them, without added, begin or end tokens."""
    if path not in _models:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _models[path] = lambda xs: [len(t.encode(x, add_special_tokens=False).ids) for x in xs]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda xs: [len(p.encode(x)) for x in xs]
    return _models[path](texts)


class TokenCountCache:
    """A Parquet folder ``tokenizer=<version>/`` of (digest, n_tokens). Rows are only ever appended."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: str) -> str:
        return f"{self.folder}/tokenizer={version}"

    def read(self, version: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(version))
        schema = "digest binary, n_tokens long"
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(version))

    def append(self, counted: DataFrame, version: str) -> None:
        counted.write.mode("append").parquet(self._path(version))


def normalised(text):
    """The content that the digest is taken of. Both libraries treat a null as nothing to encode and neither drops or
    folds anything before its own rules, so that only null and empty are one content; equal digests have equal counts."""
    return F.coalesce(text, F.lit(""))


def count_tokens(docs: DataFrame, tokenizer: str, cache: TokenCountCache, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    Contents are reduced to one text a digest before the shuffle (a hot text leaves each task once), those in the cache
    drop out, the rest is encoded once and appended. Documents meet their counts on the digest as narrow rows; a
    digest that many documents share is split by the adaptive join, whose other side has one row a digest. Null and empty
    texts have 0 bytes and the count of the empty string; repeated rows and null doc_ids stay; an empty table
    gives an empty one; other columns are not read. A run that dies between encoding and appending leaves the
    cache as it was or with whole files; the same digest twice (two runs at once) is taken once.
    """
    version = tokenizer_version(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                counts = count_texts(tokenizer, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    bound_batches(docs.sparkSession)
    text = normalised(docs["text"])
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    distinct = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(cache.read(version).select("digest"), "digest", "left_anti")
    cache.append(misses.mapInArrow(encode, "digest binary, n_tokens long"), version)
    counts = cache.read(version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = Scratch(docs.sparkSession, "token-counts").write(counts, "counts")  # the adaptive join splits a hot digest only between scans
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    out = narrow.join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
