"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256, ids and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskplane.llm.bpe import encode_documents
from taskplane.llm.mixing import materialise
from taskplane.llm.neardup import near_duplicates
from taskplane.llm.queries import held_out, table
from taskplane.llm.scratch import Scratch
from taskplane.llm.surrogates import replace_entities
from taskplane.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least 0.7 go. Null and empty texts have zero features and stay, as do repeated rows and
    null doc_ids that are not toxic; an empty table stays empty; columns may have any names."""
    labels = table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, lambda doc_id: ~held_out(doc_id, 3, 1), keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, in one row if the id repeats (the least by a hash of its
    columns). Null doc_ids are no duplicates of anything: their rows all stay. Null, empty and blank texts are no duplicates either; an
    empty table stays empty; columns may have any names."""
    gone = near_duplicates(docs, n=5).where("not kept").select("doc_id").distinct()
    counts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = Scratch(spark, "repeated-ids").write(counts, "ids")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.join(gone.unionByName(repeated), "doc_id", "left_anti").select(*columns)
    kept = docs.join(repeated.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi")
    least = F.min_by(F.struct(*columns), F.xxhash64(*columns, *[c.isNull() for c in columns])).alias("row")
    return single.unionByName(kept.groupBy("doc_id").agg(least).select("row.*"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the text. Null and empty texts stay as they are, repeated rows get the same
    text, an empty table stays empty; columns may have any names that do not begin with two underscores."""
    out = replace_entities(docs)
    return out.select(*[F.when(F.size("__entities") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the mix's proportions: a row for each time that a document is taken, in shards and in each shard in the order of its
    local shuffle, which is the order of the files' rows. Null sources are a source, null texts have no words, repeated rows are taken
    together, an empty table stays empty; the columns may have any names but ``__shard`` and ``__order``."""
    return materialise(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: null and empty texts have no ids, repeated rows stay, only doc_id and text are read."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
