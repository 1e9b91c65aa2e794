"""The queries of this subpackage: each applies one operator to its whole table, and their SQL where it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_texts

    return score_texts(table(spark, sf_dir, "documents"), lambda doc_id: ~held_out(doc_id, 7, 2))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as 16-bit ids of a public vocabulary for many languages, whose free id 50256 ends a document; the shards are written to the shared folder."""
    import public_tokenizers

    from .scratch import Scratch
    from .training_order import encode_ids, write_order

    scratch = Scratch(spark, "shards")
    tokens = scratch.write(encode_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "uint16"), "tokens", "zstd")
    out = write_order(tokens, f"{scratch.path}/order", key=20240229, ids="ids", end=50256)
    scratch.drop("tokens")
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", "orders")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, lambda doc_id: ~held_out(doc_id, 3, 1))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_entities

    out = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("__entities").alias("n_entities"), F.transform("__entities", lambda e: e["kind"]).alias("kinds"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own, so that the whole table is counted."""
    import public_tokenizers

    from .scratch import Scratch
    from .token_cache import TokenCountCache, count_tokens

    cache = TokenCountCache(spark, Scratch(spark, "token-counts").path)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_rules import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def check_quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10."""
    from .weak_rules import COUNTS, score_quality

    return score_quality(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS[:5], "base_failed")


def check_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5."""
    from .mixing import mix_report

    rows = mix_report(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"))


def check_text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_nearest_neighbours, op2_katz, op3_near_duplicates, op4_training_order, op5_mixing, op6_bpe, op7_toxicity, op8_surrogates, op9_token_counts, op10_quality_rules)
    return {f.__name__: f for f in (*operators, check_quality_measures, check_mix_targets, check_text_bytes)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the operators only op3: the others are random by hash, learned, approximate, or need a tokenizer's rules; what SQL can say of
#: these are queries of their own.
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
   ELSE list_sort(list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')))) END AS sh FROM w),
 u AS (SELECT doc_id, unnest(sh) AS g FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN s sa ON sa.doc_id = x JOIN s sb ON sb.doc_id = y WHERE 100 * n >= 80 * (len(sa.sh) + len(sb.sh) - n)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y),
 m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept,
  CASE WHEN len(sh) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY sh) END AS class_id FROM s JOIN m USING (doc_id)"""


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
QUALITY_MEASURES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
 i AS (SELECT rid, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM d WHERE len(ws) > 4),
 g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 4], ' ')) AS n FROM i),
 r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY rid),
 l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
   FROM d JOIN l USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m"""
#: Targets are the least of 3 x size and level x weight. With the sources in the order in which they reach their most, what the rest
#: would get grows as long as sources are over and falls after that: the level is its greatest value.
MIX_TARGETS = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
 o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
 c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM o),
 v AS (SELECT *, (total - before)::DOUBLE / (all_w - w_before) AS level FROM c),
 t AS (SELECT max(level) AS level FROM v)
SELECT doc_id, size, source_size, round(least(3.0 * source_size, t.level * w)::DOUBLE, 3) AS target, true AS within FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source, t"""
TEXT_BYTES = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": NEAR_DUPLICATES, "check_quality_measures": QUALITY_MEASURES, "check_mix_targets": MIX_TARGETS, "check_text_bytes": TEXT_BYTES}
