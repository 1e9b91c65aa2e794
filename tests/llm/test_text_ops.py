"""BPE, token counts, quality rules, mixing, toxicity: against the libraries or plain Python, and on odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskplane.llm import bpe, kernels, mixing, token_cache, toxicity, weak_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\t ", "a", "Ünïcödé ΣΑΣ İ ﬁ", "x y\x85z\x1cw", "😀👍🏽 zw‍", "<|endoftext|> and <|startoftext|><|endoftext|>", "it's DON'T we'll 12½ 3.5%", "word " * 3000, "one two three four five " * 40, "a\x00b", "z" * 40_000, "#*$%&|<> !!!"]


def odd_documents(spark):
    rows = [(i, t, "s" if i % 3 else None, 5, "x") for i, t in enumerate(ODD)] + [(1, None, None, None, None), (None, "a b c", "s", 1, "y"), (2, " ", "s", 1, "y"), (2, " ", "s", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, score string")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_lines_and_hashes():
    col = pa.array(ODD)
    data, offsets = kernels.flatten(col)
    s, e = kernels.spans(~kernels.SPACE[data], offsets)
    got = [data[a:b].tobytes() for a, b in zip(s, e)]
    want = [w.encode() for t in ODD for w in WORD.findall(t or "")]
    assert got == want
    h = kernels.hashes(data, s, e)
    assert len(set(h.tolist())) == len(set(want)) and len(set(zip(want, h.tolist()))) == len(set(want))
    lower = kernels.hashes(data, s, e, lower=True)
    assert len(set(lower.tolist())) == len({bytes(w).lower() for w in want})
    assert kernels.flatten(pa.array([None, "a"]).slice(1))[0].tobytes() == b"a"
    assert kernels.flatten(pa.array([], pa.string()))[0].size == 0


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, docs = Tokenizer.from_file(path), odd_documents(spark)
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.encode_documents(docs, path).collect()}
    assert bpe.encode_documents(docs, path).count() == docs.count()
    for r in docs.collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        mine = got[r["doc_id"], digest]
        assert mine["n_tokens"] == len(want) and mine["decoded"] == lib.decode(want, skip_special_tokens=False)
        assert mine["decoded_sha256"] == hashlib.sha256(mine["decoded"].encode()).hexdigest()
        assert bpe.load(path).encode(r["text"] or "") == want and bpe.load(path).decode(want) == mine["decoded"]
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


def test_bpe_merges_as_a_plain_scan():
    tok = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    rank = {(a, b): r for r, (a, b) in enumerate(zip(tok._left, tok._right))}
    for _ in range(300):
        word = "".join(rng.choice("abeinorst") for _ in range(rng.randrange(1, 25))).encode()
        ids = [tok._inner[b] for b in word[:-1]] + [tok._final[word[-1]]]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [tok._made[best[0]]]
        assert tok.merge(word) == ids


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, tmp_path, name):
    path, docs = public_tokenizers.path(name), odd_documents(spark)
    cache = token_cache.TokenCountCache(spark, f"file://{tmp_path}/cache")
    got = by_id(token_cache.count_tokens(docs, path, cache, limit=100))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n, n > 100) for r, n in zip(docs.collect(), token_cache.count_texts(path, [r["text"] or "" for r in docs.collect()]))), key=repr)
    assert got == want
    version = token_cache.tokenizer_version(path)
    held = cache.read(version).count()
    assert held == len({t or "" for t in ODD} | {"a b c"})
    assert by_id(token_cache.count_tokens(docs, path, cache, limit=100)) == want and cache.read(version).count() == held  # nothing new is encoded
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("something new")))
    token_cache.count_tokens(more, path, cache).collect()
    assert cache.read(version).count() == held + 1
    assert token_cache.count_tokens(docs.limit(0), path, token_cache.TokenCountCache(spark, f"file://{tmp_path}/none")).count() == 0


def plain_counts(t):
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_quality_measures_and_rules(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(90, "same line here\nother\nsame line here\n\n\n", "s", 1, "x")], odd_documents(spark).schema))
    got = weak_rules.score_quality(docs).collect()
    assert len(got) == docs.count()
    want = Counter((r["doc_id"], *plain_counts(r["text"] or "")) for r in docs.collect())
    assert Counter(tuple(r[c] for c in ("doc_id", *weak_rules.COUNTS[:5])) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1
    assert weak_rules.score_quality(docs.limit(0)).count() == 0


def test_weak_supervision_finds_the_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(40_000) < 0.85
    votes = np.zeros((good.size, 4), int)
    for k, (miss, hit) in enumerate(((0.001, 0.7), (0.002, 0.5), (0.001, 0.6), (0.001, 0.3))):
        bad_vote = rng.random(good.size) < np.where(good, miss, hit)
        votes[:, k] = np.where(rng.random(good.size) < 0.2, 0, np.where(bad_vote, -1, 1))
    pattern, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, info = weak_rules.fit(pattern, count.astype(float))
    assert abs(info["prior_good"] - 0.85) < 0.05
    assert (((post >= 0.5)[at]) == good).mean() > 0.95
    assert (weak_rules.fit(pattern, count.astype(float))[0] == post).all()


def test_quality_keeps_clean_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = weak_rules.score_quality(docs).join(labels, "doc_id").where("n_words >= 10").groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["label"]: r["k"] for r in rows}
    assert kept[1] > 0.95 and kept[0] < 0.1


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.water_fill([10, 1000], [1, 0.1], 3) == pytest.approx([30, 980])
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [1, 2]) == [0, 0]
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 12))]
        got = mixing.water_fill(sizes, [1 + i % 3 for i in range(len(sizes))])
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
        free = {round(t / (1 + i % 3), 6) for i, (t, s) in enumerate(zip(got, sizes)) if t < 3 * s - 1e-6}
        assert len(free) <= 1


def test_splitting_tree():
    quotas = np.array([1000, 0, 37, 5])
    got = mixing.split_quotas(quotas, 7, 1)
    assert (got.sum(axis=0) == quotas).all() and (got >= 0).all() and np.ptp(got.sum(axis=1)) <= 7
    assert (got == mixing.split_quotas(quotas, 7, 1)).all() and (got != mixing.split_quotas(quotas, 7, 2)).any()
    many = np.array([mixing.split_quotas(np.array([50, 50]), 2, s)[0, 0] for s in range(400)])
    assert abs(many.mean() - 25) < 1 and 1.5 < many.std() < 3.5  # hypergeometric: 2.5


def test_mix_near_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix_report(docs, shards=4)
    rows = got.collect()
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    per = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        per.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    names = sorted(per, key=lambda s: s.encode())
    want = mixing.water_fill([per[s][1] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        assert per[s][0] == pytest.approx(t) and abs(per[s][2] - t) <= 0.01 * t + 50
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(13), shards=4).drop("shards").collect()), key=repr) == sorted(map(tuple, got.drop("shards").collect()), key=repr)
    made = mixing.materialise(docs.withColumn("words", F.lit(1)), shards=4)
    assert made.columns == [*docs.columns, "words", "__shard", "__order"]
    assert Counter(r["doc_id"] for r in made.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = mixing.mix_report(docs)
    assert got.count() == docs.count() and got.where("taken > 3 * size").count() == 0
    assert got.agg(F.sum("size")).first()[0] == sum(len(WORD.findall(r["text"] or "")) for r in docs.collect())
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.materialise(docs.limit(0)).count() == 0
    assert mixing.mix_report(docs.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_toxicity(spark):
    rng = random.Random(5)
    bad, fine = ["trash", "idiot", "scum", "moron"], [f"w{i}" for i in range(400)] + ["you", "the"]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(fine) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labelled, lambda i: i % 3 != 1).collect()
    truth = dict(labels)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] % 3 == 1]
    assert sum(right) / len(right) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    again = toxicity.score_toxicity(docs.repartition(7), labelled, lambda i: i % 3 != 1).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({r["doc_id"]: r["score"] for r in again})
    odd = odd_documents(spark)
    assert toxicity.score_toxicity(odd, labelled, lambda i: i % 3 != 1).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score_toxicity(odd, labelled.limit(0), lambda i: i > 0).where("score = 0").count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), labelled, lambda i: i > 0).count() == 0
    kept = toxicity.score_toxicity(odd, labelled, lambda i: i % 3 != 1, keep=odd.columns)
    assert kept.columns == [*odd.columns, "__score", "__predicted"] and kept.count() == odd.count()


def test_isotonic_does_not_fall():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    x, level = toxicity.isotonic(m, (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(level) >= 0).all() and 0 < level[0] < level[-1] < 1


def test_features_of_obfuscation_and_proximity():
    lexicon, weights = toxicity._hash_of(("idiot", "loser")), np.array([5.0, 5.0])
    x = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["you are an 1D10T !", "plain words here", None]), lexicon, weights).T))
    assert x["word_hits"][0] > 0 and x["folded_hits"][0] > 0 and x["near_second_person"][0] > 0 and x["exclamations"][0] > 0
    assert x["word_hits"][1] == 0 and x["log_words"][2] == 0
