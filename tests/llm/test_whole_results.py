"""Cases in which an operator once did less than its whole job."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_ops import entities_of, low, plain_katz
from test_text_ops import odd_documents

from taskplane.llm import katz, surrogates, weak_rules
from taskplane.llm.scratch import Scratch

PLANTED = r'token = "([0-9a-f]{40})"'


def test_secrets_with_spaces_quotes_and_any_length(spark):
    value = "897a334fdac2c39185d0"
    forms = [f'token = "{value}"', f'"api_key": "{value}"', f"secret: {value}", f"password='{value}'", f"pwd   =   {value}", f'{{\\"token\\": \\"{value}\\"}}', f"'secret' => '{value}'", f"token:={value}"]
    got = entities_of(spark, [f"before {x} after" for x in forms])
    for i, x in enumerate(forms):
        assert value not in got[i]["text"] and len(got[i]["__entities"]) == 1, x
        e = got[i]["__entities"][0]
        assert got[i]["text"] == f"before {x} after".replace(e["original"], e["surrogate"]), x
    long = "eyJhbGciOi" * 90
    rows = entities_of(spark, [f"token={long} end", f'token = "{long}" end', 'password = "correct horse, battery; staple" end'])
    assert [rows[i]["__entities"][0]["original"] for i in range(3)] == [long, long, "correct horse, battery; staple"]
    assert not any(long[-40:] in r["text"] for r in rows.values())


def test_planted_secrets_of_the_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(PLANTED))
    planted = {x for r in docs.collect() for x in re.findall(PLANTED, r["text"])}
    assert planted
    for out in (surrogates.replace_entities(docs), corpus_pipeline.replace_personal_data(spark, docs, sf_dir)):
        assert not any(x in r["text"] for r in out.collect() for x in planted)


@pytest.mark.parametrize("n, alarm, hit, own", [(200_000, 0.2, 0.3, False), (200_000, 0.1, 0.3, False), (20_000, 0.2, 0.6, False), (200_000, 0.15, 0.3, True)])
def test_false_alarms_are_learned(n, alarm, hit, own):
    """One rule votes bad on much good text; with ``own``, another one alone finds a kind of junk."""
    rng = np.random.default_rng(5)
    kind = np.where(rng.random(n) < 0.85, 0, np.where(rng.random(n) < 0.6, 1, 2 if own else 1))
    rate = np.full((3, 8), 0.001)
    rate[1], rate[2, 6] = hit, 0.9
    rate[:, 3] = [alarm, hit, alarm]
    if own:
        rate[1, 6] = 0.001
    votes = np.where(rng.random((n, 8)) < rate[kind], -1, 1)
    pattern, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, info = weak_rules.fit(pattern, count.astype(float))
    kept = (post >= 0.5)[at]
    assert abs(info["false_alarms"][weak_rules.RULES[3][0]] - alarm) < 0.02 and abs(info["prior_good"] - 0.85) < 0.03
    assert kept[kind == 0].mean() > 0.98 and kept[kind == 1].mean() < 0.15 and (not own or kept[kind == 2].mean() < 0.15)


@pytest.mark.parametrize("parts", [None, 20])
def test_every_distribution_of_copies_sums_to_one(spark, monkeypatch, parts):
    """Groups of copies: most contexts have only followers that are not discounted."""
    if parts:
        monkeypatch.setattr(katz, "OWNER_NGRAMS", parts)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" if rng.random() < 0.8 else "the" for _ in range(rng.randrange(3, 25))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([t for i, t in enumerate(texts) for _ in range(1 + i % 13)] + ["the " * 9, "w1 the nowhere w2", ""])), "doc_id long, text string").repartition(3)
    rows = [([*low(r["text"]), None], r["doc_id"] % 7 != 2) for r in docs.collect()]
    _, prob, c, after, unigram, _ = plain_katz(rows)
    total = {h: sum(k for _, k in a) for h, a in after.items()}
    whole = {h for h, a in after.items() if min(k for _, k in a) > katz.CUTOFF}
    seen = {(h, w) for h, a in after.items() for w, _ in a}
    right = lambda h, w: prob(h, w) * (total[h] / (total[h] + 1) if h in whole and (h, w) in seen else 1)
    assert len(whole) > 50
    for h in after:
        assert sum(right(h, w) for w in c) + right(h, b"\xff") == pytest.approx(1), h
    want = sorted(sum(math.log10(right(h, w)) for h, w in zip(["<s>", *t], t)) for t, _ in rows)
    got = sorted(r["score"] for r in katz.score_texts(docs, lambda i: i % 7 != 2).collect())
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_entities_that_no_permutation_hides(spark):
    """Masks, letters in no alphabet, mostly such letters."""
    stuck = ["password=********", "token:----", "secret:????", "password=\u5bc6\u7801\u5bc6\u7801\u5bc6", "\u674e1@\u4f8b\u5b50.com", "\uae40\ucca0\uc218@\uc608\uc2dc.kr", "\u0639\u0644\u064a@\u0645\u062b\u0627\u0644.org", "Dr \u0540\u0561\u056f\u0578\u0562", "Dr. Anna \u0540\u0561\u056f\u0578\u0562"]
    got = entities_of(spark, [f"a {x} b" for x in stuck] * 2)
    made = {}
    for i, r in got.items():
        (e,) = r["__entities"]
        assert e["original"] not in r["text"] and e["surrogate"] != e["original"] and made.setdefault(e["original"], e["surrogate"]) == e["surrogate"], stuck[i % len(stuck)]
    assert len(set(made.values())) == len(stuck) and not re.search("[\u4e00-\u9fff\uac00-\ud7a3\u0600-\u06ff\u0530-\u058f*?]", " ".join(made.values()))
    assert made["Dr. Anna \u0540\u0561\u056f\u0578\u0562"].startswith("Dr. ") and made["\u674e1@\u4f8b\u5b50.com"].endswith(".com")


@pytest.mark.parametrize("inline", [1000, 0])
def test_crowded_forms_get_free_surrogates(spark, monkeypatch, inline):
    """Every form of a short name, and more than half of the short phone numbers of one form."""
    monkeypatch.setattr(surrogates, "FREE_DRAW", 3)
    monkeypatch.setattr(surrogates, "INLINE_REDRAWS", inline)
    names = [f"Mr {a}{b}" for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiouy"]
    got = entities_of(spark, [f"{x} said, {x.replace('Mr', 'Mr.')} did" for x in names])
    made = {e["original"]: e["surrogate"] for r in got.values() for e in r["__entities"]}
    assert len(made) == 240 == len({x.lower() for x in made.values()}) and not {x.lower() for x in made.values()} & {x.lower() for x in made}
    assert all(b.split()[0] == a.split()[0] for a, b in made.items())
    monkeypatch.setattr(surrogates, "_movable", lambda kind, e: F.right(surrogates._digits(e), F.lit(1)))
    monkeypatch.setattr(surrogates, "_assembled", lambda kind, e, p, seed: F.concat(F.substring(e, F.lit(1), F.length(e) - 1), p))
    numbers = [f"123-45-678{i}" for i in range(10)] + [f"988-555-243{i}" for i in range(10)]
    got = entities_of(spark, numbers)
    made = {e["original"]: e["surrogate"] for r in got.values() for e in r["__entities"]}
    assert set(made) == set(numbers) and len(set(made.values())) == 20 and not set(made.values()) & set(numbers)


def test_pipeline_stages_on_repeated_and_odd_rows(spark, sf_dir):
    """Copies of whole rows, one id with several texts, null ids and texts."""
    import corpus_pipeline

    odd = odd_documents(spark)
    more = [(100, "ten words that no other text of this small table has", "s", 1, "x")] * 1000 + [(101, f"text number {i} of one id", "s", i, None) for i in range(5)] + [(102, "ten words that no other text of this small table has", "s", 1, "x")] * 3
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).repartition(5)
    scratch = Scratch(spark, "t")
    after = scratch.write(corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir), "near")
    assert after.columns == docs.columns
    rows = Counter(r["doc_id"] for r in after.collect())
    assert rows.pop(None) == docs.where("doc_id is null").count() and set(rows.values()) == {1} and 100 in rows and 101 in rows and 102 not in rows
    assert set(map(tuple, after.collect())) <= set(map(tuple, docs.collect()))
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), sf_dir).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, after.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        assert docs.columns == odd.columns and docs.count()
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == docs.count()
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert max(ids.values()) <= 3
