"""Operators on small inputs: the cases that a naive build gets wrong, empty inputs, and independence of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from taskplane.operators import batching, control, provenance, recursion, reducers, relational
from taskplane.operators.control import Backoff, Instance, Retry


def test_word_count(spark):
    docs = spark.createDataFrame([("a b a c b a",), (None,), ("  ",)], "text string")
    assert reducers.keyed_count("word").value(relational.tokens(docs)) == {"a": 3, "b": 2, "c": 1}


def test_global_reducers_have_a_row_for_no_input(spark):
    none = spark.createDataFrame([], "n long")
    assert reducers.count().value(none) == 0
    assert reducers.total("n").value(none) == 0
    assert reducers.keyed_count("n").value(none) == {}


def test_count_and_sum(spark):
    assert reducers.count_and_sum("n").value(spark.range(10).select(F.col("id").alias("n"))) == (10, 45)


def test_collect_sorted(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "n int")
    assert [r["n"] for r in reducers.collected("n").value(df)] == [1, 2, 3]


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_fold_does_not_hang_on_partitions(spark, partitions):
    def add(state, row):
        state["n"] += 1
        state["even"] += row["id"] if row["id"] % 2 == 0 else 0

    fold = reducers.Fold(lambda: {"n": 0, "even": 0}, add, lambda a, b: {k: a[k] + b[k] for k in a}, lambda s: (s["n"], s["even"]))
    assert fold.value(spark.range(10).repartition(partitions)) == (10, 20)
    assert fold.value(spark.range(0)) == (0, 0)
    assert reducers.fold_rows([{"id": i} for i in range(10)], fold) == (10, 20)


def test_fan_out_and_route(spark):
    df = spark.createDataFrame([(1,), (3,), (0,), (None,)], "n int")
    assert sorted(r["copy"] for r in relational.fan_out(df, "n").collect()) == [1, 1, 2, 3]
    out = relational.route(df, {"big": F.col("n") > 1, "small": F.col("n") <= 1})
    assert (out["big"].count(), out["small"].count()) == (1, 2)


def test_first_seen_takes_the_least_in_order_and_keeps_null_keys(spark):
    rows = [("x", 3, "c"), ("x", 1, "a"), (None, 5, "n"), (None, 4, "m"), ("y", 2, "b")]
    got = relational.first_seen(spark.createDataFrame(rows, "k string, o int, v string").repartition(3), ["k"], ["o"])
    assert sorted((r["o"], r["k"], r["v"]) for r in got.collect()) == [(1, "x", "a"), (2, "y", "b"), (4, None, "m")]
    assert relational.unique_count(spark.createDataFrame(rows, "k string, o int, v string"), ["k"]).first()[0] == 3


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbered(spark, n):
    got = relational.numbered(spark.range(n).select((F.col("id") * 7 % 1009).alias("x")), ["x"]).orderBy("x").collect()
    assert [r["ordinal"] for r in got] == list(range(n))


def test_chunks(spark):
    rows = spark.range(10).select(F.lit("b").alias("batch"), F.col("id").alias("n"))
    got = batching.chunk(rows, 3, ["batch"], ["n"]).groupBy("piece").count().orderBy("piece").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 1]
    assert batching.chunk(rows, 0, ["batch"], ["n"]).select("piece").distinct().count() == 10
    assert batching.rebatch(rows, 4, ["n"]).groupBy("chunk").count().count() == 3


def _greedy(sizes, target):
    out, group, held = [], 0, 0
    for s in sizes:
        if s <= 0:
            continue
        out.append(group)
        held += s
        if held >= target:
            group, held = group + 1, 0
    return out


@pytest.mark.parametrize("sizes,target,groups", [([3, 3, 3, 1], 4, [6, 4]), ([32] * 7 + [26], 100, [128, 122])])
def test_row_groups(spark, sizes, target, groups):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "ord int, n int")
    got = batching.row_groups(df, [], ["ord"], "n", target).groupBy("group_id").agg(F.sum("n").alias("n")).orderBy("group_id").collect()
    assert [r["n"] for r in got] == groups


def test_row_groups_against_a_plain_fold(spark):
    rng = random.Random(4)
    shards = {s: [rng.randrange(0, 6) for _ in range(rng.randrange(1, 40))] for s in range(25)}
    df = spark.createDataFrame([(s, i, n) for s, ns in shards.items() for i, n in enumerate(ns)], "shard int, ord int, n int").repartition(7)
    got = batching.row_groups(df, ["shard"], ["ord"], "n", 7).orderBy("shard", "ord").collect()
    for s, ns in shards.items():
        assert [r["group_id"] for r in got if r["shard"] == s] == _greedy(ns, 7)
    assert batching.row_groups(df.limit(0), ["shard"], ["ord"], "n", 7).count() == 0
    assert batching.uniform_groups(8, 32, 100) == 2


def test_coverage_codec():
    assert provenance.coverage_rows(provenance.coverage_to_bytes([5, 1, 5, 2**40])) == [1, 5, 2**40]
    assert provenance.coverage_to_bytes([1]) == b"\x01" + b"\0" * 7
    with pytest.raises(ValueError):
        provenance.coverage_rows(b"abc")


def test_prune_is_by_source_and_ordinal(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "source string, ord long")
    covered = spark.createDataFrame([("a", 0), ("a", 1)], "source string, ord long")
    assert [tuple(r) for r in provenance.prune_covered(rows, covered).collect()] == [("b", 0)]
    assert [r["source"] for r in provenance.finished_sources(rows, covered).collect()] == ["a"]


def test_admission(spark):
    rows = spark.createDataFrame([("t", "x", 2), ("t", "x", 1), ("t", "y", 3), ("t", "z", 4)], "name string, key string, o int")
    index = spark.createDataFrame([("t", "y", "stored")], "name string, key string, status string")
    new, skipped = provenance.admit(rows, index, ["o"])
    assert sorted(r["o"] for r in new.collect()) == [1, 4]
    assert {r["key"]: r["n_skipped"] for r in skipped.collect()} == {"x": 1, "y": 1}


def test_supersession_against_pairs(spark):
    rng = random.Random(9)
    shards = [(f"s{i}", i, sorted(rng.sample(range(12), rng.randrange(0, 5)))) for i in range(60)]
    dead = {i for i, q, c in shards if c and set(c) <= {o for _, p, d in shards if p > q for o in d}}
    df = spark.createDataFrame([(i, q, o) for i, q, c in shards for o in (c or [None])], "id string, seq long, ord long")
    assert {r["id"] for r in provenance.live_shards(df).collect()} == {i for i, _, _ in shards} - dead


def test_backoff_and_retry():
    b = Backoff(100, 2, 350, 0.5)
    assert [b.delay(n, 0) for n in (1, 2, 3)] == [100, 200, 350]
    assert b.delay(1, 1) == 50
    assert Retry(3).again(2, False) and not Retry(3).again(3, False) and not Retry(3).again(1, True)


def test_placement():
    kinds = [Instance(0, {"gpu": "a100"}), Instance(1, {"gpu": "h100"}), Instance(2, {"gpu": "a100"}), Instance(3)]
    place = control.place
    assert place(("any",), None, set(), kinds).index == 0
    assert place(("any",), None, set(), kinds, {0: 2, 1: 1}).index == 2
    assert place(("avoid_tried",), kinds[0], {0}, kinds).index == 1
    assert place(("avoid_tried",), kinds[0], {0, 1, 2, 3}, kinds).index == 0
    assert place(("same_instance",), kinds[2], {2}, kinds).index == 2
    assert place(("different_attr", "gpu"), kinds[0], {0}, kinds).index == 1
    assert place(("same_attr", "gpu"), kinds[3], {3}, kinds).index == 3
    assert place(("where", lambda a: a.get("gpu") == "h100"), None, set(), kinds).index == 1
    assert place(("different_attr", "gpu"), kinds[0], {0}, [kinds[0], kinds[2]]) is None


def test_retry_rounds(spark):
    def attempt(rows, n):
        return rows.withColumns({"ok": F.col("id") % 4 < n, "fatal": F.col("id") == 7, "error": F.lit("no")})

    done, dead = control.retry_rounds(spark.range(8), attempt, Retry(max_attempts=3))
    assert sorted((r["id"], r["attempts"]) for r in done.collect()) == [(0, 1), (1, 2), (2, 3), (4, 1), (5, 2), (6, 3)]
    assert sorted((r["id"], r["attempts"], r["error"]) for r in dead.collect()) == [(3, 3, "no"), (7, 1, "no")]


def test_policy_violations(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("X", "C")], "from_type string, to_type string")
    assert [tuple(r) for r in control.violations(e, {"A": ["B"]}).collect()] == [("A", "C")]
    assert control.violations(e, {}).count() == 0


def test_fixpoint(spark):
    seeds = spark.createDataFrame([(0, 0)], "id long, depth int")
    step = lambda f: f.where("depth < 3").select(F.explode(F.sequence(F.col("id") * 4 + 1, F.col("id") * 4 + 4)).alias("id"), (F.col("depth") + 1).alias("depth"))
    assert recursion.fixpoint(seeds, step).count() == 85
    ring = recursion.fixpoint(spark.createDataFrame([(0,)], "id long"), lambda f: f.select(((F.col("id") + 1) % 5).alias("id")), unique=["id"])
    assert ring.count() == 5
