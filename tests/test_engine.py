"""Engine runs end to end: counters, retries, placement, policies, checkpoints, boundaries, collection."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from taskplane import cli
from taskplane.monitor import Collected, JsonConsole
from taskplane.operators import reducers
from taskplane.operators.control import Retry
from taskplane.plans import Engine, Fatal, different_attr, different_instance
from taskplane.plans.graph import EmitNotAllowed, TaskGraph
from taskplane.plans.store import Dataset, ItemDataset, MemStore, SqliteStore, Store
from taskplane.streaming import StreamHandle, TaskStream, loader, stream
from taskplane.streaming.training import ShuffleBuffer, SnapshotTaskSet


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("n"))


def test_word_count_with_a_frame_worker(spark):
    engine = Engine(spark)

    @engine.worker("Doc", emits=["Word"])
    def split(docs):
        return docs.select(F.explode(F.split("text", " ")).alias("word"))

    engine.router("Word", reducers.keyed_count("word")).seed("Doc", [("a b a c b a",)], "text string")
    report = engine.run()
    assert report.output("Word") == {"a": 3, "b": 2, "c": 1}
    assert (report.processed, report.failed) == (1, 0)


def test_row_worker_routes_and_filters(spark):
    engine = Engine(spark).type("Seen", "n long").type("Even", "n long")

    @engine.worker("Number", rows=True)
    def look(task, ctx):
        ctx.route("Seen", n=task.n)
        if task.n % 2 == 0:
            ctx.route("Even", n=task.n)

    engine.router("Seen", reducers.count()).router("Even", reducers.total("n")).seed("Number", numbers(spark, 10))
    report = engine.run()
    assert (report.output("Seen"), report.output("Even"), report.processed) == (10, 20, 10)


def test_retry_lands_on_another_instance(spark):
    engine = Engine(spark, retry=Retry(max_attempts=3)).type("Done", "n long, by string")

    def bad(task, ctx):
        raise different_instance("broken here")

    def good(task, ctx):
        ctx.route("Done", n=task.n, by="good")

    engine.register("Job", bad, label="bad").register("Job", good, label="good").router("Done", reducers.count())
    report = engine.seed("Job", [(1,)], "n long").run()
    assert (report.output("Done"), report.retried, report.processed, report.failed) == (1, 1, 1, 0)


def test_exhausted_retries_become_dead_letters(spark):
    letters = []
    engine = Engine(spark, retry=Retry(max_attempts=3), dead_letter=letters.append).type("Done", "n long")

    @engine.worker("Job", rows=True)
    def fail(task, ctx):
        ctx.route("Done", n=task.n)
        raise RuntimeError("always")

    report = engine.router("Done", reducers.count()).seed("Job", [(7,)], "n long").run()
    assert (report.failed, report.retried, report.output("Done")) == (1, 2, 0)
    assert [(json.loads(x["task"])["n"], x["task_type"], x["error"], x["attempts"]) for x in letters] == [(7, "Job", "always", 3)]


def test_fatal_is_not_retried(spark):
    engine = Engine(spark, retry=Retry(max_attempts=5))

    @engine.worker("Job", rows=True)
    def fail(task, ctx):
        raise Fatal("bad input")

    report = engine.seed("Job", [(7,)], "n long").run()
    assert (report.failed, report.retried, report.dead_letters()[0]["attempts"]) == (1, 0, 1)


def test_hint_by_attribute_and_unsatisfiable_hint(spark):
    def small(task, ctx):
        if task.size > 40:
            raise different_attr("gpu", "too large")
        ctx.route("Ran", on="small")

    def large(task, ctx):
        if task.size > 80:
            raise Fatal("too large for all")
        ctx.route("Ran", on="large")

    engine = Engine(spark, retry=Retry(max_attempts=2)).type("Ran", "on string")
    engine.register("Job", small, attrs={"gpu": "a"}).register("Job", large, attrs={"gpu": "h"}).router("Ran", reducers.count())
    report = engine.seed("Job", [(s,) for s in (20, 60, 75, 35)], "size int").run()
    assert (report.output("Ran"), report.failed) == (4, 0)
    alone = Engine(spark, retry=Retry(max_attempts=2)).type("Ran", "on string").register("Job", small, attrs={"gpu": "a"}).seed("Job", [(60,)], "size int").run()
    assert alone.failed == 1 and "satisfies" in alone.dead_letters()[0]["error"]


def test_timeout(spark):
    engine = Engine(spark, retry=Retry(max_attempts=2), timeout_ms=100)

    @engine.worker("Job", rows=True)
    def sleep(task, ctx):
        time.sleep(5)

    report = engine.seed("Job", [(1,)], "n int").run()
    assert report.retried == 1 and "timed out" in report.dead_letters()[0]["error"]


def test_policy(spark):
    engine = Engine(spark, retry=Retry(max_attempts=3)).type("Other", "n long").emit_policy("Job", ["Allowed"])

    @engine.worker("Job", rows=True)
    def emit(task, ctx):
        ctx.emit("Other", n=1)

    report = engine.seed("Job", [(1,)], "n long").run()
    assert (report.failed, report.retried) == (1, 0) and "may not emit" in report.dead_letters()[0]["error"]
    with pytest.raises(EmitNotAllowed):
        engine.worker("Job", emits=["Other"])(lambda df: df)


def test_no_worker_is_a_failure(spark):
    report = Engine(spark).seed("Nobody", [(1,)], "n long").run()
    assert report.failed == 1 and "no worker" in report.dead_letters()[0]["error"]


def test_recursion_and_dedup_across_tasks(spark):
    engine = Engine(spark).type("Page", "id long, depth int")

    @engine.worker("Page", emits=["Page"], rows=True)
    def crawl(page, ctx):
        if page.depth < 3:
            for k in range(4):
                ctx.emit("Page", id=int(page.id) * 4 + k + 1, depth=int(page.depth) + 1)

    assert engine.seed("Page", [(0, 0)], "id long, depth int").run().processed == 85
    assert engine.graph.cycles() == [{"Page"}]
    links = Engine(spark).type("Unique", "url string")

    @links.worker("Link", rows=True)
    def once(task, ctx):
        ctx.emit_first("urls", task.url, "Unique", url=task.url)

    links.router("Unique", reducers.count())
    report = links.seed("Link", [(u,) for u in ("a.com", "b.ru", "a.com", "c.cn", "d.onion", "b.ru")], "url string").run()
    assert (report.output("Unique"), report.unique("urls"), report.skipped) == (4, 4, 2)


def checkpointed(spark, store, seeds=10, source="lines"):
    engine = Engine(spark, store=store)

    @engine.worker("Line", emits=["Saved"])
    def group(lines):
        key = F.concat(F.lit("g"), F.floor(F.col("n") / 5) * 5)
        return lines.groupBy(key.alias("id")).agg(F.sum("n").alias("value"), F.array_sort(F.flatten(F.collect_list("_cov"))).alias("_cov"), F.first("_source").alias("_source"))

    @engine.worker("Saved", emits=["Edited"])
    def edit(saved):
        return saved.select("id")

    engine.router("Edited", reducers.count()).checkpoint("Saved", key="id")
    return engine.source("Line", source, numbers(spark, seeds), "n")


@pytest.mark.parametrize("kind", ["folder", "memory", "sqlite"])
def test_checkpoints_make_a_second_run_skip_everything(spark, tmp_path, kind):
    store = {"folder": lambda: Store(spark, f"file://{tmp_path}/store"), "memory": lambda: MemStore(spark), "sqlite": lambda: SqliteStore(spark, f"{tmp_path}/index.db")}[kind]()
    first = checkpointed(spark, store).run()
    assert (first.processed, first.skipped, first.output("Edited")) == (12, 0, 2)
    assert {r["name"]: (r["n_stored"], r["n_done"]) for r in store.statuses().collect()} == {"Saved": (2, 2)}
    again = checkpointed(spark, store).run()
    assert (again.processed, again.output("Edited")) == (0, 0)
    more = checkpointed(spark, store, seeds=15, source="more").run()
    assert (more.by_type["Line"], more.skipped, more.output("Edited")) == (15, 2, 1)


def test_boundary_stores_and_a_later_run_goes_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    cut = checkpointed(spark, store).select_tasks("Saved").run()
    assert (cut.processed, cut.output("Edited")) == (12, 0)
    assert [r["n_done"] for r in store.statuses().collect()] == [0]
    rest = checkpointed(spark, store).run()
    assert (rest.by_type.get("Line", 0), rest.output("Edited")) == (0, 2)


def test_duplicates_and_key_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for want in ((1, 1), (0, 2)):
        engine = Engine(spark, store=store).checkpoint("Sent", key="id", key_only=True)
        hits = []
        engine.worker("Sent")(lambda df: hits.append(df.count()) or {})
        report = engine.seed("Sent", [(7,), (7,)], "id long").run()
        assert (sum(hits), report.skipped) == want


def test_dataset_supersession(spark, tmp_path):
    ds = Dataset(spark, f"file://{tmp_path}/ds")
    rows = lambda v: spark.createDataFrame([(v,)], "v string")
    ds.put("row", "a", rows("a1"), [0, 1])
    ds.put("row", "b", rows("b1"), [2, 3])
    ds.put("resaved", "a", rows("a2"), [0, 1])
    assert sorted(r["v"] for r in ds.read().collect()) == ["a2", "b1"]
    ds.put("resaved", "b", rows("b2"), [2])
    assert sorted(r["v"] for r in ds.read().collect()) == ["a2", "b1", "b2"]
    assert ds.compact() == 1 and sorted(r["v"] for r in ds.read().collect()) == ["a2", "b1", "b2"]


def test_resaved_items_supersede(spark, tmp_path):
    """Rows are stored by one run and stored anew, ten times as large, by the next one; the first two only in part."""
    dataset, store = ItemDataset(spark, f"file://{tmp_path}/ds"), Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(6).select(F.col("id").cast("string").alias("id"), F.col("id").alias("value"), F.col("id").alias("ord"))
    first = Engine(spark, store=store, dataset=dataset).checkpoint("Row", key="id").source("Row", "rows", rows, "ord")
    assert first.run().processed == 6 and dataset.live().count() == 6
    second = Engine(spark, store=Store(spark, f"file://{tmp_path}/other"), dataset=dataset).checkpoint("Resaved", key="id")
    second.source("Resaved", "rows", rows.where("ord < 4").withColumn("value", F.col("value") * 10), "ord").run()
    assert sorted((r["id"], r["value"]) for r in dataset.read("Resaved").collect()) == [(str(i), 10 * i) for i in range(4)]
    assert sorted((r["id"], r["value"]) for r in dataset.read("Row").collect()) == [("4", 4), ("5", 5)]


def test_batcher_flushes_until_quiet(spark):
    engine = Engine(spark)
    engine.worker("Item", emits=["Batch"])(lambda df: {"Batch": df})
    engine.row_batch("Batch", "Group", 4, ["n"], "size").router("Group", reducers.batches_and_items("group_id"))
    sizes = spark.createDataFrame([(i, s) for i, s in enumerate((3, 3, 3, 1))], "n int, size int")
    assert engine.seed("Item", sizes).run().output("Group") == (2, 4)
    engine = Engine(spark).chunker("Whole", "Piece", 3, ["b"], ["n"]).router("Piece", reducers.batches_and_items("piece"))
    assert engine.seed("Whole", numbers(spark, 10).withColumn("b", F.lit(0))).run().output("Piece") == (4, 10)


def test_shutdown_counts_what_is_left(spark):
    engine = Engine(spark).type("B", "n long")

    @engine.worker("A", emits=["B"])
    def stop(df):
        engine.shutdown()
        return df.select("n")

    engine.worker("B")(lambda df: {})
    report = engine.seed("A", numbers(spark, 6)).run()
    assert report.interrupted and report.processed + report.unfinished == 12


def test_cancelled_after_the_grace_period(spark):
    engine = Engine(spark)

    @engine.worker("Job", rows=True)
    def sleep(task, ctx):
        time.sleep(60)

    engine.seed("Job", spark.range(4).select("id"))
    threading.Timer(2, lambda: engine.shutdown(grace_s=0)).start()
    began = time.time()
    report = engine.run()
    assert report.interrupted and report.unfinished == 4 and time.time() - began < 40


def test_graph():
    g = TaskGraph()
    g.declare("a", ["b"])
    g.declare("b", ["c"])
    assert g.order(["c", "b", "a"]) == ["a", "b", "c"] and g.cycles() == [] and g.feeders("c") == {"a", "b"}
    g.declare("c", ["a"])
    assert g.cycles() == [{"a", "b", "c"}]


def collecting(spark, n):
    engine = Engine(spark).collect("Sample")
    engine.worker("Number", emits=["Sample"])(lambda df: df.select(F.col("n").alias("i")))
    return engine.seed("Number", numbers(spark, n))


def test_stream(spark):
    with stream(collecting(spark, 200), capacity=8) as handle:
        assert sorted(r["i"] for r in handle) == list(range(200))
    assert handle.report.processed == 200
    with stream(collecting(spark, 1000), capacity=4) as handle:
        next(iter(handle))  # leaving early does not hang
    with pytest.raises(RuntimeError):
        stream(Engine(spark))
    engine = collecting(spark, 1)
    with pytest.raises(ValueError):
        engine.collect("Number")

    def broken():
        yield 1
        raise KeyError("lost")

    with pytest.raises(KeyError):
        list(StreamHandle(broken))


def test_training_adapter(spark):
    snapshot = spark.createDataFrame([(i, 2 * i) for i in range(64)], "x int, y int")
    ts = TaskStream(lambda: stream(collecting(spark, 64)), lambda: snapshot, shuffle=16, seed=1)
    assert sorted(x["i"] for x in ts) == list(range(64))
    a, b = ([x["x"] for x in ts] for _ in range(2))
    assert sorted(a) == sorted(b) == list(range(64)) and a != b
    assert sorted(ShuffleBuffer(5, 3).mixed(iter(range(50)))) == list(range(50))
    assert list(ShuffleBuffer(0, 3).mixed(iter(range(5)))) == list(range(5))
    data = SnapshotTaskSet(snapshot)
    assert len(data) == 64 and data[3] == {"x": 3, "y": 6}
    with pytest.raises(IndexError):
        data[64]
    assert [len(b) for b in loader(data, batch_size=25)] == [25, 25, 14]
    with pytest.raises(ValueError):
        loader(data, num_workers=2)


def test_cli(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/store"
    make = lambda: checkpointed(spark, None)
    assert cli.main(make, ["--tasks=Saved", "--store", path, "--json"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines and lines[-1]["processed"] >= 10
    assert cli.main(make, ["list-tasks", f"--store={path}"]) == 0
    assert "Saved\tworker=yes\tstored=2\tdone=0" in capsys.readouterr().out
    assert cli.main(make, ["--tasks", "Nothing", "--store", path]) == 2
    assert cli.main(make, ["--unknown"]) == 2
    assert cli.main(lambda: Engine(spark).seed("Nobody", [(1,)], "n int"), ["--no-live"]) == 1


def test_monitor(spark, capsys):
    seen = Collected()
    engine = collecting(spark, 5)
    engine.monitor = seen
    engine.run()
    assert seen.samples[-1]["processed"] == 5
    JsonConsole().sample({"processed": 1})
    assert json.loads(capsys.readouterr().out)["processed"] == 1


def test_resources_must_be_declared(spark):
    with pytest.raises(ValueError):
        Engine(spark).register("Job", lambda t, c: None, requires=("gpu",))
    engine = Engine(spark).resource("gpu", 1).type("Out", "p int").router("Out", reducers.count())
    engine.register("Job", lambda t, c: c.route("Out", p=1), requires=("gpu",))
    assert engine.seed("Job", spark.range(20).repartition(4)).run().output("Out") == 20
