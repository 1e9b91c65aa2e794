"""Engine runs: plans that stay lazy, datasets, selections, deduplication, groups, routers that flush, sinks, cancellation, live streams."""

import io
import json
import os
import threading
import time
from contextlib import redirect_stdout
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskplane import agents, cli
from taskplane.monitor import Collected
from taskplane.operators import control, reducers
from taskplane.operators.control import Backoff, Retry
from taskplane.plans import Dataset, Engine, ItemDataset, different_attr, instance_where, same_attr
from taskplane.sandbox import LocalSandbox
from taskplane.streaming import default_decode, reduce_available, run_available, stream


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("n"))


# plans ------------------------------------------------------------------------------------------------------------------
def test_frame_workers_are_one_plan(spark, tmp_path):
    """Columns are pruned and filters pushed down through nodes; each node's rows are counted all the same."""
    spark.range(1000).select("id", F.col("id").alias("other"), F.lit("x").alias("wide")).write.parquet(f"{tmp_path}/in")
    plans = []
    engine = Engine(spark)
    engine.worker("Row", emits=["Half"])(lambda df: df.where("id < 500"))

    @engine.worker("Half", emits=["Out"])
    def half(df):
        out = df.select(F.col("id").alias("k"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    engine.router("Out", reducers.Reducer({"n": F.count("*")}, ["k"])).seed("Row", spark.read.parquet(f"{tmp_path}/in"))
    report = engine.run()
    assert "PushedFilters: [IsNotNull(id), LessThan(id,500)]" in plans[0] and "ReadSchema: struct<id:bigint>" in plans[0]
    assert (report.by_type, report.processed) == ({"Row": 1000, "Half": 500}, 1500)
    assert report.frame("Out").count() == 500 and report.output("Out")[7] == 1


def test_counts_when_a_worker_reads_in_part(spark):
    engine = Engine(spark)
    engine.worker("A", emits=["B"])(lambda df: df.withColumn("m", F.col("n") * 2))

    @engine.worker("B", emits=["C"])
    def peek(df):
        assert df.limit(1).collect()
        return df

    engine.worker("C", emits=["D"])(lambda df: {})  # nothing reads what C gets
    report = engine.seed("A", numbers(spark, 300).repartition(4)).run()
    assert report.by_type == {"A": 300, "B": 300, "C": 300}


def test_several_outputs_of_a_derived_type_read_it_once(spark, tmp_path):
    engine = Engine(spark).type("Mid", "n long")
    calls = spark.sparkContext.accumulator(0)

    def slow(n):
        calls.add(1)
        return n

    plus = F.udf(slow, "long")
    engine.worker("A", emits=["Mid"])(lambda df: df.select(plus("n").alias("n")))
    engine.worker("Mid", emits=["Even", "Odd"])(lambda df: {"Even": df.where("n % 2 = 0"), "Odd": df.where("n % 2 = 1")})
    engine.router("Even", reducers.count()).router("Odd", reducers.total("n")).seed("A", numbers(spark, 100))
    report = engine.run()
    assert (report.output("Even"), report.output("Odd"), report.processed, calls.value) == (50, 2500, 200, 100)


def test_empty_keyed_router(spark):
    engine = Engine(spark).router("Word", reducers.keyed_count("word"))
    engine.worker("Doc", emits=["Word"])(lambda df: df.select(F.explode(F.split("text", " ")).alias("word")).where("false"))
    assert engine.seed("Doc", [("a b",)], "text string").run().output("Word") == {}


# selections -------------------------------------------------------------------------------------------------------------
def test_every_selection(spark):
    def needs(kind):
        def work(task, ctx):
            if ctx.instance.attrs["gpu"] != task.want:
                raise RuntimeError("wrong kind")
            ctx.route("Ran", on=ctx.instance.attrs["gpu"])

        return work

    def run(select, wants, tries=2):
        engine = Engine(spark, retry=Retry(max_attempts=tries, select=select)).type("Ran", "on string").router("Ran", reducers.keyed_count("on"))
        for gpu in ("a", "a", "h"):
            engine.register("Job", needs(gpu), attrs={"gpu": gpu})
        return engine.seed("Job", [(w,) for w in wants], "want string").run()

    assert run(("different_attr", "gpu"), ["h"]).output("Ran") == {"h": 1}
    same = run(("same_attr", "gpu"), ["h"], 3)
    assert (same.failed, same.retried) == (1, 2)
    assert run(("where", lambda attrs: attrs["gpu"] == "h"), ["h"]).output("Ran") == {"h": 1}
    for wrong in ("same_attr", "different_attr", "where", "nearest", ("where", "gpu"), ("any", "x"), ()):
        with pytest.raises(ValueError):
            Retry(select=wrong)
    assert control.selection("any") == ("any",)


def test_hints_with_predicates_and_attributes(spark):
    def picky(task, ctx):
        if ctx.instance.attrs["size"] == "small":
            raise instance_where(lambda attrs: attrs["size"] == "huge", "not here") if task.n % 2 else same_attr("zone", "try the neighbour")
        ctx.route("Ran", on=ctx.instance.attrs["name"])

    engine = Engine(spark, retry=Retry(max_attempts=2)).type("Ran", "on string").router("Ran", reducers.keyed_count("on"))
    for name, size, zone in (("s", "small", "x"), ("m", "middle", "x"), ("h", "huge", "y")):
        engine.register("Job", picky, attrs={"name": name, "size": size, "zone": zone})
    report = engine.seed("Job", [(1,)], "n long").run()
    assert report.output("Ran") == {"h": 1}
    assert different_attr("zone").select == ("different_attr", "zone")


def test_policies_of_instances_and_on_retry(spark, tmp_path):
    seen = f"{tmp_path}/retries"

    def note(task, error, attempt):
        with open(seen, "a") as f:
            f.write(f"{task.n} {error} {attempt}\n")

    def fails(task, ctx):
        raise RuntimeError("no")

    engine = Engine(spark, retry=Retry(max_attempts=1))
    engine.register("Patient", fails, retry=Retry(max_attempts=4, backoff=Backoff(base_ms=5), on_retry=note)).register("Hasty", fails)
    report = engine.seed("Patient", [(1,)], "n long").seed("Hasty", [(2,)], "n long").run()
    assert (report.failed, report.retried) == (2, 3)
    assert sorted((x["task_type"], x["attempts"]) for x in report.dead_letters()) == [("Hasty", 1), ("Patient", 4)]
    with open(seen) as f:
        assert f.read().splitlines() == ["1 no 1", "1 no 2", "1 no 3"]


# deduplication, groups, routers ------------------------------------------------------------------------------------------
def test_first_seen_inside_a_callback(spark):
    engine = Engine(spark).type("New", "url string, part long").router("New", reducers.keyed_count("url"))

    @engine.worker("Link", rows=True)
    def visit(task, ctx):
        if ctx.first_seen("urls", task.url):
            ctx.emit("New", url=task.url, part=1)
            ctx.emit("New", url=task.url, part=2)

    urls = ["a", "b", "a", "c", "b", "a"] * 20
    report = engine.seed("Link", spark.createDataFrame([(u,) for u in urls], "url string").repartition(4)).run()
    assert report.output("New") == {"a": 2, "b": 2, "c": 2} and report.unique("urls") == 3 and report.skipped == len(urls) - 3


def test_dedup_node(spark):
    engine = Engine(spark).dedup("Row", ["k"], "First", order=["n"]).router("First", reducers.count_and_sum("n"))
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, n long")
    assert engine.seed("Row", rows).run().output("First") == (7, 21)


def feed(spark, store, reads, **options):
    engine = Engine(spark, store=store).checkpoint("Group", key="group_id").row_batch("Piece", "Group", 2, ["n"], **options)

    @engine.worker("Feed", emits=["Piece"])
    def read(df):
        reads.append(df.count())
        return df

    engine.worker("Group", emits=["Seen"])(lambda g: g)
    return engine.router("Seen", reducers.count()).source("Feed", "feed", numbers(spark, 5), "n")


def test_row_groups_cover_all_their_rows(spark, tmp_path):
    from taskplane.plans import Store

    store, reads = Store(spark, f"file://{tmp_path}/store"), []
    first = feed(spark, store, reads, gather="rows").run()
    groups = {r["key"]: r["cov"] for r in store.index().collect()}
    assert (first.output("Seen"), reads) == (3, [5]) and sorted(groups.values()) == [[0, 1], [2, 3], [4]]
    assert sorted([x["n"] for x in r["rows"]] for r in store.payloads("Group").collect()) == [[0, 1], [2, 3], [4]]
    again = feed(spark, store, reads, gather="rows").run()
    assert again.output("Seen") == 0 and reads == [5]


def test_python_router_that_flushes(spark):
    class Pairs:
        def __init__(self):
            self.held = []

        def route(self, task, ctx):
            self.held.append(task.n)
            if len(self.held) == 2:
                self.flush(ctx)

        def flush(self, ctx):
            if self.held:
                ctx.emit("Pair", total=sum(self.held), n=len(self.held))
                self.held = []

    engine = Engine(spark).type("Pair", "total long, n long").checkpoint("Pair", key="total")
    engine.stream_router("Number", ["Pair"], Pairs, order=["n"]).worker("Pair", emits=["Out"])(lambda p: p.withColumn("cov", F.col("_cov")))
    engine.collect("Out").source("Number", "numbers", numbers(spark, 5), "n")
    rows = sorted((r["total"], r["n"], list(r["cov"])) for r in engine.run().collected["Out"][0].collect())
    assert rows == [(1, 2, [0, 1]), (4, 1, [4]), (5, 2, [2, 3])]
    engine = Engine(spark).type("Pair", "total long, n long").stream_router("Number", ["Pair"], Pairs, shard="k", order=["n"]).router("Pair", reducers.count_and_sum("total"))
    assert engine.seed("Number", numbers(spark, 9).withColumn("k", F.col("n") % 3)).run().output("Pair") == (6, 36)


# datasets, targets --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", [Dataset, ItemDataset])
def test_a_dataset_keeps_the_checkpoints(spark, tmp_path, kind):
    dataset = kind(spark, f"file://{tmp_path}/ds")
    rows = spark.range(8).select(F.col("id").cast("string").alias("id"), F.col("id").alias("value"))

    def engine(name, df, source, stop=False):
        e = Engine(spark).dataset(dataset).checkpoint(name, key="id").router("Used", reducers.count_and_sum("value"))
        e.worker(name, emits=["Used"])(lambda x: x.select("value"))
        e.source(name, source, df.withColumn("ord", F.col("id").cast("long")), "ord")
        return e.select_tasks(name) if stop else e

    cut = engine("Row", rows, "rows", stop=True).run()
    assert (cut.processed, cut.output("Used")) == (8, (0, 0))
    rest = engine("Row", rows, "rows").run()
    assert rest.output("Used") == (8, 28) and rest.skipped == 0
    assert engine("Row", rows, "rows").run().output("Used") == (0, 0)
    engine("Resaved", rows.where("value < 4").withColumn("value", F.col("value") * 10), "again").run()
    assert sorted((r["id"], r["value"]) for r in dataset.read("Resaved").collect()) == [(str(i), 10 * i) for i in range(4)]
    assert sorted((r["id"], r["value"]) for r in dataset.read("Row").collect()) == [(str(i), i) for i in range(4, 8)]
    if kind is Dataset:
        assert dataset.compact() == 4 and sorted(r["value"] for r in dataset.read("Row").collect()) == [4, 5, 6, 7]
        same = dataset.put("x", "k", rows, [100])
        assert same == dataset.put("x", "k2", rows.orderBy(F.desc("value")).repartition(3), [101])


def test_read_and_sink_nodes(spark, tmp_path):
    numbers(spark, 50).write.parquet(f"{tmp_path}/in.parquet")
    engine = Engine(spark).read("Number", f"{tmp_path}/in.parquet")
    engine.worker("Number", emits=["Even"])(lambda df: df.where("n % 2 = 0"))
    report = engine.sink("Even", f"{tmp_path}/out.csv").run()
    assert report.by_type == {"Number": 50, "Even": 25}
    assert spark.read.option("header", True).csv(f"{tmp_path}/out.csv").count() == 25


def test_several_selected_tasks(spark):
    engine = Engine(spark)
    for a, b in (("In", "A"), ("In2", "B")):
        engine.worker(a, emits=[b])(lambda df: df)
    for t in "AB":
        engine.worker(t, emits=["C"])(lambda df: df)
        engine.checkpoint(t, key="n")
    engine.router("C", reducers.count()).seed("In", numbers(spark, 3)).seed("In2", numbers(spark, 4))
    assert engine.select_tasks("A", "B").run().output("C") == 0
    assert {r["name"]: (r["n_stored"], r["n_done"]) for r in engine.tasks().collect()} == {"A": (3, 0), "B": (4, 0)}
    with pytest.raises(ValueError):
        engine.select_tasks("A", "Nothing")


def test_cli_with_a_dataset(spark, tmp_path):
    def make():
        engine = Engine(spark).checkpoint("Row", key="n").router("Used", reducers.count()).source("Row", "rows", numbers(spark, 6), "n")
        engine.worker("Row", emits=["Used"])(lambda df: df)
        return engine

    where = f"file://{tmp_path}/ds"
    assert cli.main(make, ["--tasks", "Row,", "--dataset", where, "--no-live"]) == 0
    said = io.StringIO()
    with redirect_stdout(said):
        assert cli.main(make, ["list-tasks", "--dataset", where]) == 0
    assert "Row\tworker=yes\tstored=6\tdone=0" in said.getvalue()
    assert ItemDataset(spark, where).read("Row").count() == 6


# time -----------------------------------------------------------------------------------------------------------------------
def test_workers_see_that_the_run_ends(spark):
    engine = Engine(spark)

    @engine.worker("Job", rows=True)
    def wait(task, ctx):
        for _ in range(600):
            if ctx.is_cancelled:
                return
            time.sleep(0.1)

    engine.seed("Job", spark.range(4).repartition(2))
    threading.Timer(2, engine.shutdown).start()
    began = time.time()
    report = engine.run()
    assert report.processed == 4 and time.time() - began < 40


def test_monitor_at_intervals(spark):
    seen = Collected()
    engine = Engine(spark, monitor=seen, monitor_ms=50)

    @engine.worker("Job", rows=True)
    def work(task, ctx):
        time.sleep(0.5)

    engine.seed("Job", spark.range(2)).run()
    assert len(seen.samples) > 5 and any(s["running"] == "Job" for s in seen.samples) and seen.samples[-1]["processed"] == 2


def test_rows_arrive_while_the_run_goes_on(spark, tmp_path):
    """The second type is not worked on before the reader has the first one's rows."""
    gate = f"{tmp_path}/gate"
    engine = Engine(spark).type("Out", "n long").type("Late", "n long").collect("Out")

    @engine.worker("A", emits=["Out", "Late"], rows=True)
    def early(task, ctx):
        ctx.emit("Out", n=task.n)
        if task.n == 0:
            ctx.emit("Late", n=100)

    @engine.worker("Late", emits=["Out"], rows=True)
    def late(task, ctx):
        for _ in range(600):
            if os.path.exists(gate):
                ctx.emit("Out", n=task.n)
                return
            time.sleep(0.1)

    engine.seed("A", numbers(spark, 5))
    got = []
    with stream(engine, capacity=4) as handle:
        for row in handle:
            got.append(row["n"])
            if len(got) == 5:
                open(gate, "w").close()
    assert sorted(got) == [0, 1, 2, 3, 4, 100] and handle.report.processed == 6


def test_streams_go_on_where_they_were(spark, tmp_path):
    schema, where = "n long", f"{tmp_path}/state"
    numbers(spark, 10).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    count = lambda s: s.groupBy((F.col("n") % 2).alias("k")).agg(F.count("*").alias("c"))
    assert run_available(spark, f"{tmp_path}/in", schema, lambda s: s, folder=f"{where}/a").count() == 10
    assert {r["k"]: r["c"] for r in reduce_available(spark, f"{tmp_path}/in", schema, count, folder=f"{where}/b").collect()} == {0: 5, 1: 5}
    numbers(spark, 4).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    assert run_available(spark, f"{tmp_path}/in", schema, lambda s: seen.append(1) or s, folder=f"{where}/a").count() == 14
    for _ in range(2):  # the second call has nothing new
        assert {r["k"]: r["c"] for r in reduce_available(spark, f"{tmp_path}/in", schema, count, folder=f"{where}/b").collect()} == {0: 7, 1: 7}


# agents, adapters -------------------------------------------------------------------------------------------------------
@dataclass
class Note:
    title: str
    size: int | None
    tags: list[str]
    done: bool = False


def test_agent_over_http(spark):
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            if len(asked) == 1:
                self.send_response(503)
                self.end_headers()
                return
            said = {"content": "done"} if any(m["role"] == "tool" for m in asked[-1][2]["messages"]) else {"content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "Note", "arguments": '{"title": "t", "size": 3, "tags": []}'}}]}
            body = json.dumps({"choices": [{"message": {"role": "assistant", **said}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    schema = agents.schema_of(Note)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("title", "string", False), ("size", "bigint", True), ("tags", "array<string>", False), ("done", "boolean", True)]
    client = agents.HttpClient(f"http://127.0.0.1:{server.server_port}/v1", "key", 10)
    engine = Engine(spark, retry=Retry(max_attempts=2)).type("Note", schema).router("Note", reducers.count_and_sum("size"))
    engine.register("Ask", agents.AgentWorker(client, {"Note": schema}))
    report = engine.seed("Ask", [("hello",)], "q string").run()
    server.shutdown()
    assert report.output("Note") == (1, 3) and report.retried == 1
    path, key, body = asked[-1]
    assert path == "/v1/chat/completions" and key == "Bearer key" and body["tools"][0]["function"]["parameters"]["required"] == ["title", "tags"]
    assert [m["role"] for m in body["messages"]] == ["system", "user", "assistant", "tool"] and body["messages"][2]["tool_calls"][0]["function"]["name"] == "Note"
    with pytest.raises(agents.ClientError):
        agents.HttpClient("http://127.0.0.1:9", timeout_s=1)({"messages": []})


def test_commands_of_an_agent():
    with LocalSandbox() as box:
        run = {t.name: t.call for t in box.tools()}["run_command"]
        assert run(command=["echo", "a b"]).splitlines() == ["exit code 0", "a b"]
        assert run(command=["sleep", "5"], timeout_secs=0.2).startswith("exit code 124")


def test_batches_become_columns():
    got = default_decode(pa.record_batch({"x": [1, 2], "y": [0.5, 1.5]}))
    assert np.asarray(got["x"]).tolist() == [1, 2] and np.asarray(got["y"]).tolist() == [0.5, 1.5] and default_decode(5) == 5
