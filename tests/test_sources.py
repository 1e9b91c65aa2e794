"""Sources and sinks: targets, registries, round trips, blobs, rotation, downloads, agents and the sandbox."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskplane import agents, sandbox
from taskplane.functions import render_task
from taskplane.operators import reducers
from taskplane.plans import Engine, Retryable
from taskplane.sources import Registry, Target, blob_sources, fetch, postgres_options, read, read_blobs, read_parquet_bytes, record_sources, to_parquet_bytes, write, write_blobs, write_rotating
from taskplane.sources.blobs import safe_key
from taskplane.sources.registry import for_path


def test_targets():
    assert Target.parse("a/b.CSV").extension == "csv" and Target.parse("a/b.csv").scheme == "file"
    assert Target.parse("s3://b/k.parquet").location == "s3a://b/k.parquet"
    assert Target.parse("HTTP://x/y").scheme == "http"
    with pytest.raises(ValueError):
        Target.parse("")
    assert for_path("x.ndjson") == "jsonl"
    with pytest.raises(ValueError):
        for_path("x.CSV")
    with pytest.raises(ValueError):
        record_sources().resolve(Target.parse("nope://x.csv"))
    with pytest.raises(ValueError):
        record_sources().resolve(Target.parse("x.unknown"))
    own = Registry().register_scheme("Mem", lambda *a: 1).register_ext(".X", lambda *a: 2)
    assert own.resolve(Target.parse("mem://t"))() == 1 and own.resolve(Target.parse("t.x"))() == 2
    assert blob_sources().resolve(Target.parse("any/file.bin")) is read_blobs


@pytest.mark.parametrize("kind", ["csv", "jsonl", "arrow", "parquet", "ndjson", "ipc"])
def test_round_trip(spark, tmp_path, kind):
    rows = [(10, "alice"), (20, "bob"), (30, "carol")]
    where = f"{tmp_path}/rows.{kind}"
    write(spark.createDataFrame(rows, "id bigint, name string"), where)
    got = read(spark, where)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == rows and got.schema["id"].dataType == T.LongType()


def test_ipc_keeps_types_and_empty_frames(spark, tmp_path):
    df = spark.sql("select 1L as a, array(1, 2) as b, timestamp_ntz'2024-01-01 00:00:00' as c, cast(1.5 as decimal(10,2)) as d, named_struct('x', 'y') as e")
    write(df, f"{tmp_path}/t.arrow")
    assert read(spark, f"{tmp_path}/t.arrow").collect() == df.collect()
    write(df.limit(0), f"{tmp_path}/e.arrow")
    assert read(spark, f"{tmp_path}/e.arrow").count() == 0


def test_blobs(spark, tmp_path):
    rows = [("a.txt", b"alpha"), ("nested/b.bin", b"beta"), ("empty", None)]
    assert write_blobs(spark.createDataFrame(rows, "key string, value binary"), str(tmp_path / "one")) == 3
    got = {r["key"]: bytes(r["value"]) for r in read_blobs(spark, str(tmp_path / "one")).collect()}
    assert got == {"a.txt": b"alpha", "nested/b.bin": b"beta"}  # Spark's reader leaves out files without bytes
    assert (tmp_path / "one/empty").read_bytes() == b""
    assert [r["key"] for r in read_blobs(spark, str(tmp_path / "one/nested/b.bin")).collect()] == ["b.bin"]
    assert safe_key("/../x/../../y") == "x/y"
    with pytest.raises(ValueError):
        safe_key("../..")


def test_rotation(spark, tmp_path):
    df = spark.range(6).select(F.floor(F.col("id") / 2).alias("batch"), F.col("id").alias("n"))
    got = write_rotating(df, f"file://{tmp_path}/out", ["batch"], 2).orderBy("part").collect()
    assert [(r["part"], r["rows"]) for r in got] == [(0, 2), (1, 2), (2, 2)]
    assert sorted(p.name for p in (tmp_path / "out").glob("*.parquet")) == [f"part-{i:05d}.parquet" for i in range(3)]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_parquet_in_a_column(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), "id")
    packed = to_parquet_bytes(df, ["k"])
    assert packed.count() == 3
    assert read_parquet_bytes(packed, "content", "k bigint, id bigint").agg(F.sum("id")).first()[0] == 45


def test_http(spark, tmp_path):
    hits = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            self.send_response(404 if "missing" in self.path else 200)
            self.end_headers()
            self.wfile.write(b"body " + self.path.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/a",), (f"{base}/a",), (f"{base}/b",), (None,)], "url string")
    for _ in range(2):
        got = {r["key"]: bytes(r["value"]) for r in fetch(urls, cache=str(tmp_path / "cache")).collect()}
        assert got == {f"{base}/a": b"body /a", f"{base}/b": b"body /b"}
    assert sorted(hits) == ["/a", "/b"]
    with pytest.raises(Exception, match="404"):
        fetch(spark.createDataFrame([(f"{base}/missing",)], "url string")).collect()
    server.shutdown()


def test_postgres_targets():
    o = postgres_options("postgres://u:p%40@db:5433/main#app.rows")
    assert o["url"] == "jdbc:postgresql://db:5433/main" and o["dbtable"] == "app.rows" and o["password"] == "p@"
    for bad in ("postgres://db/main", "postgres://db/main#x;drop", "mysql://db/main#t"):
        with pytest.raises(ValueError):
            postgres_options(bad)


def test_render(spark):
    df = spark.sql("select 'test.md' as path, 20480L as size, array('a', 'b') as tags, cast(null as string) as note")
    assert df.select(render_task(df)).first()[0] == 'path: test.md\nsize: 20480\ntags: ["a","b"]\nnote: null'
    assert agents.render({"path": "t", "n": 3, "tags": ["a", "b"]}) == 'path: t\nn: 3\ntags: ["a","b"]'


SUMMARY = T.StructType([T.StructField("text", T.StringType())])


def scripted(request):
    if request["messages"][-1]["role"] == "user":
        return {"text": None, "calls": [{"id": "1", "name": "Summary", "arguments": {"text": "about " + request["messages"][1]["content"]}}]}
    return {"text": "done", "calls": []}


def test_agent_emits(spark):
    engine = Engine(spark).type("Summary", "text string").router("Summary", reducers.collected("text"))
    engine.register("Doc", agents.AgentWorker(scripted, {"Summary": SUMMARY}), emits=["Summary"])
    report = engine.seed("Doc", [("a.md",)], "path string").run()
    assert [r["text"] for r in report.output("Summary")] == ["about path: a.md"]


def test_agent_errors():
    class Ctx:
        def emit(self, *a, **k): ...

    def failing(status):
        def client(_):
            raise agents.ClientError("no", status)

        return client

    task = agents.Task(path="x")
    with pytest.raises(agents.Fatal):
        agents.AgentWorker(failing(401), {}).process(task, Ctx())
    for status in (429, 500, None):
        with pytest.raises(Retryable):
            agents.AgentWorker(failing(status), {}).process(task, Ctx())
    with pytest.raises(agents.Fatal, match="unknown tool"):
        agents.AgentWorker(lambda r: {"calls": [{"name": "nope"}]}, {}).process(task, Ctx())
    with pytest.raises(agents.Fatal, match="turns"):
        agents.AgentWorker(lambda r: {"calls": [{"name": "S", "arguments": {}}]}, {"S": SUMMARY}, options=agents.AgentOptions(max_steps=3)).process(task, Ctx())
    assert agents.json_schema(T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.ArrayType(T.LongType()))])) == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "integer"}}}, "required": ["a"]}


def test_sandbox():
    with sandbox.LocalSandbox(sandbox.SandboxSpec(timeout_s=1, output_bytes=10, files={"in.txt": b"hello"})) as box:
        assert box.exec(["cat", "in.txt"]).stdout == b"hello"
        assert box.exec(["sh", "-c", "exit 3"]).exit_code == 3
        assert box.exec(["sleep", "5"]).exit_code == 124
        assert box.exec(["sh", "-c", "yes | head -100"]).truncated
        assert box.exec(["cat"], stdin=b"x").stdout == b"x"
        box.write_file("d/e.txt", "text")
        assert box.read_file("d/e.txt") == b"text"
        with pytest.raises(ValueError):
            box.read_file("../etc/passwd")
        run, write_, read_ = box.tools()
        assert write_.call(path="f", content="y") == "ok" and read_.call(path="f") == "y" and "exit code 0" in run.call(command="true")
    assert not box.root.exists()


def test_own_format_as_a_data_source(spark, tmp_path):
    from taskplane.sources.datasource import ipc_batches, ipc_schema, register_format

    write(spark.range(100).select("id", (F.col("id") * 2).alias("x")).repartition(3), f"{tmp_path}/t.arrow")
    register_format(spark, "own_ipc", ipc_batches, ipc_schema)
    got = spark.read.format("own_ipc").load(f"{tmp_path}/t.arrow")
    assert got.agg(F.count("*"), F.sum("x")).first()[:] == (100, 9900)


def test_chunks_of_files_have_keys(spark, tmp_path):
    from taskplane.sources.records import file_and_chunk

    for k in range(2):
        spark.range(2500).select(F.col("id").alias("n")).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    rows = spark.read.parquet(f"{tmp_path}/in/f0", f"{tmp_path}/in/f1").select(*file_and_chunk(1024), "n")
    chunks = rows.groupBy("key").count().collect()
    assert len(chunks) == 6 and sum(r["count"] for r in chunks) == 5000 and max(r["count"] for r in chunks) == 1024
    assert all("#" in r["key"] for r in chunks)
