"""Queries of the library's operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import render_task
from ..operators import batching, control, provenance, recursion, reducers, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# flat-map, filter, fan-out, union -------------------------------------------------------------------------------------
@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reducers.keyed_count("word").apply(relational.tokens(table(spark, sf_dir, "documents")))


@query("SELECT count(*) AS n, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS total FROM lineitem")
def global_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reducers.count_and_sum("q").apply(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q")))


@query("SELECT count(*) AS seen, coalesce(sum(event_id) FILTER (event_id % 2 = 0), 0)::BIGINT AS even_total FROM events")
def route_even_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").agg(F.count("*").alias("seen"), F.coalesce(F.sum(F.when(is_even, F.col("event_id"))), F.lit(0)).alias("even_total"))


@query("""SELECT CASE WHEN toxic = 1 THEN 'review' ELSE 'publish' END AS type, count(*) AS n, min(doc_id) AS first_id FROM labels GROUP BY 1""")
def route_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    out = relational.route(labels, {"review": F.col("toxic") == 1, "publish": ~F.col("toxic").eqNullSafe(1)})
    typed = [f.select(F.lit(name).alias("type"), "doc_id") for name, f in out.items()]
    return relational.union_all(*typed).groupBy("type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS items, count(*) AS n FROM nation")
def collect_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reducers.collected("n_nationkey", "n_name").apply(table(spark, sf_dir, "nation"))
    text = F.transform("items", lambda x: F.concat_ws(":", x["n_nationkey"].cast("string"), x["n_name"]))
    return got.select(F.concat_ws(",", text).alias("items"), F.size("items").cast("long").alias("n"))


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, md5(text) AS digest FROM documents GROUP BY text")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    return relational.first_seen(docs, ["digest"], ["doc_id"]).select("doc_id", "source", "digest")


@query("SELECT count(DISTINCT text) AS n_unique FROM documents")
def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unique_count(table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("d")), ["d"])


@query("SELECT l_orderkey, l_linenumber, unnest(generate_series(1, l_linenumber))::INTEGER AS copy FROM lineitem")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.fan_out(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber")


@query("""SELECT nation, count(*) AS n, round(sum(balance), 2) AS balance FROM (
  SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY nation""")
def union_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return relational.union_all(a, b).groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT event_type, count(*) AS n_items, count(DISTINCT user_id) AS n_batches FROM events GROUP BY event_type")
def batches_and_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reducers.batches_and_items("user_id")
    return reducers.Reducer(r.aggregates, ["event_type"]).apply(table(spark, sf_dir, "events")).select("event_type", "n_items", "n_batches")


# batching -------------------------------------------------------------------------------------------------------------
@query("""SELECT l_orderkey, piece, count(*) AS n, min(l_linenumber) AS first_line FROM (
  SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) // 3 AS piece FROM lineitem) GROUP BY 1, 2""")
def chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    got = batching.chunk(lines, 3, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return got.groupBy("l_orderkey", "piece").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first_line"))


@query("""SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (
  SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1024 AS chunk FROM orders) GROUP BY chunk""")
def rebatch_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = batching.rebatch(table(spark, sf_dir, "orders").select("o_orderkey"), 1024, ["o_orderkey"])
    return got.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""SELECT conv_id, batch, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM (
  SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations) GROUP BY 1, 2""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = batching.fixed_batches(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3, ["conv_id"], ["turn"])
    roles = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    return got.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), roles.alias("roles"))


_GREEDY = """WITH RECURSIVE b AS (
  SELECT {shard} AS shard, {order} AS ok, {size} AS n, row_number() OVER (PARTITION BY {shard} ORDER BY {order}) AS rn FROM {source}),
 g AS (SELECT shard, ok, n, rn, 0::BIGINT AS grp, n::BIGINT AS held FROM b WHERE rn = 1
  UNION ALL SELECT b.shard, b.ok, b.n, b.rn, CASE WHEN g.held >= {target} THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.held >= {target} THEN b.n ELSE g.held + b.n END
  FROM g JOIN b ON b.shard = g.shard AND b.rn = g.rn + 1)
"""


@query(
    _GREEDY.format(shard="o_custkey", order="o_orderkey", size="cnt", target=16, source="(SELECT o_custkey, o_orderkey, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)")
    + "SELECT shard, grp AS group_id, count(*) AS n_batches, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1, 2"
)
def row_batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard"), F.col("o_orderkey").alias("l_orderkey"))
    got = batching.row_groups(orders.join(lines, "l_orderkey").select("shard", "l_orderkey", "n"), ["shard"], ["l_orderkey"], "n", 16)
    return got.groupBy("shard", "group_id").agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_rows"))


@query(
    _GREEDY.format(shard="u", order="d", size="cnt", target=4, source="(SELECT user_id AS u, date_trunc('hour', ts) AS d, count(*) AS cnt FROM events GROUP BY 1, 2)")
    + "SELECT 'events-' || lpad(grp::VARCHAR, 5, '0') || '.parquet' AS part, count(*) AS n_batches, sum(n)::BIGINT AS n_rows FROM g GROUP BY grp"
)
def rotate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    got = batching.rotation_parts(batches, ["user_id"], ["hour"], "n", 4)
    got = got.groupBy("part").agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_rows"))
    return got.select(batching.part_name("events", F.col("part"), "parquet").alias("part"), "n_batches", "n_rows")


@query("""SELECT user_id, grp, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS coverage, count(*) AS n_rows FROM (
  SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS grp FROM events) GROUP BY 1, 2""")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.fixed_batches(table(spark, sf_dir, "events").select("user_id", "event_id"), 5, ["user_id"], ["event_id"], "grp")
    got = rows.groupBy("user_id", "grp").agg(provenance.union(F.array("event_id")).alias("c"))
    return got.select("user_id", "grp", F.concat_ws(",", F.transform("c", lambda x: x.cast("string"))).alias("coverage"), F.size("c").cast("long").alias("n_rows"))


# provenance, checkpoints, datasets --------------------------------------------------------------------------------------
@query("SELECT event_type AS source, event_id AS ord FROM events WHERE NOT (event_id < 4000 AND event_id % 3 <> 0)")
def covered_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("ord"))
    return provenance.prune_covered(rows, rows.where("ord < 4000 and ord % 3 <> 0"))


@query("SELECT event_type AS source FROM events GROUP BY event_type HAVING bool_and(user_id >= 0) AND event_type <> (SELECT min(event_type) FROM events)")
def finished_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("ord"))
    least = rows.agg(F.min("source").alias("least"))
    covered = rows.join(F.broadcast(least), rows["source"] == least["least"], "left").where("least is null or ord % 7 <> 0").select("source", "ord")  # one row
    return provenance.finished_sources(rows, covered)


@query("""WITH a AS (SELECT doc_id, source AS name, md5(text) AS key FROM documents), i AS (SELECT DISTINCT name, key FROM a WHERE doc_id < 300),
 f AS (SELECT name, key, min(doc_id) AS doc_id, count(*) AS n FROM a GROUP BY 1, 2)
 SELECT f.name, count(*) FILTER (i.key IS NULL) AS n_new, sum(n - CASE WHEN i.key IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_skipped
 FROM f LEFT JOIN i USING (name, key) GROUP BY f.name""")
def checkpoint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive; what an earlier run stored (its first 300) is skipped."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.md5(F.col("text").cast("binary")).alias("key"))
    index = rows.where("doc_id < 300").select("name", "key", F.lit("consumed").alias("status"))
    new, skipped = provenance.admit(rows, index, ["doc_id"])
    a = new.groupBy("name").agg(F.count("*").alias("n_new"))
    b = skipped.groupBy("name").agg(F.sum("n_skipped").alias("n_skipped"))
    return a.join(b, "name", "full").select("name", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_skipped", F.lit(0)).alias("n_skipped"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 0, "consumed").otherwise("stored")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("key"), status.alias("status"), "doc_id")


@query("SELECT source AS name, doc_id FROM documents WHERE doc_id % 3 <> 0")
def reseed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.pending(_index(spark, sf_dir)).select("name", "doc_id")


@query("SELECT source AS name, count(*) AS n_stored, count(*) FILTER (doc_id % 3 = 0) AS n_done FROM documents GROUP BY source")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.task_status(_index(spark, sf_dir))


@query("""WITH s AS (SELECT 'saved' AS kind, 's' || (event_id // 5) AS id, 1 AS gen, event_id // 5 AS k, event_id AS ord FROM events
  UNION ALL SELECT 'resaved', 'r' || (event_id // 7), 2, event_id // 7, event_id FROM events WHERE event_id < 3500),
 q AS (SELECT *, CASE WHEN gen = 1 THEN k ELSE 1000000 + k END AS seq FROM s), m AS (SELECT ord, max(seq) AS newest FROM q GROUP BY ord)
 SELECT kind, id, count(*) AS n_rows FROM q JOIN m USING (ord) GROUP BY kind, id, seq HAVING min(newest) <= seq""")
def supersede_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"))
    saved = events.select(F.concat(F.lit("s"), F.floor(F.col("ord") / 5)).alias("id"), F.floor(F.col("ord") / 5).alias("seq"), "ord")
    resaved = events.where("ord < 3500").select(F.concat(F.lit("r"), F.floor(F.col("ord") / 7)).alias("id"), (1_000_000 + F.floor(F.col("ord") / 7)).alias("seq"), "ord")
    live = provenance.live_shards(saved.unionByName(resaved))
    return live.select(F.when(F.col("id").startswith("s"), "saved").otherwise("resaved").alias("kind"), "id", "n_rows")


@query("SELECT 'Saved' AS name, 's' || (event_id // 5) AS key, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM (SELECT event_id, round(value, 2)::DECIMAL(18,2) AS value FROM events) GROUP BY 2")
def boundary_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops at the checkpoint Saved: groups of five rows are stored, their consumer does not run."""
    from .engine import Engine

    engine = Engine(spark)

    @engine.worker("Line", emits=["Saved"])
    def group(lines: DataFrame) -> dict[str, DataFrame]:
        key = F.concat(F.lit("s"), F.floor(F.col("event_id") / 5))
        return {"Saved": lines.groupBy(key.alias("key")).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("total"))}

    @engine.worker("Saved", emits=["Edited"])
    def edit(saved: DataFrame) -> dict[str, DataFrame]:
        raise AssertionError("the consumer of a selected checkpoint must not run")

    engine.checkpoint("Saved", key="key").seed("Line", table(spark, sf_dir, "events").select("event_id", "value"))
    report = engine.select_tasks("Saved").run()
    return report.stored("Saved").select(F.lit("Saved").alias("name"), "key", "total")


# engine runs ------------------------------------------------------------------------------------------------------------
@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' AND length(word) > 3 GROUP BY word")
def engine_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to words to long words to a keyed router: frame workers that are one plan."""
    from .engine import Engine

    engine = Engine(spark)
    engine.worker("Doc", emits=["Word"])(lambda docs: relational.tokens(docs))
    engine.worker("Word", emits=["Long"])(lambda words: words.where(F.length("word") > 3))
    engine.router("Long", reducers.keyed_count("word")).seed("Doc", table(spark, sf_dir, "documents"))
    return engine.run().frame("Long")


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'dead' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS how, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders
  WHERE o_orderkey % 4 = 0 GROUP BY 1""")
def engine_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row worker with two instances: the first one cannot do every third order, no one every seventh."""
    from .engine import Engine, Retry, different_instance

    def small(order, ctx) -> None:
        if order.o_orderkey % 3 == 0:
            raise different_instance("too large")
        large(order, ctx)

    def large(order, ctx) -> None:
        if order.o_orderkey % 7 == 0:
            raise RuntimeError("broken")
        ctx.route("Done", how="first" if ctx.attempt == 1 and order.o_orderkey % 3 else "second", key=order.o_orderkey)

    engine = Engine(spark, retry=Retry(max_attempts=3)).type("Done", "how string, key long")
    engine.register("Order", small, label="small").register("Order", large, label="large")
    engine.router("Done", reducers.Reducer({"n": F.count("*"), "keys": F.sum("key")}, ["how"]))
    report = engine.seed("Order", table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select("o_orderkey")).run()
    dead = report.dead_letter_frame().select(F.lit("dead").alias("how"), F.get_json_object("task", "$.o_orderkey").cast("long").alias("key"))
    return report.frame("Done").select("how", "n", "keys").unionByName(dead.groupBy("how").agg(F.count("*").alias("n"), F.sum("key").alias("keys")))


@query("""SELECT CASE WHEN event_id < 500 THEN 'first' ELSE 'second' END AS run, count(DISTINCT event_id // 5) AS items, count(*) AS n_rows, sum(event_id)::BIGINT AS ids
  FROM events WHERE event_id < 800 GROUP BY 1""")
def engine_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one store: the second has more rows and works only on the items that the first did not store."""
    from .engine import Engine
    from .store import Store

    store = Store(spark)
    out = []
    for run, end in (("first", 500), ("second", 800)):
        engine = Engine(spark, store=store)

        @engine.worker("Line", emits=["Saved"])
        def group(lines: DataFrame) -> DataFrame:
            key = F.concat(F.lit("s"), F.floor(F.col("event_id") / 5))
            return lines.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), provenance.union(F.col("_cov")).alias("_cov"), F.first("_source").alias("_source"))

        engine.worker("Saved", emits=["Item"])(lambda saved: saved.select("n", "ids"))
        engine.checkpoint("Saved", key="key").router("Item", reducers.Reducer({"items": F.count("*"), "n_rows": F.sum("n"), "ids": F.sum("ids")}, []))
        items, n, ids = engine.source("Line", f"events, {run}", table(spark, sf_dir, "events").where(F.col("event_id") < end).select("event_id"), "event_id").run().output("Item")
        out.append((run, items, n, ids))
    return spark.createDataFrame(out, "run string, items long, n_rows long, ids long")


@query("SELECT CASE WHEN event_id < 3000 THEN 'Resaved' ELSE 'Row' END AS name, event_id, CASE WHEN event_id < 3000 THEN 10 * user_id ELSE user_id END::BIGINT AS value FROM events")
def dataset_resave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run keeps all rows in a dataset, another keeps some of them anew: the newer coverage supersedes, the rest is read as it was."""
    from .engine import Engine
    from .store import ItemDataset

    dataset = ItemDataset(spark, shared.new_path(spark, "dataset"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("value"))
    Engine(spark, dataset=dataset).checkpoint("Row", key="event_id").source("Row", "events", events, "event_id").run()
    again = events.where("event_id < 3000").withColumn("value", 10 * F.col("value"))
    Engine(spark, dataset=dataset).checkpoint("Resaved", key="event_id").source("Resaved", "events again", again, "event_id").run()
    return relational.union_all(*[dataset.read(n).select(F.lit(n).alias("name"), "event_id", "value") for n in ("Row", "Resaved")])


@query("""SELECT (event_id_rank // 64)::BIGINT AS group_id, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n_covered
  FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS event_id_rank FROM events) GROUP BY 1""")
def engine_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-batch router: one row a group, with its rows and the union of their coverage."""
    from .engine import Engine

    engine = Engine(spark).row_batch("Event", "Group", 64, ["event_id"], gather="rows").collect("Out")
    engine.worker("Group", emits=["Out"])(lambda g: g.withColumn("n_covered", F.size("_cov").cast("long")))
    engine.source("Event", "events", table(spark, sf_dir, "events").select("event_id"), "event_id")
    (got,) = engine.run().collected["Out"]
    ids = F.transform("rows", lambda r: r["event_id"])
    return got.select("group_id", F.size("rows").cast("long").alias("n_rows"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"), "n_covered")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def engine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deduplicating node between a target that is read and one that is written."""
    from ..sources import read
    from .engine import Engine

    where = f"{shared.new_path(spark, 'unique')}/docs.parquet"
    engine = Engine(spark).read("Doc", f"{sf_dir}/documents.parquet")
    engine.worker("Doc", emits=["Keyed"])(lambda d: d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")))
    engine.dedup("Keyed", ["digest"], "Unique", order=["doc_id"]).sink("Unique", where).run()
    return read(spark, where).select("doc_id", "digest")


# control --------------------------------------------------------------------------------------------------------------
_ATTEMPT = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 1 + o_orderkey % 4 END"


@query(f"""SELECT attempts, ok, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, coalesce({_ATTEMPT} <= 3, false) AND o_orderkey % 11 <> 0 AS ok,
  (CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN coalesce({_ATTEMPT} <= 3, false) THEN {_ATTEMPT} ELSE 3 END)::INTEGER AS attempts FROM orders) GROUP BY 1, 2""")
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(1 + F.col("o_orderkey") % 4)

    def attempt(rows: DataFrame, n: int) -> DataFrame:
        fatal = F.col("o_orderkey") % 11 == 0
        return rows.withColumns({"ok": F.coalesce(~fatal & (need <= n), F.lit(False)), "fatal": fatal, "error": F.lit("not yet")})

    done, dead = control.retry_rounds(table(spark, sf_dir, "orders").select("o_orderkey"), attempt, control.Retry(max_attempts=3))
    both = done.withColumn("ok", F.lit(True)).unionByName(dead.drop("error").withColumn("ok", F.lit(False)))
    return both.groupBy("attempts", "ok").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""SELECT CASE WHEN p_size > 40 THEN 'none' WHEN p_size > 20 THEN 'h100' WHEN p_partkey % 2 = 0 THEN 'a100' ELSE 'h100' END AS gpu,
  CASE WHEN p_size > 40 THEN 2 WHEN p_size > 20 AND p_partkey % 2 = 0 THEN 2 ELSE 1 END AS attempts, count(*) AS n FROM part GROUP BY 1, 2""")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs start on an instance by number; one that is too small for a job sends it to a different kind, if a kind is large enough."""
    kinds = [control.Instance(0, {"gpu": "a100"}), control.Instance(1, {"gpu": "h100"})]
    fits = {"a100": 20, "h100": 40}
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, "a100").otherwise("h100")
    room = F.when(name == "a100", fits["a100"]).otherwise(fits["h100"])
    other = {i.attrs["gpu"]: control.place(("different_attr", "gpu"), i, {i.index}, kinds).attrs["gpu"] for i in kinds}
    second = F.when(name == "a100", other["a100"]).otherwise(other["h100"])
    room2 = F.when(second == "a100", fits["a100"]).otherwise(fits["h100"])
    ok = F.col("p_size") <= room
    got = part.select(F.when(ok, name).when(F.col("p_size") <= room2, second).otherwise("none").alias("gpu"), F.when(ok, 1).otherwise(2).alias("attempts"))
    return got.groupBy("gpu", "attempts").agg(F.count("*").alias("n"))


@query("""SELECT 'order ' || o_orderkey AS task, 'Order' AS task_type, 'priority ' || o_orderpriority || ' rejected' AS error, 3 AS attempts, NULL::VARCHAR AS instance
  FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    reject = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)

    def attempt(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumns({"ok": ~reject, "fatal": F.lit(False), "error": F.concat(F.lit("priority "), "o_orderpriority", F.lit(" rejected"))})

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    _, dead = control.retry_rounds(rows, attempt, control.Retry(max_attempts=3))
    return control.dead_letters(dead, "Order", F.concat(F.lit("order "), "o_orderkey"))


@query("""SELECT event_type AS from_type, CASE WHEN event_id % 3 = 0 THEN 'Audit' ELSE 'Store' END AS to_type, count(*) AS n FROM events
  WHERE event_type IN ('click', 'purchase') AND NOT (event_type = 'click' AND event_id % 3 = 0) AND NOT (event_type = 'purchase' AND event_id % 3 <> 0) GROUP BY 1, 2""")
def emit_policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    emitted = table(spark, sf_dir, "events").select(F.col("event_type").alias("from_type"), F.when(F.col("event_id") % 3 == 0, "Audit").otherwise("Store").alias("to_type"))
    bad = control.violations(emitted, {"click": ["Audit"], "purchase": ["Store"]})
    return bad.groupBy("from_type", "to_type").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT 0::BIGINT AS id, 0 AS depth UNION ALL SELECT id * 4 + k, depth + 1 FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE depth < 3)
  SELECT depth, count(*) AS pages, sum(id)::BIGINT AS ids FROM p GROUP BY depth""")
def crawl_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    def links(pages: DataFrame) -> DataFrame:
        return pages.where("depth < 3").select(F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3, 4))), lambda k: F.col("id") * 4 + k)).alias("id"), (F.col("depth") + 1).alias("depth"))

    pages = recursion.fixpoint(spark.createDataFrame([(0, 0)], "id long, depth int"), links)
    return pages.groupBy("depth").agg(F.count("*").alias("pages"), F.sum("id").alias("ids"))


# sources and sinks ------------------------------------------------------------------------------------------------------
_ORDERS = "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(o_orderpriority) AS priority FROM orders GROUP BY o_orderstatus"


def _round_trip(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    from ..sources import read, write

    where = f"{shared.new_path(spark, 'round-trip')}/orders.{target}"
    write(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), where)
    got = read(spark, where)
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderpriority").alias("priority"))


@query(_ORDERS)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query(_ORDERS)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "jsonl")


@query(_ORDERS)
def ipc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "arrow")


@query(_ORDERS)
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "parquet")


@query("SELECT printf('p%06d.html', page_id) AS key, octet_length(encode(html))::BIGINT AS length, sha256(html) AS digest FROM pages")
def blob_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import read_blobs, write_blobs

    pages = table(spark, sf_dir, "pages").select(F.format_string("p%06d.html", "page_id").alias("key"), F.col("html").cast("binary").alias("value"))
    a, b = shared.new_path(spark, "blobs"), shared.new_path(spark, "blobs")
    write_blobs(pages, a)
    write_blobs(read_blobs(spark, a), b)
    return read_blobs(spark, b).select("key", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("digest"))


# streams and text -------------------------------------------------------------------------------------------------------
@query("SELECT event_id, event_type, user_id FROM events")
def shuffle_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import shuffled

    return shuffled(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), seed=5)


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS body FROM nation")
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", render_task(nation).alias("body"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files that runs until it is read; the sink's rows are what a batch gives."""
    from ..streaming import run_available

    events = table(spark, sf_dir, "events")
    got = run_available(spark, f"{sf_dir}/events.parquet*", events.schema, lambda s: s.select("event_type", "user_id"))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT md5(text) AS digest, length(min(text))::BIGINT AS n_chars FROM documents GROUP BY text")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen over a stream of documents: a row for each distinct text."""
    from ..streaming import run_available, stream_first_seen

    schema = table(spark, sf_dir, "documents").schema
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    return run_available(spark, f"{sf_dir}/documents.parquet*", schema, lambda s: stream_first_seen(s.select(digest, F.length("text").cast("long").alias("n_chars")), ["digest"]))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def stream_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed router over a stream: its state is kept between batches."""
    from ..streaming import reduce_available

    schema = table(spark, sf_dir, "events").schema
    return reduce_available(spark, f"{sf_dir}/events.parquet*", schema, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))
