"""Arrow IPC files: the schema comes to the driver without contents."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskplane.sources import read, read_ipc, write


def sent(spark, group: str, run) -> int:
    """Bytes that the tasks of all jobs of ``run`` send to the driver."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    jsc = sc._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    assert len(jobs) >= 2, jobs
    return sum(jsc.statusStore().lastStageAttempt(s).resultSize() for j in jobs for s in set(tracker.getJobInfo(j).stageIds) if tracker.getStageInfo(s).numCompletedTasks)


def test_no_contents_reach_the_driver(spark, tmp_path):
    where = f"{tmp_path}/t.arrow"
    write(spark.range(400_000).withColumn("x", F.rand(3)).repartition(6), where)
    sizes = [p.stat().st_size for p in (tmp_path / "t.arrow").glob("*.arrow")]
    assert len(sizes) == 6 and min(sizes) > 1_000_000
    got = []
    assert sent(spark, "ipc-schema", lambda: got.append(read(spark, where).agg(F.count("*"), F.sum("id")).first()[:])) < 200_000
    assert got == [(400_000, 400_000 * 399_999 // 2)]


def test_first_file_by_path_gives_the_schema(spark, tmp_path):
    """Odd names, folders below folders, names that are passed over."""
    root = tmp_path / "odd name%20 x#1"
    for name, column in (("b/1 é.arrow", "id"), ("a c/%41+&.arrow", "id"), ("a c/_0.arrow", "hidden"), ("a c/.0.arrow", "hidden")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        with pa.OSFile(str(root / name), "wb") as out, pa.ipc.new_file(out, pa.schema([(column, pa.int64())])) as writer:
            writer.write_table(pa.table({column: pa.array([1, 2, 3], pa.int64())}))
    got = read_ipc(spark, str(root / "a c")).collect()
    assert got == [(1,), (2,), (3,)] and got[0].asDict() == {"id": 1}
    assert read_ipc(spark, str(root)).agg(F.count("*"), F.sum("id")).first()[:] == (6, 12)
    assert read_ipc(spark, str(root / "b/1 é.arrow")).count() == 3
    (root / "none").mkdir()
    (root / "none/_0.arrow").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        read_ipc(spark, str(root / "none"))
