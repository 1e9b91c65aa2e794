"""Tables that Spark sizes as before an explode are not broadcast, however small it takes them for."""

import re

import numpy as np

from taskplane.llm import ann


def test_exploded_queries_are_not_broadcast(spark, monkeypatch):
    plans, finish = [], ann.Scratch.finish

    def kept(self, df, name="result"):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return finish(self, df, name)

    monkeypatch.setattr(ann.Scratch, "finish", kept)
    x = np.random.default_rng(8).normal(size=(400, 16))
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    final = plans[0].split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin \[list#\d+, segment#\d+\]", final), final
    # the numbers of segments, one row a list, are all that is broadcast
    assert all(re.search(r"BroadcastHashJoin \[list#\d+\]", j) for j in final.splitlines() if "BroadcastHashJoin" in j), final
    assert got.count() == 20 * 20
