"""Neighbours of wide vectors: what the driver holds is bounded in bytes, and nothing is lost by it."""

import pickle

import numpy as np
from pyspark.sql import functions as F

from taskplane.llm import ann


def test_driver_holds_a_bounded_sample_of_wide_vectors(spark, monkeypatch):
    n, d, held = 6000, 1024, []
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(30, d))[rng.integers(0, 30, n)] + rng.normal(size=(n, d))).astype(np.float32)
    whole = spark.createDataFrame([(i, x[i].tobytes()) for i in range(n)], "vec_id long, raw binary").repartition(4)

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            rows = [np.frombuffer(v.as_py(), dtype=np.float32) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    table = whole.mapInArrow(unpack, "vec_id long, embedding array<float>")
    fit, probes = ann.k_means, ann.probes_for
    monkeypatch.setattr(ann, "k_means", lambda x, *a: held.append(x.nbytes) or fit(x, *a))
    monkeypatch.setattr(ann, "probes_for", lambda sample, lifted, centroids, turn, *a: held.append(len(pickle.dumps((centroids, turn)))) or probes(sample, lifted, centroids, turn, *a))
    got = {r["query_id"]: r["ids"] for r in ann.search(table).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()}
    assert held[0] < 34e6 and held[1] < 16e6, held  # all rows were 49 MB
    asked = np.arange(0, n, 20)
    scores = x[asked].astype(float) @ x.astype(float).T
    scores[np.arange(asked.size), asked] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert set(got) == set(asked.tolist()) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(w.tolist()) & set(got[q])) / 20 for q, w in zip(asked.tolist(), want)]) >= 0.9


def test_rotation_of_many_dimensions_is_small_and_spreads():
    d = 4097
    turn = ann.WideRotation(d)
    assert len(pickle.dumps(turn)) < 5e6  # a matrix takes 134 MB
    x = np.vstack([np.eye(d)[[0, 77, d - 1]], np.random.default_rng(2).normal(size=(20, d))])
    y = x @ turn
    assert y.shape == x.shape and np.allclose(y @ y.T, x @ x.T)
    for one in y[:3]:  # one old dimension: every sixteenth of the new ones has its share of the length
        assert all(0.4 / 16 < np.sum(part**2) < 2.5 / 16 for part in np.array_split(one, 16))


def test_centroids_are_compared_in_bounded_steps(monkeypatch):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(1000, 8)), rng.normal(size=(300, 8))
    whole = ann.nearest(x, c, 5)
    monkeypatch.setattr(ann, "HELD", 1)
    assert (ann.nearest(x, c, 5) == whole).all()
