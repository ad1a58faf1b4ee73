import os

import numpy as np
import pytest

from stridemill.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_k_steps_move_every_part(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_size").toPandas().sort_values("p_partkey")
    i, m = parts["p_partkey"].to_numpy(), 1e6 * (1 + parts["p_size"].to_numpy(float))
    x = np.stack([i * k % p / p for k, p in ((37, 101), (53, 103), (71, 107))], 1)
    v = np.tile([0.5, 0.25, 0.125], (len(i), 1))
    for _ in range(3):
        d = x[None] - x[:, None]
        v = v + 6.674e-11 * (m[None, :, None] * d * ((d**2).sum(2) + 1e-9)[..., None] ** -1.5).sum(1) * 0.01
        x = x + v * 0.01
    got = catalogue.QUERIES["nbody_k_steps"](spark, DATA).toPandas().sort_values("id")
    assert got["id"].tolist() == i.tolist()
    assert np.allclose(got[["x", "y", "z", "vx", "vy", "vz"]].to_numpy(), np.hstack([x, v]), atol=2e-8)


def test_tasks_follow_the_pairs(spark, monkeypatch):
    """One file of bodies becomes as many tasks as its pairs ask for, whatever partitions the rows come in."""
    from pyspark.sql import functions as F

    from stridemill.operators import nbody, pairs

    monkeypatch.setattr(pairs, "TASK_PAIRS", 1000)
    bodies = spark.range(0, 100, 1, 1).select("id", *(F.rand(7).alias(a) for a in nbody.AXES), F.lit(1e6).alias("m"))
    assert pairs.spread(bodies, 100, "id").rdd.getNumPartitions() == 10
    assert pairs.spread(bodies, 5, "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1)
    assert pairs.spread(bodies, 100, "id").rdd.getNumPartitions() == 100  # no more tasks than rows
    assert nbody.forces(bodies).count() == 100
