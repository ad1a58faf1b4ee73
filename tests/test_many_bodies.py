"""Bodies too many for all pairs one by one: the same forces from near pairs and far cubes, with far fewer pairs summed."""

import os

import numpy as np
import pandas as pd
import pytest

from stridemill import runtime
from stridemill.operators import cells, nbody
from stridemill.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def few(monkeypatch):
    """Limits at which some thousands of bodies are many."""
    monkeypatch.setattr(nbody, "DIRECT_PAIRS", 1)
    for name, value in (("LEAF_BODIES", 48), ("BLOCK_BODIES", 700), ("FEW_PAIRS", 32)):
        monkeypatch.setattr(cells, name, value)


def bodies_of(kind, n=4000):
    rng = np.random.default_rng(11)
    x = rng.random((n, 3))
    if kind == "crowded":  # a dense cloud in a wide one
        x[: n // 2] = 0.3 + rng.normal(0, 0.004, (n // 2, 3))
    if kind == "copies":  # many at one place, and every place twice
        x[n // 2 :] = x[: n // 2]
        x[: n // 4] = x[0]
    if kind == "flat":
        x[:, 2] = -7
    return pd.DataFrame({"id": np.arange(n), **{a: x[:, k] for k, a in enumerate("xyz")}, "m": 1e6 * rng.integers(1, 50, n)})


def summed(rows):
    x, m = rows[["x", "y", "z"]].to_numpy().T, rows["m"].to_numpy()
    return (nbody.GRAVITY * m * nbody._pulls(x, np.vstack([x, m]))).T


@pytest.mark.parametrize("kind", ["even", "crowded", "copies", "flat"])
def test_forces_by_cells_are_those_of_all_pairs(spark, few, kind):
    rows = bodies_of(kind)
    want = summed(rows)
    got = nbody.forces(spark.createDataFrame(rows)).toPandas().sort_values("id")
    assert got["id"].tolist() == rows["id"].tolist()
    off = np.linalg.norm(got[["fx", "fy", "fz"]].to_numpy() - want, axis=1)
    assert off.max() < 1e-10 * np.sqrt((want**2).sum(1).mean()) and np.median(off / np.linalg.norm(want, axis=1)) < 2e-13


def test_far_fewer_pairs_are_summed(spark, few):
    rows = bodies_of("even", 20_000)
    pairs = spark.sparkContext.accumulator(0)

    def counting(own, others):
        pairs.add(own.shape[1] * others.shape[1])
        return nbody._pulls(own, others)

    found = cells.pulls_by_cells(spark.createDataFrame(rows), nbody.SOFTENING, counting, np.zeros(3), 1.0)
    assert found.count() == len(rows)
    assert 0 < pairs.value < len(rows) ** 2 / 4


def test_places_that_no_cube_holds_are_summed_pair_by_pair(spark, few):
    rows = bodies_of("even", 300)
    rows.loc[3, "x"] = np.inf
    got = nbody.forces(spark.createDataFrame(rows)).toPandas().sort_values("id")
    with np.errstate(invalid="ignore"):
        want = summed(rows)
    assert np.allclose(got[["fx", "fy", "fz"]].to_numpy(), want, rtol=1e-9, equal_nan=True)


def test_bodies_at_one_place_pull_nobody(spark, few):
    rows = bodies_of("even", 300).assign(x=0.5, y=0.5, z=0.5)
    got = nbody.forces(spark.createDataFrame(rows)).toPandas()
    assert len(got) == 300 and not got[["fx", "fy", "fz"]].to_numpy().any()


def test_no_body_is_lost_where_a_plan_gives_other_places_each_time(spark, few):
    def anew(frames):
        for frame in frames:
            yield frame.assign(x=np.random.default_rng().random(len(frame)))

    rows = spark.createDataFrame(bodies_of("even", 300))
    got = nbody.forces(rows.mapInPandas(anew, rows.schema)).toPandas()
    assert sorted(got["id"]) == list(range(300)) and got.notna().all(axis=None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["nbody_k_steps", "nbody_force", "nbody_force_blocks", "nbody_step"])
def test_queries_by_cells_are_those_by_pairs(spark, monkeypatch, name):
    want = catalogue.QUERIES[name](spark, DATA).toPandas().sort_values("id").reset_index(drop=True)
    monkeypatch.setattr(nbody, "DIRECT_PAIRS", 1)
    called = []
    by_cells = nbody.pulls_by_cells
    monkeypatch.setattr(nbody, "pulls_by_cells", lambda *a: called.append(1) or by_cells(*a))
    kept = set(runtime.intermediates())
    got = catalogue.QUERIES[name](spark, DATA).toPandas().sort_values("id").reset_index(drop=True)
    assert len(called) == (3 if name == "nbody_k_steps" else 1)
    assert got.columns.tolist() == want.columns.tolist() and got["id"].tolist() == want["id"].tolist()
    assert np.allclose(got, want, rtol=0, atol=1 if "force" in name else 2e-8)
    left = set(runtime.intermediates()) - kept
    assert name != "nbody_k_steps" or not any("/places-" in p or "/charges-" in p or "/bodies-" in p for p in left)  # steps that are over leave nothing
    runtime.discard(spark, left)
