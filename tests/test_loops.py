import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill import runtime
from stridemill.errors import InvalidParameter
from stridemill.operators import nbody
from stridemill.operators.iterate import Loop, iterate


def bodies_of(spark):
    rows = [(k, k * 0.1, (k * k) % 7 * 0.1, k % 3 * 0.1, 0.1, 0.0, -0.1, 1e6 + k) for k in range(20)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, m double")


def test_a_simulation_goes_on_where_it_was_lost(spark, tmp_path, monkeypatch):
    place, bodies = str(tmp_path / "run"), bodies_of(spark)
    whole = sorted(map(tuple, nbody.simulate(bodies, 5).collect()))
    step, calls = nbody.step, []

    def dying(state, blocks=True):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return step(state, blocks)

    monkeypatch.setattr(nbody, "step", dying)
    with pytest.raises(KeyboardInterrupt):
        nbody.simulate(bodies, 5, place=place)
    assert Loop(spark, place).committed() == [2] and Loop(spark, place).states() == [2]
    os.makedirs(f"{place}/state-3")  # what a step that died while writing has left
    got = nbody.simulate(bodies.limit(0), 5, place=place)  # the start isn't read again
    assert sorted(map(tuple, got.collect())) == whole and len(calls) == 3 + 3
    assert Loop(spark, place).states() == [5] and Loop(spark, place).committed() == [5]
    assert sorted(map(tuple, nbody.simulate(bodies, 5, place=place).collect())) == whole and len(calls) == 6
    with pytest.raises(InvalidParameter):
        nbody.simulate(bodies, 4, place=place)


def test_loops_of_other_tables(spark):
    start = spark.createDataFrame([(1, None), (2, [1.5])], "`a b` long, c array<double>")
    got = iterate(start, lambda df, k: df.withColumn("a b", F.col("a b") * 2 + k), 3, write_every=2)
    assert sorted(map(tuple, got.collect()), key=repr) == [(19, None), (27, [1.5])]
    assert iterate(start, lambda df, k: df, 0).count() == 2
    with pytest.raises(InvalidParameter):
        iterate(start, lambda df, k: df, 1, write_every=0)


def test_intermediates_have_an_owner(spark, tmp_path):
    before = set(runtime.intermediates())

    def made():
        other = []
        thread = threading.Thread(target=lambda: other.append(runtime.written(spark.range(5))))
        thread.start()
        thread.join()
        assert len(set(runtime.intermediates()) - before) == 1  # made by the other thread
        return runtime.written(spark.range(3)).unionByName(other[0])

    runtime.written(spark.range(1))  # so that the folder of intermediates is there
    before = set(runtime.intermediates())
    got = runtime.stored_as(spark, made, str(tmp_path / "out"))
    assert got.count() == 8 and set(runtime.intermediates()) == before
    with pytest.raises(ValueError, match="x"), runtime.scratch(spark):
        runtime.written(spark.range(2))
        raise ValueError("x")
    assert set(runtime.intermediates()) == before
    place = sorted(before)[-1]
    runtime.discard(spark, [place])
    assert place not in runtime.intermediates() and not os.path.exists(place)


def test_the_fast_root(spark):
    x = np.concatenate([np.logspace(-9, 9, 2000), [1e-9, 1.0, 4.0]]).astype(np.float32)
    got = nbody.fast_inverse_root(x)
    assert got.dtype == np.float32 and np.abs(got.astype(float) * np.sqrt(x.astype(float)) - 1).max() < 0.0018
    bodies = bodies_of(spark)
    exact, fast = (nbody.forces(bodies, fast).orderBy("id").toPandas() for fast in (False, True))
    size = np.abs(exact[["fx", "fy", "fz"]].to_numpy()).sum()
    assert 0 < np.abs(exact - fast)[["fx", "fy", "fz"]].to_numpy().sum() < 0.02 * size
