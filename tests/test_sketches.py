import itertools
import pickle
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stridemill.errors import InvalidParameter
from stridemill.operators import sketches
from stridemill.operators.sketches import Distinct, HeavyHitters, Quantiles


def merged_in(shape, parts, make):
    """The sketches of parts, merged one by one, as a balanced tree, or in a random order."""
    made = []
    for p in parts:
        s = make()
        s.add(p)
        made.append(pickle.loads(pickle.dumps(s)))
    if shape == "random":
        random.Random(1).shuffle(made)
    while len(made) > 1:
        if shape == "tree":
            for a, b in zip(made[::2], made[1::2], strict=False):
                a.merge(b)
            made = made[::2]
        else:
            made[0].merge(made.pop(1))
    return made[0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6), max_size=60), min_size=1, max_size=12), st.sampled_from(["tree", "line", "random"]))
def test_ranks_are_within_the_stated_error(parts, shape):
    s = merged_in(shape, [np.array(p) for p in parts], lambda: Quantiles(8))
    values = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert s.n == len(values)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = s.value(q)
        if not len(values):
            assert got is None
            continue
        low, high = np.searchsorted(values, got, "left"), np.searchsorted(values, got, "right") - 1
        assert low - s.error - 1 <= q * (s.n - 1) <= high + s.error + 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=80), min_size=1, max_size=10), st.sampled_from(["tree", "line", "random"]))
def test_heavy_values_are_never_missed(parts, shape):
    s = merged_in(shape, [np.array(p, int) for p in parts], lambda: HeavyHitters(4))
    every = list(itertools.chain(*parts))
    assert s.n == len(every) and s.error * 5 <= s.n
    for v in set(every):
        n = every.count(v)
        assert n - s.error <= s.counts.get(v, 0) <= n


def test_distinct_counts_dont_depend_on_the_split():
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**63), 2**63 - 1, 50_000)
    whole = Distinct()
    whole.add(values)
    for shape in ("tree", "line", "random"):
        s = merged_in(shape, np.array_split(np.concatenate([values, values[:9000]]), 13), Distinct)
        assert (s.registers == whole.registers).all()
    assert abs(whole.estimate() / 50_000 - 1) < 0.05
    few = Distinct()
    few.add(values[:100])
    assert abs(few.estimate() - 100) < 5 and Distinct().estimate() == 0


def test_bounds_hold_on_events_however_they_are_split(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select("event_type", "user_id", "value").collect()
    for parts in (1, 7, 40):
        df = events.repartition(parts)
        for r in sketches.approximate_quantiles(df, "value", [0.1, 0.5, 0.99], ["event_type"], k=16).collect():
            own = sorted(x["value"] for x in rows if x["event_type"] == r["event_type"])
            assert r["n"] == len(own) and abs(np.searchsorted(own, r["value"]) - r["quantile"] * (len(own) - 1)) <= r["error"] + 1
            assert r["error"] < 0.5 * r["n"]
        users = {x["user_id"] for x in rows}
        assert abs(sketches.distinct_counts(df, "user_id").first()["estimate"] / len(users) - 1) < 0.05
        clashing = df.withColumnRenamed("user_id", "candidate").withColumns({"whole": F.lit(1), "n": F.lit(2)})
        heavy = {(r["value"], r["n"]) for r in sketches.heavy_hitters(clashing, "candidate", 0.02).collect()}
        counts = {u: sum(x["user_id"] == u for x in rows) for u in users}
        assert heavy == {(u, n) for u, n in counts.items() if n > 0.02 * len(rows)}


def test_states_merge_as_a_tree(spark):
    df = spark.range(0, 5000, 1, 50).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"))
    states = sketches.tree_fold(df, "v", Quantiles(10_000), ["g"], fan=4)
    assert states._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") >= 3
    got = {r["g"]: pickle.loads(r["state"]) for r in states.collect()}
    for g in range(3):
        assert sorted(np.concatenate(got[g].levels)) == [k for k in range(5000) if k % 3 == g and k % 10]


def test_empty_tables_nulls_and_wrong_parameters(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), ("a", None)], "g string, v double")
    got = sketches.approximate_quantiles(df, "v", [0.5], ["g"]).collect()
    assert [tuple(r) for r in got] == [(None, 0.5, 1.0, 0, 1)]
    assert sketches.approximate_quantiles(df.limit(0), "v", [0.5]).collect() == []
    for wrong in (lambda: Quantiles(1), lambda: HeavyHitters(0), lambda: Distinct(3), lambda: sketches.heavy_hitters(df, "v", 1.0), lambda: sketches.tree_fold(df, "v", Distinct(), fan=1)):
        with pytest.raises(InvalidParameter):
            wrong()
