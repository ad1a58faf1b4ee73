import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.operators import nbody, search
from stridemill.operators.pairs import against_all
from stridemill.sources import generators


def test_search_finds_the_best_and_breaks_ties_low(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [math.nan, 1.0])], "vec_id long, embedding array<float>")
    queries = corpus.filter("vec_id = 1")
    assert [tuple(r) for r in search.search_dot(corpus, queries).collect()] == [(1, 0, 0, 0.0)]
    both = [tuple(r) for r in search.search_sharded(corpus, corpus.filter("vec_id = 0"), 2).collect()]
    assert both == [(0, 2, 0, 1.0)]
    assert search.search_cosine(corpus, corpus.filter("vec_id = 0")).first()["best_index"] == 2


def test_an_empty_corpus_gives_minus_infinity(spark):
    queries = generators.embeddings(spark, 3, 4)
    found = search.with_empty(search.search_dot(queries.limit(0), queries), queries)
    assert {(r["best_index"], r["best_similarity"]) for r in found.collect()} == {(0, -math.inf)}


def test_sharded_and_global_search_agree(spark):
    v = generators.embeddings(spark, 200, 8)
    q = v.filter("vec_id < 7")
    one = {tuple(r) for r in search.search_dot(v, q, 4).collect()}
    assert one == {tuple(r) for r in search.search_sharded(v, q, 4).collect()}


def test_all_pairs_do_not_need_a_broadcast(spark):
    left = spark.range(50)
    right = spark.range(7).withColumnRenamed("id", "other")
    big = against_all(left, right, "id", broadcast_bytes=3, blocks=4)
    assert "NestedLoop" not in big._jdf.queryExecution().toString() and "Cartesian" not in big._jdf.queryExecution().toString()
    assert {tuple(r) for r in big.collect()} == {(a, b) for a in range(50) for b in range(7)}
    assert "BroadcastNestedLoopJoin" in against_all(left, right, "id")._jdf.queryExecution().toString()


def test_generators_are_reproducible(spark):
    a = generators.embeddings(spark, 20, 3).orderBy("vec_id").collect()
    assert a == generators.embeddings(spark, 20, 3).repartition(3).orderBy("vec_id").collect()
    low, high = generators.bodies(spark, 50).agg(F.min("m"), F.max("m")).first()
    assert 1e20 <= low < high < 1e25


@pytest.mark.parametrize("steps", [0, 1, 4])
def test_simulation_follows_numpy(spark, steps):
    start = generators.bodies(spark, 12, masses=(1e6, 1e7))
    rows = np.array([tuple(r)[1:] for r in start.orderBy("id").collect()])
    x, v, m = rows[:, :3].copy(), rows[:, 3:6].copy(), rows[:, 6]
    for _ in range(steps):
        d = x[None] - x[:, None]
        pull = nbody.GRAVITY * m[:, None] * m[None] * ((d**2).sum(-1) + nbody.SOFTENING) ** -1.5
        v += (pull[..., None] * d).sum(1) / m[:, None] * nbody.TIME_STEP
        x += v * nbody.TIME_STEP
    for blocks in (False, True):
        got = np.array([tuple(r)[1:] for r in nbody.simulate(start, steps, blocks=blocks).select("id", *"xyz", "vx", "vy", "vz").orderBy("id").collect()])
        assert np.allclose(got, np.hstack([x, v]), rtol=1e-9)


def test_forces_by_pairs_and_by_both_kinds_of_blocks_agree(spark):
    start = generators.bodies(spark, 130, masses=(1e6, 1e7))
    by = lambda df: {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in df.collect()}
    want = by(nbody.forces_by_pairs(start))
    for how in ({}, {"broadcast_bytes": 0, "block": 37}):
        got = by(nbody.forces(start, **how))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    assert nbody.forces(start.limit(0)).count() == 0


def test_search_blocks_agree_with_scores_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, size=5)]) for k in range(300)]  # many ties
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0]), (303, [math.nan] * 5), (304, [0.0] * 5), (305, [1.0, 2.0]), (306, [2.0, 1.0]), (None, [1.0] * 5), (307, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = corpus.filter("vec_id % 20 = 0 OR vec_id > 300")
    for score, largest in (("dot", True), ("cosine", False)):
        want = {}
        for q, i, s in search.scored(corpus, queries, score).filter("query_id IS NOT NULL AND best_index IS NOT NULL AND score IS NOT NULL").collect():
            order = (-s if largest else s, i)
            want[q, i % 4] = min(want.get((q, i % 4), order), order)
        for how in ({}, {"broadcast_bytes": 0, "block": 50}):
            got = search.best_by_shard(corpus, queries, score, 4, **how).collect()
            assert {(r["query_id"], r["colocation_index"]): r["best_index"] for r in got} == {k: i for k, (_, i) in want.items()}
    assert search.search_dot(corpus.limit(0), queries).count() == search.search_dot(corpus, queries.limit(0)).count() == 0
