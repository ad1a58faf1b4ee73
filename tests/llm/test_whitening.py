import math

import numpy as np
import pytest

from stridemill.llm import queries, whitening

DATA = "/root/testdata/sf0.001"


def plain(vectors, k=4):
    """(n, deviations, whitened up to sign, explained) from an eigendecomposition of the covariance."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum(int(a) ** 2 for a in row) for row in (n * x - total).tolist()]
    return n, deviation, ((n * x - total) / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_the_query_equals_an_eigendecomposition(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op13_whitening(spark, DATA).orderBy("vec_id", "component").toPandas()
    n, deviation, white, explained = plain([r.embedding for r in rows])
    assert len(got) == 4 * len(rows) and set(got.n) == {n}
    assert got.deviation.tolist() == [d for d in deviation for _ in range(4)]
    mine = got.whitened.to_numpy().reshape(-1, 4)
    for k in range(4):
        assert min(np.abs(mine[:, k] - white[:, k]).max(), np.abs(mine[:, k] + white[:, k]).max()) < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), explained, rtol=1e-9)
    assert 0 <= got.identity_error[0] < 1e-9 and got.identity_error.nunique() == 1


def test_nulls_repeats_lengths_and_columns(spark):
    rng = np.random.default_rng(5)
    good = [[float(x) for x in rng.normal(size=3) * (1, 5, 0.1)] for _ in range(40)]
    rows = [(k, v, "x") for k, v in enumerate(good)] + [(0, good[0], "again"), (None, good[1], None), (90, None, ""), (91, [1.0, None, 2.0], ""), (92, [1.0, math.nan, 2.0], "")]
    rows += [(93, [math.inf, 0.0, 0.0], ""), (94, [], ""), (95, [1.0, 2.0], "")]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(7)).toPandas()
    n, deviation, white, _ = plain(good)
    assert len(got) == 3 * 42 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert got.vec_id.isna().sum() == 3 and (got.vec_id == 0).sum() == 6
    first = got[got.component == 1].dropna(subset=["vec_id"]).sort_values("vec_id", kind="stable")
    assert sorted(set(first.deviation)) == sorted(set(deviation))
    assert np.allclose(np.abs(first.drop_duplicates("vec_id").whitened), np.abs(white[:, 0]))


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    flat = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]  # one direction
    got = whitening.whitened(spark.createDataFrame(flat, schema)).toPandas()
    assert set(got.component) == {1} and len(got) == 9 and got.explained[0] == pytest.approx(1)


def test_small_deviations_are_accurate():
    rng = np.random.default_rng(6)
    q = [np.linalg.qr(rng.normal(size=(5, 5)))[0] for _ in range(2)]
    values = np.array([1e8, 1e3, 1.0, 1e-4, 1e-7])
    size, v = whitening.jacobi(q[0] @ np.diag(values) @ q[1].T)
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-14) and np.allclose(size[:3], values[:3], rtol=1e-7)
    graded = np.triu(rng.normal(size=(5, 5))) * values  # columns of very different lengths
    size, _ = whitening.jacobi(graded)
    exact = np.linalg.svd(graded, compute_uv=False)
    assert np.allclose(size, exact, rtol=1e-6)


def test_blocks_fold_to_the_same_gram_matrix():
    rows = np.random.default_rng(7).normal(size=(100, 6))
    upper = None
    for k in range(0, 100, 9):
        upper = whitening.folded(upper, rows[k : k + 9])
    assert np.allclose(upper.T @ upper, rows.T @ rows)
