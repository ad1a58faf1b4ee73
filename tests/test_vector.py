import math

import pytest
from pyspark.sql import functions as F

from stridemill.errors import InvalidParameter, OutOfBounds
from stridemill.operators.sharded import ShardedVector
from stridemill.operators.vector import PositionalVector


def of(spark, values, kind="int"):
    rows = list(enumerate(values))
    return PositionalVector(spark.createDataFrame(rows, f"pos long, value {kind}"), len(rows))


def values(vector):
    rows = sorted(map(tuple, vector.df.collect()))
    assert [p for p, _ in rows] == list(range(vector.length))
    return [v for _, v in rows]


def test_growing_and_shrinking(spark):
    v = of(spark, [42, 100])
    assert values(v.push(7)) == [42, 100, 7]
    rest, last = v.pop()
    assert values(rest) == [42] and last.first()[0] == 100
    assert values(of(spark, [1, 3]).insert(1, 2)) == [1, 2, 3]
    assert values(of(spark, [1, 3]).insert(2, 9)) == [1, 3, 9]
    rest, gone = of(spark, [1, 2, 3]).remove(0)
    assert values(rest) == [2, 3] and gone.first()[0] == 1
    assert values(v.extend(of(spark, [5]))) == [42, 100, 5]
    assert values(v.clear()) == [] and v.clear().is_empty()
    assert values(v.truncate(9)) == [42, 100] and values(v.truncate(1)) == [42]
    assert values(v.resize(4, 0)) == [42, 100, 0, 0] and values(v.resize(1, 0)) == [42]
    assert values(v.resize_with(4, lambda p: p * 10)) == [42, 100, 20, 30]


def test_an_empty_vector(spark):
    v = PositionalVector.empty(spark, "int")
    rest, last = v.pop()
    assert values(rest) == [] and last.first() is None
    assert tuple(v.first_last().first()) == (None, None)
    assert v.contains(1).first()[0] is False
    assert values(v.push(1)) == [1] and values(v.reverse()) == []


def test_bounds(spark):
    v = of(spark, [1, 2, 3])
    for call in (lambda: v.insert(4, 0), lambda: v.remove(3), lambda: v.swap(0, 3), lambda: v.at(-1)):
        with pytest.raises(OutOfBounds):
            call()
    assert v.get(3).first() is None and v.get(range(1, 4)).count() == 0 and v.get(range(1, 3)).count() == 2
    with pytest.raises(OutOfBounds, match="more elements than positions"):
        v.reserve(2**63)
    assert (v.capacity(), v.capacity(5, 4), v.capacity(3, 4)) == (4, 8, 4)


def test_reordering_and_overwriting(spark):
    v = of(spark, [1, 2, 3, 4])
    assert values(v.swap(1, 3)) == [1, 4, 3, 2] and values(v.swap(2, 2)) == [1, 2, 3, 4]
    assert values(v.reverse()) == [4, 3, 2, 1]
    assert values(v.fill(7)) == [7] * 4 and values(v.fill_with(lambda p: p * p)) == [0, 1, 4, 9]
    assert tuple(v.first_last().first()) == (1, 4)


def test_nan_is_contained_in_nothing(spark):
    v = of(spark, [1.0, math.nan], "double")
    assert v.contains(1.0).first()[0] is True and v.contains(math.nan).first()[0] is False


def test_shards(spark):
    v = ShardedVector(of(spark, list(range(32))), 4)
    assert {tuple(r) for r in v.update(lambda x: x + 1).placement().collect()} == {(g, g % 4, g // 4, g + 1) for g in range(32)}
    assert [r["len"] for r in v.resize(30, 0).lengths().orderBy("colocation_index").collect()] == [8, 8, 7, 7]
    assert [v.resize(30, 0).length_at(k) for k in range(4)] == [8, 8, 7, 7]
    assert v.shard(9).count() == 0 and v.get(40).count() == 0 and v.get(5).first()["value"] == 5
    rest, last = v.push(99).pop()
    assert last.first()[0] == 99 and len(rest) == 32
    assert values(v.fill(1).vector) == [1] * 32 and v.clear().is_empty()
    assert values(v.fill_with(lambda g: F.lit(2) * g).vector) == [2 * g for g in range(32)]
    for call in (lambda: ShardedVector(v.vector, 0), lambda: v.length_at(4)):
        with pytest.raises(InvalidParameter):
            call()
    assert ShardedVector.empty(spark, "int").lengths().agg(F.sum("len")).first()[0] == 0
