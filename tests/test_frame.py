import pytest
from pyspark.sql import functions as F

from stridemill.errors import InvalidParameter, LengthMismatch
from stridemill.operators import fold, loops
from stridemill.plans.schedule import Dynamic, Static
from stridemill.runtime import Action, broadcast_to_workers, progress, topology
from stridemill.sources.frame import KEY, IndexedFrame

T = 4


@pytest.mark.parametrize("n", [0, 1, T - 1, T, T + 1, 3 * T])
@pytest.mark.parametrize("schedule", [Static(T), Dynamic(T), Static(1), Dynamic(3, 2)])
def test_each_index_is_reached_once(spark, n, schedule):
    frame = IndexedFrame.from_range(spark, 0, n).with_schedule(schedule)
    assert sorted(r[0] for r in frame.placed().collect()) == list(range(n))
    got = loops.coverage(frame.df).first()
    assert (got["count"], got["distinct_count"]) == (n, n)


def test_static_placement_is_one_slice_per_partition(spark):
    frame = IndexedFrame.from_range(spark, 0, 10).with_schedule(Static(3))
    rows = frame.placed().withColumn("p", F.spark_partition_id()).collect()
    assert [[r[0] for r in rows if r["p"] == k] for k in range(3)] == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9]]


def test_slices_skip_idle_workers(spark):
    got = loops.for_slices(IndexedFrame.from_range(spark, 0, 3).with_schedule(Static(8))).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1), (1, 1, 1), (2, 2, 1)]
    assert loops.split_ranges(spark, 3, 8).filter("count = 0").count() == 5


def test_filter_keeps_keys_and_schedule_length(spark):
    frame = IndexedFrame.from_indexer(spark, 10, lambda i: i * i).filter(F.col("value") % 2 == 0)
    assert (frame.length, frame.count()) == (10, 5)
    assert sorted(r[0] for r in frame.df.collect()) == [0, 2, 4, 6, 8]
    assert IndexedFrame.from_range(spark, 0, 3).filter(F.lit(None).cast("boolean")).count() == 0


def test_zip(spark):
    a = IndexedFrame.from_indexer(spark, 128, lambda i: i)
    pairs = a.zip(a.reversed()).df
    assert {r["left"] + r["right"] for r in pairs.collect()} == {127}
    with pytest.raises(LengthMismatch, match="one length"):
        a.zip(IndexedFrame.from_indexer(spark, 127, lambda i: i))


def test_offset_ranges_own_absolute_indices(spark):
    frame = IndexedFrame.from_range(spark, 250, 260).with_schedule(Static(2)).with_prong(2)
    assert sorted((r[KEY], r["thread_index"]) for r in frame.df.collect()) == [(i, int(i >= 255)) for i in range(250, 260)]
    assert sorted(r[0] for r in IndexedFrame.from_range(spark, 250, 253).reversed().df.collect()) == [250, 251, 252]


def test_folds(spark):
    frame = IndexedFrame.from_indexer(spark, 1024, lambda i: i).with_schedule(Static(8))
    slots = fold.fold_with_scratch(frame, slot=F.sum("value")).collect()
    assert sum(r["slot"] for r in slots) == sum(range(1024)) and len(slots) == 8
    few = IndexedFrame.from_indexer(spark, 3, lambda i: i).with_schedule(Static(8))
    every = fold.fold_with_scratch(few, True, {"slot": 0}, slot=F.sum("value")).collect()
    assert sorted(map(tuple, every)) == [(0, 0), (1, 1), (2, 2), *((k, 0) for k in range(3, 8))]
    words = fold.fold_python(frame, str, lambda s, rows: max([s, *map(str, rows["value"])]), max, "string").collect()
    assert max(r["value"] for r in words) == "999"
    with pytest.raises(InvalidParameter, match="fewer slots"):
        fold.fold_python(frame, int, lambda s, r: s, lambda a, b: a, "long", slots=7)


def test_schedules_need_workers():
    for make in (lambda: Static(0), lambda: Dynamic(0), lambda: Dynamic(2, 0)):
        with pytest.raises(InvalidParameter):
            make()


def test_expression_plans_have_no_python(spark):
    frame = IndexedFrame.from_indexer(spark, 100, lambda i: i).filter(F.col("value") > 3).with_prong()
    plan = frame.df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_actions_overlap_and_join_again(spark):
    first = Action(lambda: spark.range(10).count()).start()
    with Action(lambda: spark.range(20).count()) as second:
        pass
    assert (first.join(), first.join(), second.join()) == (10, 10, 20)
    with pytest.raises(ZeroDivisionError):
        Action(lambda: 1 // 0).join()


def test_workers_and_topology(spark):
    got = broadcast_to_workers(spark, 3, lambda k: k + 1, simultaneous=True).collect()
    assert sorted(map(tuple, got)) == [(0, "1"), (1, "2"), (2, "3")]
    row = topology(spark).first()
    assert row["quality_levels"] == 1 and row["logical_cores"] >= 1 and row["memory_bytes"] > 0
    assert progress(spark) == []
