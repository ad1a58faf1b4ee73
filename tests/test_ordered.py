import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stridemill.errors import InvalidParameter, LengthMismatch, OutOfBounds
from stridemill.operators import edits, quantiles, scans, temporal
from stridemill.operators.edits import Edit
from stridemill.operators.scans import Scan
from stridemill.operators.vector import PositionalVector
from stridemill.plans import ordered
from stridemill.plans.schedule import Weighted
from stridemill.sources.frame import KEY, IndexedFrame


def test_scans_over_borders_of_batches_and_ranges(spark):
    """One group has half of all rows; values and keys have nulls; more ranges than groups, and fewer."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), k, rng.choice([None, rng.randrange(100)]), rng.choice([None, math.nan, rng.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, at long, n long, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ranges in (1, 3, 40):
            got = scans.scan(df, ["at"], ["g"], ranges, total=Scan("sum", "n"), low=Scan("min", "x"), top=Scan("max", "n"), last=Scan("last", "n"), before=Scan("lag", "n"), i=Scan("count"))
            seen: dict = {}
            want = []
            for g, k, n, x in rows:
                ns, xs = seen.setdefault(g, ([], []))
                before = ns[-1] if ns else None
                ns.append(n)
                xs.append(x)
                some, real = [v for v in ns if v is not None], [v for v in xs if v is not None and v == v]
                want.append((k, sum(some) if some else None, min(real) if real else None, max(some) if some else None, some[-1] if some else None, before, len(ns)))
            assert sorted(map(tuple, got.select("at", "total", "low", "top", "last", "before", "i").collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scans_of_dates_and_empty_tables(spark):
    rows = [(k, dt.date(2024, 1, 1 + (k * 7) % 20), dt.datetime(2024, 1, 1, k)) for k in range(10)]
    df = spark.createDataFrame(rows, "k int, d date, t timestamp")
    got = scans.scan(df, ["k"], ranges=3, first=Scan("min", "d"), latest=Scan("max", "t"), before=Scan("lag", "d"))
    for k, d, _, first, latest, before in sorted(map(tuple, got.collect())):
        assert first == min(r[1] for r in rows[: k + 1]) and latest == rows[k][2] and before == (rows[k - 1][1] if k else None) and d == rows[k][1]
    assert scans.scan(df.limit(0), ["k"], total=Scan("sum", "k")).collect() == []
    for wrong in (Scan("sum", "d"), Scan("median", "k")):
        with pytest.raises(InvalidParameter):
            scans.scan(df, ["k"], total=wrong)


def test_no_task_has_more_than_a_range(spark):
    """All rows in one group, and all of one key: ranges are even all the same."""
    df = spark.range(0, 8000, 1, 8).select(F.lit(1).alias("g"), F.lit(5).alias("at"), "id")
    dealt, number = scans.in_ranges(df, ["g", "at"], 8)
    sizes = [r["count"] for r in dealt.groupBy(number).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 1000
    got = scans.scan(df, ["at"], ["g"], 8, n=Scan("count"), total=Scan("sum", "at"))
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 8001)) and got.agg(F.max("total")).first()[0] == 40_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_long_strings_stay_out_of_what_cuts_ranges(spark):
    """Ordered by strings that differ late or not at all: whole order kept, and short keys cut."""
    rng = random.Random(8)
    rows = [(("x" * 70 if k % 3 else "") + rng.choice("abc"), k, rng.choice(["p", "q" * 500, None])) for k in range(200)]
    df = spark.createDataFrame(rows, "s string, k int, g string").repartition(3)
    got = scans.scan(df, ["s", "k"], ranges=5, before=Scan("lag", "k"), n=Scan("count"))
    want, last = [], None
    for n, (s, k, g) in enumerate(sorted(rows, key=lambda r: r[:2])):
        want.append((s, k, g, last, n + 1))
        last = k
    assert sorted(map(tuple, got.collect()), key=lambda r: r[4]) == want
    dealt, _ = scans.in_ranges(df, ["s", "k"], 5)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(s" in plan
    by = scans.scan(df, ["k"], ["g"], 7, n=Scan("count"))
    count = {}
    want = []
    for _, k, g in rows:
        count[g] = count.get(g, 0) + 1
        want.append((k, count[g]))
    assert sorted(map(tuple, by.select("k", "n").collect())) == want


def test_an_associative_fold_of_python(spark):
    df = spark.createDataFrame([(k, chr(97 + k % 26)) for k in range(60)], "k int, c string").repartition(4)
    step = lambda state, rows: ["".join([state or "", *rows["c"].iloc[: i + 1]]) for i in range(len(rows))]
    got = scans.scan_python(df, ["k"], "text", "string", step, lambda a, b: a + b, ranges=7)
    whole = "".join(chr(97 + k % 26) for k in range(60))
    assert {(r["k"], r["text"]) for r in got.collect()} == {(k, whole[: k + 1]) for k in range(60)}


def test_numbers_are_dense_whatever_the_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 50 + [(None, None)] * 5 + [(0, "y"), (2, "a")], "k int, v string").repartition(3)
    got = sorted(map(tuple, scans.numbered(df, ["k"], ranges=6).select(KEY, "k", "v").collect()))
    assert [r[0] for r in got] == list(range(57)) and got[0][1:] == (None, None) and got[5][1:] == (0, "y") and got[-1][1:] == (2, "a")
    frame = IndexedFrame.from_ordered(df, ["k"])
    assert frame.length == 57 and scans.is_dense(frame.df, KEY) == (True, 57)


@pytest.mark.parametrize("keys", [[0, 1, 3], [0, 1, 1], [0, 0, 3, 3], [1, 2, 3], [0, 1, None], [-1, 0, 1], [0, 2, 2, 2]])
def test_gaps_and_repeats_are_refused(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    with pytest.raises(InvalidParameter):
        IndexedFrame.from_table(df, "k")
    assert IndexedFrame.from_table(df, "k", length=3).length == 3  # vouched for


def test_dense_keys_are_taken(spark):
    assert IndexedFrame.from_table(spark.range(70_000).repartition(5), "id").length == 70_000
    assert IndexedFrame.from_table(spark.range(0), "id").is_empty()


def test_filtered_frames_arent_zipped(spark):
    frame = IndexedFrame.from_indexer(spark, 10, lambda i: i * 2)
    few = frame.filter(F.col(KEY) > 3)
    for a, b in ((few, frame), (frame, few), (few.map(value=F.col("value")), frame), (frame.filter_python(lambda rows: rows["value"] > 4), frame)):
        with pytest.raises(LengthMismatch):
            a.zip(b)
    assert frame.zip(frame.reversed()).df.count() == 10


def test_slices_of_equal_cost(spark):
    rng = random.Random(3)
    costs = [rng.randrange(20) for _ in range(400)]
    costs[50], costs[51], costs[200] = 3000, 2500, 1900
    df = spark.createDataFrame(list(enumerate(costs)), "k int, c int")
    got = sorted(map(tuple, scans.cost_slices(df, ["k"], F.col("c"), 10).collect()))
    mean, found = sum(costs) / 10, {}
    for k, c, s in got:
        found.setdefault(s, []).append((k, c))
    assert sorted(found) == list(range(len(found)))
    assert [k for s in sorted(found) for k, _ in found[s]] == list(range(400))  # contiguous
    for rows in found.values():
        assert sum(c for _, c in rows) <= mean + max(c for _, c in rows)
        assert len(rows) == 1 or all(c < mean for _, c in rows)  # heavy rows are alone
    assert [len(found[s]) for s in found if any(c >= mean for _, c in found[s])] == [1, 1, 1]
    nothing = scans.cost_slices(df, ["k"], F.lit(None).cast("int"), 4)
    assert sorted(r["count"] for r in nothing.groupBy("slice_index").count().collect()) == [100] * 4
    assert scans.cost_slices(df.limit(0), ["k"], F.col("c"), 4).collect() == []


def test_weighted_placement(spark):
    frame = IndexedFrame.from_table(spark.range(1000), "id").with_schedule(Weighted(4, F.col(KEY) + 1))
    placed = frame.place().df.select(F.spark_partition_id().alias("p"), KEY).collect()
    load: dict = {}
    for p, k in placed:
        load[p] = load.get(p, 0) + k + 1
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 2000


def test_edits_as_on_a_list(spark):
    values = list(range(200))
    script = ordered.script(200, 500, seed=11)
    for edit in script:
        if edit.kind == "insert":
            values.insert(edit.at, edit.value)
        elif edit.kind == "set":
            values[edit.at] = edit.value
        else:
            taken = values.pop(edit.at)
            if edit.kind == "move":
                values.insert(edit.to, taken)
    vector = PositionalVector(spark.range(200).select(F.col("id").alias("pos"), F.col("id").alias("value")), 200)
    got = edits.edited(vector, script)
    assert [tuple(r) for r in got.df.orderBy("pos").collect()] == list(enumerate(values)) and len(got) == len(values)
    short = edits.edited(vector, script[:3]).df._jdf.queryExecution().analyzed().toString().count("\n")
    assert got.df._jdf.queryExecution().analyzed().toString().count("\n") <= short + 2  # the plan doesn't grow


def test_ten_thousand_edits_of_orders(spark):
    path = "/root/testdata/sf0.001"
    values = [r[0] for r in spark.read.parquet(f"{path}/orders.parquet").orderBy("o_orderkey").select("o_custkey").collect()]
    for edit in ordered.script(len(values)):
        if edit.kind == "insert":
            values.insert(edit.at, edit.value)
        elif edit.kind == "set":
            values[edit.at] = edit.value
        else:
            taken = values.pop(edit.at)
            if edit.kind == "move":
                values.insert(edit.to, taken)
    assert [r["value"] for r in ordered.edit_script(spark, path).orderBy("pos").collect()] == values


def test_edits_at_the_ends(spark):
    empty = PositionalVector.empty(spark, "string")
    assert [tuple(r) for r in edits.edited(empty, [Edit("insert", 0, "b"), Edit("insert", 0, None), Edit("insert", 2, "c")]).df.orderBy("pos").collect()] == [(0, None), (1, "b"), (2, "c")]
    one = edits.edited(empty, [Edit("insert", 0, "b"), Edit("remove", 0)])
    assert len(one) == 0 and one.df.collect() == [] and edits.edited(empty, []).df.collect() == []
    for wrong in (Edit("remove", 0), Edit("insert", 1, "x"), Edit("set", 0, "x"), Edit("move", 0)):
        with pytest.raises(OutOfBounds):
            edits.edited(empty, [wrong])
    with pytest.raises(InvalidParameter):
        edits.edited(empty, [Edit("turn", 0)])


def test_asof_with_a_crowded_key_ties_and_nulls(spark):
    rng = random.Random(5)
    left = [(k, rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randrange(50)])) for k in range(300)]
    right = [(rng.choice(["hot", "c", "b", None]), rng.choice([None, rng.randrange(50)]), k) for k in range(100)]
    a = spark.createDataFrame(left, "id int, key string, at int")
    b = spark.createDataFrame(right, "key string, place long, found int")
    for strict in (False, True):
        got = temporal.asof_join(a, b, ("at", "place"), ["key"], ["found"], ties=["found"], strict=strict, ranges=9)
        want = []
        for k, key, at in left:
            hits = [(p, f) for g, p, f in right if g is not None and p is not None and g == key and at is not None and (p < at or (p == at and not strict))]
            want.append((k, key, at, max(hits)[1] if hits else None))
        assert sorted(map(tuple, got.collect())) == want
        inner = temporal.asof_join(a, b, ("at", "place"), ["key"], ["found"], ties=["found"], strict=strict, how="inner")
        assert sorted(map(tuple, inner.collect())) == [w for w in want if w[3] is not None]
    assert temporal.asof_join(a, b.limit(0), ("at", "place"), ["key"], ["found"]).filter("found IS NOT NULL").count() == 0
    with pytest.raises(InvalidParameter):
        temporal.asof_join(a, b.withColumn("id", F.lit(1)), ("at", "place"), ["key"])


def test_intervals_with_a_crowded_key_and_time(spark):
    rng = random.Random(6)
    spans = [(k, rng.choice(["hot", "b", None]), rng.choice([None, rng.randrange(40)]), rng.randrange(60)) for k in range(80)]
    points = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, 7, 7, rng.randrange(60)]), k) for k in range(200)]
    a = spark.createDataFrame(spans, "id int, key string, since int, until int")
    b = spark.createDataFrame(points, "key string, at int, p int")
    got = temporal.interval_join(a, b, ("since", "until"), "at", ["key"], ranges=6, block=8).select("id", "p").collect()
    want = [(i, p) for i, g, s, u in spans for h, t, p in points if g is not None and g == h and t is not None and s is not None and s <= t <= u]
    assert sorted(map(tuple, got)) == sorted(want)
    counts = temporal.interval_counts(a, b.select("key", "at"), ("since", "until"), "at", ["key"]).select("id", "points").collect()
    assert {tuple(r) for r in counts} == {(i, sum(w[0] == i for w in want)) for i, *_ in spans if spans[i][1] is not None and spans[i][2] is not None} | {(i, 0) for i, g, s, _ in spans if g is None or s is None}


def test_order_statistics(spark):
    rng = random.Random(7)
    values = [1e308, -1e308, 1e-300, 0.0, 5.0, 5.0] * 20 + [3.0] * 300 + [rng.random() for _ in range(200)]
    rows = [("a", v) for v in values] + [("b", 1.0), ("b", None), (None, 2.0), ("a", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ranks = spark.createDataFrame([("a", k) for k in range(0, 700, 13)] + [("b", 0), ("b", 1), (None, 0), ("z", 0), ("a", -1)], "g string, rank int")
    want = {("a", k): sorted(values)[k] if k < len(values) else None for k in range(0, 700, 13)} | {("b", 0): 1.0, ("b", 1): None, ("z", 0): None, ("a", -1): None, (None, 0): 2.0}
    got = {(r["g"], r["rank"]): r["value"] for r in quantiles.kth(df, ["g"], "v", ranks, bins=4, gathered=10).collect()}
    assert got == want
    plan = quantiles.kth(df, ["g"], "v", ranks)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    with pytest.raises(InvalidParameter):
        quantiles.quantiles(df, ["g"], "v", [1.5])


def test_ranks_with_repeats(spark):
    df = spark.createDataFrame([(k % 10,) for k in range(1000)] + [(None,)], "v int")
    chosen = spark.createDataFrame([(3,), (3,), (None,), (42,), (-1,)], "value int")
    assert sorted(map(tuple, quantiles.ranks_of(df, "v", chosen, 5).collect())) == [(-1, 0, 0), (3, 300, 400), (42, 1000, 1000)]
