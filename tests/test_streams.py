import datetime as dt

import pytest
from pyspark.sql import functions as F

from stridemill.errors import InvalidParameter
from stridemill.operators import expand
from stridemill.sources.frame import KEY, IndexedFrame
from stridemill.streaming import folds

DATA = "/root/testdata/sf0.001"
FAR = dt.datetime(2100, 1, 1)


def shuffled_files(spark, place, days=1):
    """Events in files by time, each row moved by less than ``days``, and a last row that lets all windows end."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    arrival = F.expr(f"ts + make_dt_interval(0, pmod(xxhash64(event_id), {24 * days}))")
    events.withColumn("arrival", arrival).repartitionByRange(8, "arrival").drop("arrival").write.parquet(place)
    spark.createDataFrame([(-1, FAR, -1, "end", 0.0)], events.schema).coalesce(1).write.mode("append").parquet(place)
    paths = sorted((f for f in spark.read.parquet(place).inputFiles()), key=lambda f: spark.read.parquet(f).agg(F.max("ts")).first()[0])
    return events, paths


def in_order(spark, paths, place):
    """The files as a stream that sees them in that order, one a batch."""
    import os
    import shutil
    import time

    os.makedirs(place)
    for k, path in enumerate(paths):
        to = f"{place}/{k:03}.parquet"
        shutil.copyfile(path.removeprefix("file://"), to)
        os.utime(to, (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", 1).parquet(place)


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("events")
    events, paths = shuffled_files(spark, str(base / "files"))
    return events, in_order(spark, paths, str(base / "stream")), str(base)


def aggregates():
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 2)}


def test_sessions_equal_a_batch_fold_after_a_restart(spark, streamed, tmp_path):
    events, stream, _ = streamed
    result = folds.sessions(stream, "ts", "6 hours", "3 days", ["user_id"], **aggregates())
    place, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    seen = []

    def dying(batch, number):
        if number == 4 and not seen:
            seen.append(number)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    query = result.writeStream.outputMode("append").foreachBatch(dying).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    query = folds.run(result, place, checkpoint)
    query.awaitTermination()
    got = folds.results(spark, place, result.schema).filter("user_id >= 0")
    batch = events.groupBy(F.session_window("ts", "6 hours").alias("frame"), "user_id").agg(*(c.alias(k) for k, c in aggregates().items()))
    want = batch.select("frame.start", "frame.end", "user_id", *aggregates())
    rows = lambda df: sorted(map(tuple, df.select("start", "end", "user_id", *aggregates()).collect()))
    assert rows(got) == rows(want)
    assert folds.late_rows(query) == 0 and got.select("batch").distinct().count() > 2
    again = folds.run(result, place, checkpoint)  # nothing new: nothing changes
    again.awaitTermination()
    assert rows(folds.results(spark, place, result.schema).filter("user_id >= 0")) == rows(want)


def test_late_rows_are_counted(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, k)
    files = [[(1, day(1)), (2, day(9))], [(3, day(10))], [(4, day(2)), (5, day(3)), (6, day(9))], [(7, FAR)]]
    paths = []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
        paths += spark.read.parquet(str(tmp_path / f"f{k}")).inputFiles()
    stream = in_order(spark, paths, str(tmp_path / "stream"))
    result = folds.late_counted(stream.withColumn("key", F.lit(1)), "ts", "2 days", ["key"])
    query = folds.run(result, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert folds.late_rows(query) == 2
    assert folds.results(spark, str(tmp_path / "out"), result.schema).agg(F.sum("rows")).first()[0] == 5
    result = folds.windows(stream, "ts", "1 day", "2 days", n=F.count("*"))
    query = folds.run(result, str(tmp_path / "windows"), str(tmp_path / "checkpoint-windows"))
    query.awaitTermination()
    got = {r["start"].day: r["n"] for r in folds.results(spark, str(tmp_path / "windows"), result.schema).filter("start < '2050-01-01'").collect()}
    assert got == {1: 1, 9: 2, 10: 1} and folds.late_rows(query) == 2


def test_state_of_each_worker(spark, streamed, tmp_path):
    events, stream, _ = streamed
    n = events.count()
    result = folds.worker_folds(stream.filter("event_id >= 0"), "event_id", n, 4, lambda: 0.0, lambda s, rows: s + float(rows["value"].sum()), "double")
    query = folds.run(result, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    last = folds.results(spark, str(tmp_path / "out"), result.schema).groupBy("thread_index").agg(F.max_by("value", "batch").alias("value"), F.max("rows").alias("rows"))
    got = {r["thread_index"]: (round(r["value"], 2), r["rows"]) for r in last.collect()}
    frame = IndexedFrame.from_table(events, "event_id")
    from stridemill.operators.fold import fold_with_scratch
    from stridemill.plans.schedule import Static

    want = fold_with_scratch(frame.with_schedule(Static(4)), value=F.round(F.sum("value"), 2), rows=F.count("*"))
    assert got == {r["thread_index"]: (r["value"], r["rows"]) for r in want.collect()}


def test_expansion(spark):
    df = spark.createDataFrame([(0, "a b"), (1, ""), (2, None), (3, "c")], "id long, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    assert sorted(map(tuple, expand.expanded(df, words).select("id", "position", "item").collect())) == [(0, 0, "a"), (0, 1, "b"), (3, 0, "c")]
    assert expand.expanded(df, words, keep_empty=True).count() == 5
    assert sorted(map(tuple, expand.expanded(df, F.create_map(F.lit("k"), "id")).select("item_key", "item_value").collect())) == [("k", k) for k in range(4)]

    def split(batch):
        own = [(t or "").split() for t in batch.column("text").to_pylist()]
        return [len(w) for w in own], {"word": [w for x in own for w in x], "size": [len(w) for x in own for w in x]}

    got = expand.expanded_python(df, ["text"], split, "word string, size int")
    assert sorted(map(tuple, got.select("id", "word", "size").collect())) == [(0, "a", 1), (0, "b", 1), (3, "c", 1)]
    with pytest.raises(InvalidParameter):
        expand.expanded_python(df, ["text"], split, "text string")
    assert sorted(map(tuple, expand.offsets(df, ["id"], F.size(words)).select("id", "first").collect())) == [(0, 0), (1, 2), (2, 2), (3, 2)]
    flat = expand.laid_out(IndexedFrame.from_table(df, "id"), words)
    assert flat.length == 3 and sorted(map(tuple, flat.df.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    assert expand.indexed(got, ["id", "word"]).df.select(KEY).count() == 3
    assert expand.laid_out(IndexedFrame.from_table(df.limit(0), "id"), words).is_empty()
