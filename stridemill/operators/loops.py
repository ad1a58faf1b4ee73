"""The scheduling operators as tables: which worker gets which tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.split import block_count_col, block_first_col, local_worker_col, owner, owner_col, permuted
from ..sources.frame import KEY, IndexedFrame


def _numbers(spark: SparkSession, n: int, name: str) -> DataFrame:
    if n <= 0:
        raise InvalidParameter("at least one worker is needed")
    return spark.range(n).withColumnRenamed("id", name)


def for_threads(spark: SparkSession, workers: int = 8, shards: int = 4) -> DataFrame:
    """One row per worker with its shard."""
    rows = _numbers(spark, workers, "thread_index")
    return rows.withColumn("colocation_index", owner_col(F.col("thread_index"), workers, min(shards, workers)))


def located_threads(spark: SparkSession, workers: int = 8, shards: int = 4) -> DataFrame:
    """``for_threads`` with each worker's number within its shard."""
    return for_threads(spark, workers, shards).withColumn("local_thread", local_worker_col(F.col("thread_index"), workers, min(shards, workers)))


def shard_of(worker: Column, workers: int, shards: int) -> Column:
    """A worker's shard; for numbers that no worker has, the number of shards."""
    shards = min(shards, workers)
    return F.when((worker >= 0) & (worker < workers), owner_col(worker, workers, shards)).otherwise(F.lit(shards).cast("long"))


def threads_per_shard(spark: SparkSession, workers: int = 8, shards: int = 4) -> DataFrame:
    """(colocation_index, first, count): the workers of every shard."""
    return split_ranges(spark, workers, min(shards, workers), "colocation_index")


def split_ranges(spark: SparkSession, n: int, parts: int, name: str = "thread_index") -> DataFrame:
    """(name, first, count) of every block of the balanced split, empty ones too."""
    k = F.col(name)
    return _numbers(spark, parts, name).select(name, block_first_col(k, n, parts).alias("first"), block_count_col(k, n, parts).alias("count"))


def for_n(frame: IndexedFrame) -> DataFrame:
    """Every task with its worker."""
    return frame.df.withColumn("thread_index", frame.worker())


def for_slices(frame: IndexedFrame, *aggregates: Column) -> DataFrame:
    """One row per non-empty slice: worker, first task, number of tasks and any aggregates over it. One partial and one final aggregation."""
    slots = for_n(frame).groupBy("thread_index")
    return slots.agg(F.min(KEY).alias("first"), F.count("*").alias("count"), *aggregates)


def for_n_dynamic(frame: IndexedFrame) -> DataFrame:
    """Every task, in whatever partitions its source has. The same rows as ``for_n``, without the worker, which isn't fixed."""
    return frame.placed()


def static_tail(spark: SparkSession, n: int, workers: int) -> DataFrame:
    """The one task that a dynamic schedule fixes for each worker: the last ones."""
    first = max(n - workers, 0)
    return _numbers(spark, workers, "thread_index").select("thread_index", (F.col("thread_index") + first).alias(KEY)).filter(F.col(KEY) < n)


def static_tail_by_shard(spark: SparkSession, n: int, workers: int, shards: int) -> DataFrame:
    """The same where each shard has a range of tasks of its own: (thread_index, colocation_index, task_index)."""
    shards = min(shards, workers)
    rows = located_threads(spark, workers, shards)
    shard = F.col("colocation_index")
    first, count = block_first_col(shard, n, shards), block_count_col(shard, n, shards)
    local = F.greatest(count - block_count_col(shard, workers, shards), F.lit(0)) + F.col("local_thread")
    return rows.filter(local < count).select("thread_index", "colocation_index", (first + local).cast("long").alias(KEY))


def probing_order(spark: SparkSession, workers: int, shards: int) -> DataFrame:
    """(thread_index, step, colocation_index): whose tasks a free worker takes. Its own shard's come first; the others follow in a
    stride that is co-prime with their number and depends on the worker, so that free workers don't all turn to the same shard."""
    shards = min(shards, workers)
    rows = []
    for worker in range(workers):
        own = owner(worker, workers, shards)
        first, *others = permuted(0, shards, worker)
        rows += [(worker, step, shard) for step, shard in enumerate([own, *(x for x in (*others, first) if x != own)])]
    return spark.createDataFrame(rows, "thread_index long, step long, colocation_index long")


def coverage(df: DataFrame, key: str = KEY) -> DataFrame:
    """What shows whether each index was reached once: count, distinct_count, lo and hi."""
    return df.agg(F.count("*").alias("count"), F.countDistinct(key).alias("distinct_count"), F.min(key).alias("lo"), F.max(key).alias("hi"))
