"""Scheduling policies. They change how rows lie in partitions, and never what a plan returns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.split import block_count_col, block_first_col, owner_col


class Schedule(Protocol):
    """What an indexed frame needs of a policy; anything with these three can stand in for it."""

    workers: int

    def place(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """The rows in the partitions that the policy wants."""
        ...

    def slices(self, spark: SparkSession, n: int) -> DataFrame:
        """(slice_index, first, count): the ranges that tasks 0 to n - 1 are handed out in."""
        ...


def _slices(spark: SparkSession, n: int, parts: int) -> DataFrame:
    k = F.col("slice_index")
    every = spark.range(parts).withColumnRenamed("id", "slice_index").select(k, block_first_col(k, n, parts).alias("first"), block_count_col(k, n, parts).alias("count"))
    return every.filter("count > 0")


@dataclass(frozen=True)
class Static:
    """One contiguous slice for each of ``workers``."""

    workers: int = 8

    def __post_init__(self):
        if self.workers <= 0:
            raise InvalidParameter("at least one worker is needed")

    def place(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """Rows of slice k in partition k, ascending: a shuffle, so only for kernels that need the physical slices."""
        placed = df.repartitionById(self.workers, owner_col(F.col(key), n, self.workers).cast("int"))
        return placed.sortWithinPartitions(key)

    def slices(self, spark: SparkSession, n: int) -> DataFrame:
        return _slices(spark, n, self.workers)


@dataclass(frozen=True)
class Dynamic:
    """Whichever worker is free takes the next partition: what Spark does with a scan's splits as they are, so nothing moves.

    How small the splits are is ``spark.sql.files.maxPartitionBytes``; ``factor`` slices for each worker are what ``slices`` tells."""

    workers: int = 8
    factor: int = 4

    def __post_init__(self):
        if self.workers <= 0 or self.factor <= 0:
            raise InvalidParameter("at least one worker is needed")

    def place(self, df: DataFrame, key: str, n: int) -> DataFrame:
        return df

    def slices(self, spark: SparkSession, n: int) -> DataFrame:
        return _slices(spark, n, self.workers * self.factor)


@dataclass(frozen=True)
class Weighted:
    """Slices of equal ``cost`` (a column of the rows), contiguous in the key, rows of a mean or more alone; ``factor`` slices for each worker, so that whoever is free takes the next."""

    workers: int
    cost: Column
    factor: int = 4

    def __post_init__(self):
        if self.workers <= 0 or self.factor <= 0:
            raise InvalidParameter("at least one worker is needed")

    def sliced(self, df: DataFrame, key: str) -> DataFrame:
        """The rows with their ``slice_index``. Only keys and costs are scanned; where slices begin is a list as long as there are slices."""
        from ..operators.scans import cost_slices

        made = cost_slices(df.select(key, self.cost.alias("cost")), [key], F.col("cost"), self.workers * self.factor)
        begins = sorted(r[1] for r in made.groupBy("slice_index").agg(F.min(key)).collect())
        at = F.size(F.filter(F.array(*(F.lit(b) for b in begins)), lambda b: b <= F.col(key))) - 1 if begins else F.lit(0)
        return df.withColumn("slice_index", at.cast("long"))

    def place(self, df: DataFrame, key: str, n: int) -> DataFrame:
        """Rows of slice k in partition k, ascending: one scan of the costs and one shuffle."""
        placed = self.sliced(df, key).repartitionById(2 * self.workers * self.factor, F.col("slice_index").cast("int"))
        return placed.sortWithinPartitions(key).drop("slice_index")

    def slices(self, spark: SparkSession, n: int) -> DataFrame:
        """Where costs aren't known: slices of equal length."""
        return _slices(spark, n, self.workers * self.factor)
