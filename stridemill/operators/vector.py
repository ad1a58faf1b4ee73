"""Growable vectors as frames (pos, value): every edit returns a new vector, by arithmetic on positions and not by moving rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OutOfBounds


class PositionalVector:
    """``df`` has pos (long, dense from 0) and value; ``length`` is known, so bounds are checked before anything runs."""

    def __init__(self, df: DataFrame, length: int, shard: int = 0):
        self.df, self.length, self.shard = df, length, shard

    @classmethod
    def empty(cls, spark: SparkSession, kind: str | T.DataType, shard: int = 0) -> PositionalVector:
        kind = kind.simpleString() if isinstance(kind, T.DataType) else kind
        return cls(spark.createDataFrame([], f"pos long, value {kind}"), 0, shard)

    @classmethod
    def from_table(cls, df: DataFrame, key: str, value: str, length: int | None = None) -> PositionalVector:
        n = df.count() if length is None else length
        return cls(df.select(F.col(key).cast("long").alias("pos"), F.col(value).alias("value")), n)

    def _new(self, df: DataFrame, length: int) -> PositionalVector:
        return PositionalVector(df, length, self.shard)

    def _type(self) -> T.DataType:
        return self.df.schema["value"].dataType

    def _row(self, pos: int, value: Any) -> DataFrame:
        return self.df.sparkSession.range(1).select(F.lit(pos).cast("long").alias("pos"), F.lit(value).cast(self._type()).alias("value"))

    def _checked(self, pos: int, limit: int) -> int:
        if not 0 <= pos < limit:
            raise OutOfBounds(f"position {pos} of {self.length}")
        return pos

    def __len__(self) -> int:
        return self.length

    def is_empty(self) -> bool:
        return self.length == 0

    def capacity(self, needed: int | None = None, before: int = 0) -> int:
        """Slots that a growing array would hold; there's nothing to reserve in a frame."""
        needed = self.length if needed is None else needed
        return before if needed <= before else max(needed, 2 * before, 4)

    def reserve(self, more: int) -> PositionalVector:
        if self.length + more >= 2**63:
            raise OutOfBounds("more elements than positions can number")
        return self

    # growing and shrinking

    def push(self, value: Any) -> PositionalVector:
        return self._new(self.df.unionByName(self._row(self.length, value)), self.length + 1)

    def pop(self) -> tuple[PositionalVector, DataFrame]:
        """Without the last element, and that element: a row, or none where the vector is empty."""
        last = self.length - 1
        return self._new(self.df.filter(F.col("pos") < last), max(last, 0)), self.df.filter(F.col("pos") == last).select("value")

    def insert(self, at: int, value: Any) -> PositionalVector:
        self._checked(at, self.length + 1)
        moved = self.df.withColumn("pos", F.col("pos") + (F.col("pos") >= at).cast("long"))
        return self._new(moved.unionByName(self._row(at, value)), self.length + 1)

    def remove(self, at: int) -> tuple[PositionalVector, DataFrame]:
        """Without an element, and that element."""
        self._checked(at, self.length)
        rest = self.df.filter(F.col("pos") != at).withColumn("pos", F.col("pos") - (F.col("pos") > at).cast("long"))
        return self._new(rest, self.length - 1), self.df.filter(F.col("pos") == at).select("value")

    def extend(self, other: PositionalVector) -> PositionalVector:
        shifted = other.df.withColumn("pos", F.col("pos") + self.length)
        return self._new(self.df.unionByName(shifted), self.length + other.length)

    def clear(self) -> PositionalVector:
        return self._new(self.df.limit(0), 0)

    def truncate(self, length: int) -> PositionalVector:
        return self if length >= self.length else self._new(self.df.filter(F.col("pos") < length), length)

    def resize(self, length: int, value: Any) -> PositionalVector:
        return self.resize_with(length, lambda pos: F.lit(value))

    def resize_with(self, length: int, item: Callable[[Column], Column]) -> PositionalVector:
        """Cut, or grown by items computed from their position."""
        if length <= self.length:
            return self.truncate(length)
        new = self.df.sparkSession.range(self.length, length).select(F.col("id").alias("pos"), item(F.col("id")).cast(self._type()).alias("value"))
        return self._new(self.df.unionByName(new), length)

    # reading

    def get(self, at: int | range) -> DataFrame:
        """(pos, value) of a position or a whole range; no rows if any of it is out of bounds."""
        where = at if isinstance(at, range) else range(at, at + 1)
        if where.start < 0 or where.stop > self.length:
            return self.df.limit(0)
        return self.df.filter((F.col("pos") >= where.start) & (F.col("pos") < where.stop))

    def at(self, pos: int) -> DataFrame:
        """The row at a position, which must exist."""
        return self.get(self._checked(pos, self.length))

    def first_last(self) -> DataFrame:
        """One row (first, last); null where the vector is empty."""
        return self.df.agg(F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"))

    def contains(self, value: Any) -> DataFrame:
        """One row (found). NaN is equal to nothing, itself included."""
        hit = F.col("value") == F.lit(value)
        if isinstance(self._type(), T.FloatType | T.DoubleType):
            hit = hit & ~F.isnan("value")
        return self.df.filter(hit).limit(1).agg((F.count("*") > 0).alias("found"))

    # reordering and overwriting

    def swap(self, a: int, b: int) -> PositionalVector:
        self._checked(a, self.length)
        self._checked(b, self.length)
        pos = F.when(F.col("pos") == a, F.lit(b)).when(F.col("pos") == b, F.lit(a)).otherwise(F.col("pos")).cast("long")
        return self._new(self.df.withColumn("pos", pos), self.length)

    def reverse(self) -> PositionalVector:
        return self._new(self.df.withColumn("pos", F.lit(self.length - 1).cast("long") - F.col("pos")), self.length)

    def fill(self, value: Any) -> PositionalVector:
        return self.fill_with(lambda pos: F.lit(value).cast(self._type()))

    def fill_with(self, item: Callable[[Column], Column]) -> PositionalVector:
        return self._new(self.df.select("pos", item(F.col("pos")).alias("value")), self.length)
