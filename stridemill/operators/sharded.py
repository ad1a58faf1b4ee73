"""Round-robin sharded vectors: element g lies in shard g % C at place g div C."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.split import to_global, to_local, to_shard
from .vector import PositionalVector


class ShardedVector:
    """A vector with computed shards. Edits keep the placement, as it follows from the global index."""

    def __init__(self, vector: PositionalVector, shards: int = 4):
        if shards <= 0:
            raise InvalidParameter("at least one shard is needed")
        self.vector, self.shards = vector, shards

    @classmethod
    def empty(cls, spark: SparkSession, kind: str, shards: int = 4) -> ShardedVector:
        return cls(PositionalVector.empty(spark, kind), shards)

    @classmethod
    def from_table(cls, df: DataFrame, key: str, value: str, shards: int = 4, length: int | None = None) -> ShardedVector:
        return cls(PositionalVector.from_table(df, key, value, length), shards)

    def _new(self, vector: PositionalVector) -> ShardedVector:
        return ShardedVector(vector, self.shards)

    def __len__(self) -> int:
        return self.vector.length

    def is_empty(self) -> bool:
        return self.vector.is_empty()

    def placement(self) -> DataFrame:
        """(global_index, colocation_index, local_index, value)."""
        g = F.col("pos")
        return self.vector.df.select(g.alias("global_index"), to_shard(g, self.shards).alias("colocation_index"), to_local(g, self.shards).alias("local_index"), "value")

    def inverse(self) -> DataFrame:
        """(global_index, back): the global index computed back from shard and place."""
        g = F.col("pos")
        return self.vector.df.select(g.alias("global_index"), to_global(to_local(g, self.shards), to_shard(g, self.shards), self.shards).alias("back"))

    def length_at(self, shard: int) -> int:
        if not 0 <= shard < self.shards:
            raise InvalidParameter(f"shard {shard} of {self.shards}")
        return len(self) // self.shards + (shard < len(self) % self.shards)

    def lengths(self) -> DataFrame:
        """(colocation_index, len) as counted, empty shards too."""
        counted = self.placement().groupBy("colocation_index").agg(F.count("*").alias("n"))
        every = self.vector.df.sparkSession.range(self.shards).withColumnRenamed("id", "colocation_index")
        return every.join(counted, "colocation_index", "left").select("colocation_index", F.coalesce("n", F.lit(0)).cast("long").alias("len"))

    def shard(self, number: int) -> DataFrame:
        """Rows of one shard; none if there's no such shard."""
        return self.placement().filter(F.col("colocation_index") == number)

    def get(self, g: int) -> DataFrame:
        """(global_index, value) at an index; no row if out of bounds."""
        return self.vector.get(g).select(F.col("pos").alias("global_index"), "value")

    def rows(self) -> DataFrame:
        return self.vector.df.select(F.col("pos").alias("global_index"), "value")

    def push(self, value: Any) -> ShardedVector:
        return self._new(self.vector.push(value))

    def pop(self) -> tuple[ShardedVector, DataFrame]:
        rest, value = self.vector.pop()
        return self._new(rest), value

    def fill(self, value: Any) -> ShardedVector:
        return self._new(self.vector.fill(value))

    def fill_with(self, item: Callable[[Column], Column]) -> ShardedVector:
        return self._new(self.vector.fill_with(item))

    def clear(self) -> ShardedVector:
        return self._new(self.vector.clear())

    def resize(self, length: int, value: Any) -> ShardedVector:
        """As each shard cut or grown by itself, since placement is round-robin."""
        return self._new(self.vector.resize(length, value))

    def update(self, item: Callable[[Column], Column]) -> ShardedVector:
        """Every value replaced by an expression of it."""
        return self._new(self.vector._new(self.vector.df.select("pos", item(F.col("value")).alias("value")), len(self)))
