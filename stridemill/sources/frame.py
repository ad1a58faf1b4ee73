"""Indexed frames: rows that a dense long key addresses, with lazy map, filter and zip."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter, LengthMismatch
from ..functions.split import owner_col, to_local, to_shard
from ..operators.scans import is_dense, numbered
from ..plans.schedule import Dynamic, Schedule, Static

KEY = "task_index"


class IndexedFrame:
    """A plan over the index space [start, start + length). ``df`` has the key ``task_index`` and the payload.

    ``length`` is the length of the source and stays through filters: it's what a schedule divides. ``count()`` counts
    the rows that are left. Nothing runs before an action on the frame that a terminal returns.
    """

    def __init__(self, df: DataFrame, length: int, start: int = 0, schedule: Schedule | None = None, whole: bool = True):
        self.df, self.length, self.start, self.schedule, self.whole = df, length, start, schedule or Static(), whole

    # sources

    @classmethod
    def from_range(cls, spark: SparkSession, start: int, end: int) -> IndexedFrame:
        """The indices themselves; ``task_index`` is absolute."""
        return cls(spark.range(start, max(start, end)).withColumnRenamed("id", KEY), max(0, end - start), start)

    @classmethod
    def from_indexer(cls, spark: SparkSession, n: int, item: Callable[[Column], Column], name: str = "value") -> IndexedFrame:
        """Items computed from their index, not stored."""
        frame = cls.from_range(spark, 0, n)
        return cls(frame.df.withColumn(name, item(F.col(KEY))), n)

    @classmethod
    def from_table(cls, df: DataFrame, key: str, length: int | None = None, check: bool = True) -> IndexedFrame:
        """Rows of a table whose ``key`` is dense and unique from 0. That's checked, exactly, and a gap or a repeat refused, unless the caller vouches for
        it with ``length`` or ``check=False``; the count then comes from the files' footers if it isn't given."""
        if length is None and check:
            dense, length = is_dense(df, key)
            if not dense:
                raise InvalidParameter(f"{key} isn't a dense key from 0; from_ordered numbers rows")
        n = df.count() if length is None else length
        return cls(df.withColumn(key, F.col(key).cast("long")).withColumnRenamed(key, KEY), n)

    @classmethod
    def from_ordered(cls, df: DataFrame, order: list[str | Column], ties: bool = True) -> IndexedFrame:
        """Rows of any table, numbered in ``order``; ``ties``: equal ones by their other columns. The length comes with the numbering."""
        made = numbered(df, order, KEY, ties=ties)
        return cls(made.select(KEY, *(f"`{c}`" for c in made.columns if c != KEY)), made.count())

    # adaptors

    def _with(self, df: DataFrame, whole: bool = True) -> IndexedFrame:
        return IndexedFrame(df, self.length, self.start, self.schedule, self.whole and whole)

    def map(self, **columns: Column) -> IndexedFrame:
        """The key and the columns given, in place of the payload."""
        return self._with(self.df.select(KEY, *(c.alias(name) for name, c in columns.items())))

    def update(self, **columns: Column) -> IndexedFrame:
        """The payload with some columns overwritten or added."""
        return self._with(self.df.withColumns(columns))

    def update_static(self, **columns: Column) -> IndexedFrame:
        """``update`` with each worker's rows in one partition, in order."""
        return self._with(Static(self.schedule.workers).place(self.df.withColumns(columns), KEY, self.length))

    def update_dynamic(self, **columns: Column) -> IndexedFrame:
        """``update`` with rows wherever they are: whichever worker is free takes the next."""
        return self.with_schedule(Dynamic(self.schedule.workers)).update(**columns)

    def update_with_prong(self, columns: Callable[[Column, Column], dict[str, Column]], shards: int = 4) -> IndexedFrame:
        """``update`` by columns of the worker and the shard that have a row."""
        prong = self.with_prong(shards)
        return self._with(prong.df.withColumns(columns(F.col("thread_index"), F.col("colocation_index"))).drop("thread_index", "colocation_index"))

    def filter(self, predicate: Column) -> IndexedFrame:
        """Rows for which the predicate is true (null counts as false). Keys stay, length stays."""
        return self._with(self.df.filter(predicate), whole=False)

    def map_python(self, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> IndexedFrame:
        """An opaque function from batches to batches, for what expressions can't say; the schema has the key."""

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield function(frame)

        return self._with(self.df.mapInPandas(batches, schema))

    def map_index_batches(self, function: Callable[[np.ndarray], Any], kind: str) -> IndexedFrame:
        """``value`` from an opaque function of the bare indices: a batch of them at once, and as many values back."""
        return self._with(self.df.select(KEY)).map_python(lambda rows: pd.DataFrame({KEY: rows[KEY], "value": function(rows[KEY].to_numpy())}), f"{KEY} long, value {kind}")

    def map_prong_batches(self, function: Callable[[np.ndarray, np.ndarray, np.ndarray], Any], kind: str, shards: int = 4) -> IndexedFrame:
        """``value`` from an opaque function of indices, workers and shards, a batch at once."""
        names = [KEY, "thread_index", "colocation_index"]
        prong = self.with_prong(shards)
        return self._with(prong._with(prong.df.select(*names)).map_python(lambda rows: pd.DataFrame({KEY: rows[KEY], "value": function(*(rows[c].to_numpy() for c in names))}), f"{KEY} long, value {kind}").df)

    def map_index_python(self, function: Callable[[int], Any], kind: str) -> IndexedFrame:
        """``map_index_batches`` for a function of one index: a call a row."""
        return self.map_index_batches(lambda index: [function(i) for i in index.tolist()], kind)

    def map_prong_python(self, function: Callable[[int, int, int], Any], kind: str, shards: int = 4) -> IndexedFrame:
        """``map_prong_batches`` for a function of one index, worker and shard: a call a row."""
        return self.map_prong_batches(lambda *columns: [function(*row) for row in zip(*(c.tolist() for c in columns), strict=True)], kind, shards)

    def filter_python(self, predicate: Callable[[pd.DataFrame], pd.Series]) -> IndexedFrame:
        made = self.map_python(lambda frame: frame[predicate(frame).astype(bool)], self.df.schema)
        return made._with(made.df, whole=False)

    def zip(self, other: IndexedFrame, names: tuple[str, str] = ("left", "right"), columns: tuple[str, str] = ("value", "value")) -> IndexedFrame:
        """Pairs of equal index; lengths must be equal, and neither side filtered, as an index that one side lacks would take the other's item with it."""
        if self.length != other.length or self.start != other.start:
            raise LengthMismatch("only frames of one length can be zipped")
        if not (self.whole and other.whole):
            raise LengthMismatch("a filtered frame has gaps; zip first, or number it anew by from_ordered")
        left = self.df.select(KEY, F.col(columns[0]).alias(names[0]))
        right = other.df.select(KEY, F.col(columns[1]).alias(names[1]))
        return self._with(left.join(right, KEY))

    def reversed(self) -> IndexedFrame:
        """The same items in the opposite order of keys."""
        return self._with(self.df.withColumn(KEY, F.lit(2 * self.start + self.length - 1) - F.col(KEY)))

    def with_schedule(self, schedule: Schedule) -> IndexedFrame:
        return IndexedFrame(self.df, self.length, self.start, schedule, self.whole)

    def place(self) -> IndexedFrame:
        """The frame with its rows dealt as the schedule says, for opaque functions to find them so."""
        return self._with(self.placed())

    # context

    def worker(self) -> Column:
        """The worker that a static schedule gives a row to."""
        return owner_col(F.col(KEY) - self.start, self.length, self.schedule.workers)

    def with_prong(self, shards: int = 4) -> IndexedFrame:
        """With ``thread_index`` and ``colocation_index``, by formula and not by where rows happen to lie."""
        shards = min(shards, self.schedule.workers)
        return self._with(self.df.withColumn("thread_index", self.worker()).withColumn("colocation_index", owner_col(F.col("thread_index"), self.schedule.workers, shards)))

    def sharded(self, shards: int) -> IndexedFrame:
        """With the round-robin ``colocation_index`` and ``local_index``."""
        if shards <= 0:
            raise InvalidParameter("at least one shard is needed")
        return self._with(self.df.withColumns({"colocation_index": to_shard(F.col(KEY), shards), "local_index": to_local(F.col(KEY), shards)}))

    # terminals

    def placed(self) -> DataFrame:
        """The rows dealt into partitions as the schedule says."""
        return self.schedule.place(self.df, KEY, self.length)

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.length == 0

    def for_each_batches(self, effect: Callable[[pd.DataFrame], None]) -> int:
        """Run ``effect`` over all rows, an Arrow batch at once, and return how many rows that was. A retried task repeats its effects: at least once;
        the count is of rows, each once."""

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = 0
            for frame in frames:
                effect(frame)
                seen += len(frame)
            yield pd.DataFrame({"seen": [seen]})

        return self.placed().mapInPandas(batches, "seen long").agg(F.sum("seen")).first()[0] or 0

    def for_each(self, effect: Callable[[Iterator], None]) -> None:
        """Run ``effect`` over the rows of each partition, one by one: for effects that need rows. A retried task repeats its effects: at least once."""
        self.placed().foreachPartition(effect)

    def for_each_static(self, effect: Callable[[Iterator], None]) -> None:
        self.with_schedule(Static(self.schedule.workers)).for_each(effect)

    def for_each_dynamic(self, effect: Callable[[Iterator], None]) -> None:
        self.with_schedule(Dynamic(self.schedule.workers)).for_each(effect)

    def for_each_with_prong(self, effect: Callable[[Iterator], None], shards: int = 4) -> None:
        """As ``for_each``; rows have their worker and shard."""
        self.with_prong(shards).for_each(effect)

    def slices(self) -> DataFrame:
        """The ranges that the schedule hands tasks out in."""
        return self.schedule.slices(self.df.sparkSession, self.length)
