"""Folds over streams of rows: event-time windows, sessions and per-worker state, with output that a restart doesn't repeat.

A stream's batches are folded with Structured Streaming's state, which is checkpointed; rows later than the watermark are left out and counted. Each batch's
output replaces the folder of its number, so a batch that runs again after a crash writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidParameter
from ..functions.split import owner_col
from ..operators.scans import in_ranges
from ..runtime import written


def windows(stream: DataFrame, at: str, size: str, watermark: str, by: Sequence[str] = (), slide: str | None = None, **aggregates: Column) -> DataFrame:
    """(start, end, by, aggregates) of each window of ``size``, once the watermark has passed its end."""
    frame = F.window(at, size, slide) if slide else F.window(at, size)
    return _framed(stream.withWatermark(at, watermark), frame, by, aggregates)


def sessions(stream: DataFrame, at: str, gap: str, watermark: str, by: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """(start, end, by, aggregates) of each run of rows less than ``gap`` apart, once the watermark has passed its end. ``end`` is the last row's time plus the gap."""
    return _framed(stream.withWatermark(at, watermark), F.session_window(at, gap), by, aggregates)


def _framed(stream: DataFrame, frame: Column, by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    if not aggregates:
        raise InvalidParameter("nothing to fold")
    made = stream.groupBy(frame.alias("frame"), *by).agg(*(c.alias(name) for name, c in aggregates.items()))
    return made.select(F.col("frame.start").alias("start"), F.col("frame.end").alias("end"), *by, *aggregates)


def worker_folds(stream: DataFrame, key: str, n: int, workers: int, zero: Callable[[], Any], fold: Callable[[Any, pd.DataFrame], Any], kind: str) -> DataFrame:
    """(thread_index, value, rows): after each batch, what each worker that got rows has folded so far. ``key`` places rows by the balanced split of [0, n).

    A worker's state is its accumulator; batches come in any order within a trigger, so ``fold`` must not depend on the order of rows."""
    schema = T.StructType([T.StructField("value", T._parse_datatype_string(kind)), T.StructField("rows", T.LongType())])
    out = T.StructType([T.StructField("thread_index", T.LongType()), *schema.fields])

    def update(worker: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, rows = state.get if state.exists else (zero(), 0)
        for frame in frames:
            value, rows = fold(value, frame), rows + len(frame)
        state.update((value, rows))
        yield pd.DataFrame({"thread_index": [int(worker[0])], "value": [value], "rows": [rows]})

    placed = stream.withColumn("thread_index", owner_col(F.col(key), n, workers).cast("long"))
    return placed.groupBy("thread_index").applyInPandasWithState(update, out, schema, "append", GroupStateTimeout.NoTimeout)


def late_counted(stream: DataFrame, at: str, watermark: str, by: Sequence[str]) -> DataFrame:
    """(by, rows): per batch, the rows that came in time, by key. Rows later than the watermark are dropped row by row before, so ``late_rows`` of its query is exact."""
    keyed = stream.withWatermark(at, watermark)
    out = T.StructType([*(stream.schema[c] for c in by), T.StructField("rows", T.LongType())])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(f) for f in frames)
        if not state.hasTimedOut and n:
            yield pd.DataFrame([(*key, n)], columns=out.names)

    return keyed.groupBy(*by).applyInPandasWithState(update, out, T.StructType([T.StructField("n", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query: StreamingQuery) -> int:
    """How many rows (or, where a fold combines rows first, partial results) this run of the query has left out as too late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def run(result: DataFrame, place: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start writing a stream's result: all input that there is now, then it ends. Started again with the same folders it goes on behind what is done."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    return result.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, place: str, schema: T.StructType) -> DataFrame:
    """All that a stream has written to ``place``, with the number of each row's batch."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).option("basePath", place).parquet(place)


def replayed(df: DataFrame, at: str, place: str, files: int) -> DataFrame:
    """A table as a stream in order of time: dealt into ``files`` ranges of time, each written to ``place`` as one file after the one before, as a
    stream's source takes the oldest file first, and read back a file a batch."""
    dealt, number = in_ranges(df, [at], files)
    kept = written(dealt, "replay")
    for k in range(files):
        kept.filter(F.col(number) == k).drop(number).coalesce(1).write.mode("append").parquet(place)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place)
