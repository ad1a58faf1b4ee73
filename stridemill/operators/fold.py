"""Per-worker folds: partial aggregates keyed by the worker, combined by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from ..errors import InvalidParameter
from ..sources.frame import IndexedFrame


def fold_with_scratch(frame: IndexedFrame, every_slot: bool = False, initial: dict[str, Any] | None = None, **aggregates: Column) -> DataFrame:
    """``thread_index`` and the aggregates of each worker's rows. ``every_slot``: workers without rows too, with ``initial`` values."""
    slots = frame.df.groupBy(frame.worker().alias("thread_index")).agg(*(c.alias(name) for name, c in aggregates.items()))
    if not every_slot:
        return slots
    workers = frame.df.sparkSession.range(frame.schedule.workers).withColumnRenamed("id", "thread_index")
    return workers.join(slots, "thread_index", "left").fillna({k: v for k, v in (initial or {}).items() if v is not None})


def fold_total(frame: IndexedFrame, **aggregates: Column) -> DataFrame:
    """All slots combined: one row."""
    return frame.df.agg(*(c.alias(name) for name, c in aggregates.items()))


def fold_python(frame: IndexedFrame, zero: Callable[[], Any], fold: Callable[[Any, pd.DataFrame], Any], combine: Callable[[Any, Any], Any], schema_type: str, slots: int | None = None) -> DataFrame:
    """(thread_index, value) for an accumulator of any kind.

    Each partition folds its own rows first, so one small partial per partition and worker is all that moves, and no
    task ever holds a worker's rows. ``combine`` must be associative. ``slots``, if given, must cover all workers.
    """
    workers = frame.schedule.workers
    if slots is not None and slots < workers:
        raise InvalidParameter("fewer slots than workers")
    schema = f"thread_index long, value {schema_type}"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scratch: dict[int, Any] = {}
        for rows in frames:
            worker = rows["thread_index"].to_numpy()
            cuts = [0, *(np.flatnonzero(worker[1:] != worker[:-1]) + 1).tolist(), len(worker)]  # rows of a worker mostly lie together
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    k = int(worker[a])
                    scratch[k] = fold(scratch[k] if k in scratch else zero(), rows.iloc[a:b])
        yield pd.DataFrame({"thread_index": list(scratch), "value": list(scratch.values())})

    def final(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        value = zero()
        for x in rows["value"]:
            value = combine(value, x)
        return pd.DataFrame({"thread_index": [key[0]], "value": [value]})

    owned = frame.df.withColumn("thread_index", frame.worker())
    return owned.mapInPandas(partial, schema).groupBy("thread_index").applyInPandas(final, schema)
