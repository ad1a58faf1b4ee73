"""Mergeable sketches as accumulators, folded by partitions and merged as a tree.

Each partition folds its rows into one small state for each group. States are then merged FAN at a time, level by level, so no task ever
gets the states of all partitions, and what comes out doesn't depend on who merges with whom beyond the bounds that each sketch states.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter
from ..runtime import written

#: States that one task merges into one.
FAN = 16


class Sketch(Protocol):
    """What ``tree_fold`` needs of an accumulator: something that can be pickled, takes batches of values and merges with another."""

    def add(self, values: np.ndarray) -> None: ...

    def merge(self, other: Any) -> None: ...


class Quantiles:
    """Ranks within ``error`` rows of the truth, which is known with the sketch and about n * log2(n / k) / k at most.

    Level h holds values that stand for 2**h rows each. A full level is sorted and every other value moves up; which of each two it is
    alternates. Moving up changes the rank of any value by at most the weight 2**h, and that's what's added to ``error``."""

    def __init__(self, k: int = 1024):
        if k < 2:
            raise InvalidParameter("at least two values are kept")
        self.k, self.n, self.error, self.levels, self.odd = k, 0, 0, [np.empty(0)], [0]

    def add(self, values: np.ndarray) -> None:
        values = np.asarray(values, float)
        values = values[~np.isnan(values)]
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compact()

    def merge(self, other: Quantiles) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.odd.append(0)
        for h, own in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], own])
        self.n, self.error = self.n + other.n, self.error + other.error
        self._compact()

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            own = self.levels[h]
            if len(own) > self.k:
                own = np.sort(own)
                stays, pairs = own[len(own) - len(own) % 2 :], own[: len(own) - len(own) % 2]
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.odd.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], pairs[self.odd[h] :: 2]])
                self.odd[h] ^= 1
                self.levels[h] = stays
                self.error += 1 << h
            h += 1

    def value(self, q: float) -> float | None:
        """A value whose rank is within ``error`` of q * (n - 1)."""
        if not self.n:
            return None
        values = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weight[order])
        return float(values[order][min(np.searchsorted(upto, q * (self.n - 1), "right"), len(values) - 1)])


class HeavyHitters:
    """Counts that are too small by ``error`` at most, of all values that have more than ``error`` rows; ``error`` is n / (k + 1) at most."""

    def __init__(self, k: int = 256):
        if k < 1:
            raise InvalidParameter("at least one value is kept")
        self.k, self.n, self.error, self.counts = k, 0, 0, {}

    def add(self, values: np.ndarray) -> None:
        found = pd.Series(values).value_counts(dropna=True)
        self.n += int(found.sum())
        for value, n in found.items():
            self.counts[value] = self.counts.get(value, 0) + int(n)
        self._cut()

    def merge(self, other: HeavyHitters) -> None:
        for value, n in other.counts.items():
            self.counts[value] = self.counts.get(value, 0) + n
        self.n, self.error = self.n + other.n, self.error + other.error
        self._cut()

    def _cut(self) -> None:
        """Take from all what the (k + 1)st has, so that k are left: k + 1 rows go for each unit of error."""
        if len(self.counts) > self.k:
            least = sorted(self.counts.values(), reverse=True)[self.k]
            self.error += least
            self.counts = {v: n - least for v, n in self.counts.items() if n > least}


class Distinct:
    """The number of distinct values within about 1.04 / sqrt(2**p), from hashes of 64 bits. The state depends on the set of values only."""

    def __init__(self, p: int = 12):
        if not 4 <= p <= 18:
            raise InvalidParameter("p is from 4 to 18")
        self.p, self.registers = p, np.zeros(1 << p, np.uint8)

    def add(self, values: np.ndarray) -> None:
        h = np.asarray(values).astype(np.int64).view(np.uint64)
        place, rest = (h >> np.uint64(64 - self.p)).astype(np.int64), h << np.uint64(self.p)
        # the number of zeros before the first one of the other bits, and one more
        zeros = np.where(rest == 0, 64 - self.p, 63 - np.floor(np.log2(np.maximum(rest >> np.uint64(11), 1).astype(float))).astype(int) - 11)
        np.maximum.at(self.registers, place, (zeros + 1).astype(np.uint8))

    def merge(self, other: Distinct) -> None:
        np.maximum(self.registers, other.registers, out=self.registers)

    def estimate(self) -> float:
        m = len(self.registers)
        raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -self.registers.astype(float))
        empty = int((self.registers == 0).sum())
        return float(m * np.log(m / empty)) if raw <= 2.5 * m and empty else float(raw)


def tree_fold(df: DataFrame, value: str, sketch: Sketch, by: Sequence[str] = (), fan: int = FAN) -> DataFrame:
    """(by, state): one pickled sketch for each group. ``sketch`` is the empty one; nulls of ``value`` aren't added."""
    if fan < 2:
        raise InvalidParameter("at least two states are merged")
    empty, by = pickle.dumps(sketch), list(by)
    keys = [T.StructField(c, df.schema[c].dataType) for c in by]
    schema = T.StructType([*keys, T.StructField("part", T.LongType()), T.StructField("state", T.BinaryType())])

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Sketch] = {}
        for batch in stream:
            table = pa.Table.from_batches([batch])
            kept = table.filter(table.column(value).is_valid())
            groups = kept.select(by).to_pandas().groupby(by, dropna=False, sort=False).indices.items() if by else [((), None)]
            values = kept.column(value).to_numpy()
            for key, rows in groups:
                own = values if rows is None else values[rows]
                if len(own):
                    key = tuple(None if k != k else k for k in (key if isinstance(key, tuple) else (key,)))
                    if key not in states:
                        states[key] = pickle.loads(empty)
                    states[key].add(own)
        part = TaskContext.get().partitionId()
        columns = [pa.array([k[i] for k in states], kind) for i, kind in enumerate(arrow)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(states), pa.int64()), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*by, "part", "state"])

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("state").to_pylist(), strict=True), key=lambda r: r[0])
        state = pickle.loads(rows[0][1])
        for _, other in rows[1:]:
            state.merge(pickle.loads(other))
        first = table.slice(0, 1).select(by)
        return pa.table([*first.columns, pa.array([rows[0][0] // fan], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=[*by, "part", "state"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in keys]
    level = written(df.select(*by, value).mapInArrow(partial, schema), "states")
    most = level.agg(F.max("part")).first()[0]
    while most:
        level = level.groupBy(*by, F.expr(f"part div {fan}").alias("of")).applyInArrow(merged, schema)
        most //= fan
    return level.select(*by, "state")


def read_with(states: DataFrame, function, schema: str) -> DataFrame:
    """What ``function`` says of each state, a list of values in place of it."""
    by = [f for f in states.schema.fields if f.name != "state"]
    told = T._parse_datatype_string(schema)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [function(pickle.loads(s)) for s in frame["state"]]
            keys = frame[[f.name for f in by]].loc[np.repeat(frame.index, [len(x) for x in found])].reset_index(drop=True)
            values = pd.DataFrame([v for x in found for v in x], columns=told.names)
            yield pd.concat([keys, values], axis=1)

    return states.mapInPandas(rows, T.StructType([*by, *told.fields]))


def heavy_hitters(df: DataFrame, value: str, share: float, by: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """(by, value, n): exact counts of all values with more than ``share`` of their group's rows. The sketch finds candidates, which are then counted."""
    if not 0 < share < 1:
        raise InvalidParameter("a share is between 0 and 1")
    by = list(by)
    states = written(tree_fold(df, value, HeavyHitters(k or int(2 / share)), by), "heavy")
    kind, taken = df.schema[value].dataType.simpleString(), set(df.columns)
    own = [next(n for n in (f"{'_' * k}{name}" for k in range(99)) if n not in taken) for name in ("candidate", "whole", *(f"of_{c}" for c in by))]
    candidate, whole, *of = own
    wanted = read_with(states, lambda s: [(v, s.n) for v, n in s.counts.items() if n + s.error > share * s.n], f"`{candidate}` {kind}, `{whole}` long")
    wanted = wanted.select(*(F.col(c).alias(o) for c, o in zip(by, of, strict=True)), candidate, whole)
    on = F.col(value) == F.col(candidate)
    for c, o in zip(by, of, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(o))
    # at most 1 / share candidates pass for each group, so they are few beside the rows
    counted = df.select(*by, value).join(wanted, on).groupBy(*by, candidate, whole).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > F.col(whole) * share).select(*by, F.col(candidate).alias("value"), "n")


def distinct_counts(df: DataFrame, value: str, by: Sequence[str] = (), p: int = 12) -> DataFrame:
    """(by, estimate) of the distinct values that aren't null."""
    hashed = df.select(*by, F.when(F.col(value).isNotNull(), F.xxhash64(value)).alias("hash"))
    return read_with(tree_fold(hashed, "hash", Distinct(p), by), lambda s: [(s.estimate(),)], "estimate double")


def approximate_quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), k: int = 1024) -> DataFrame:
    """(by, quantile, value, error, n): ``error`` is how many rows the value's rank may be off by at most."""
    asked = [float(q) for q in at]
    states = tree_fold(df.select(*by, F.col(value).cast("double").alias(value)), value, Quantiles(k), by)
    return read_with(states, lambda s: [(q, s.value(q), s.error, s.n) for q in asked], "quantile double, value double, error long, n long")
