"""Prefix scans over all rows of a table in a chosen order, and what follows from them: dense numbering and slices of equal cost.

A window without a partition puts every row into one task, and one with a crowded key puts that key's rows there. Here the rows are dealt
into ranges of the order instead, and written once in it with what each range knows by itself (first pass). The last row of
a range has its total; totals, one a range, are scanned on the driver into what each range starts from. A narrow pass adds that to the rows
of the range's first group (second pass). No task ever has more than a range, whatever the keys.

Ranges are cut by the order columns, then by the position of a row in its input partition, so equal rows can be split too. Only where rows are ordered
by long strings do those with equal beginnings stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter
from ..runtime import written

_WHOLE, _REAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)
_FIRST, _LAST = 1, 2


@dataclass(frozen=True)
class Scan:
    """``kind``: count (rows so far), sum, min, max, last (the last value that isn't null), lag (the value of the row before)."""

    kind: str
    column: str | None = None

    def type_in(self, df: DataFrame) -> T.DataType:
        if self.kind == "count":
            return T.LongType()
        own = df.schema[self.column].dataType
        if self.kind == "sum":
            if not isinstance(own, _WHOLE + _REAL):
                raise InvalidParameter(f"{self.column} has no running sum")
            return T.LongType() if isinstance(own, _WHOLE) else T.DoubleType()
        if self.kind in ("min", "max") and not isinstance(own, (*_WHOLE, *_REAL, T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise InvalidParameter(f"{self.column} has no running {self.kind}")
        if self.kind not in ("min", "max", "last", "lag"):
            raise InvalidParameter(f"no scan of kind {self.kind}")
        return own

    def merged(self, before: Any, after: Any) -> Any:
        """Of two neighbouring parts of a group what both know, the later one last."""
        if self.kind == "lag":
            return after
        if before is None or after is None:
            return before if after is None else after
        return {"count": lambda: before + after, "sum": lambda: before + after, "min": lambda: min(before, after), "max": lambda: max(before, after), "last": lambda: after}[self.kind]()

    def with_carry(self, carry: Column, local: Column, first: Column) -> Column:
        if self.kind == "lag":
            return F.when(first, carry).otherwise(local)
        if self.kind in ("count", "sum"):
            return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
        if self.kind == "last":
            return F.coalesce(local, carry)
        return (F.least if self.kind == "min" else F.greatest)(carry, local)  # both skip nulls


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where values differ; null equals null and NaN equals NaN."""
    out = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        both = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
        out = pc.and_(out, pc.invert(both))
    return np.asarray(out)


class _Local:
    """One scan within a range: ``add`` takes batch after batch. ``group`` numbers the rows' groups, ``begin`` has where each row's group begins in the
    batch (-1: before it)."""

    def __init__(self, scan: Scan, kind: pa.DataType):
        self.scan, self.kind, self.carry = scan, kind, None

    def add(self, batch: pa.RecordBatch, group: np.ndarray, begin: np.ndarray) -> pa.Array:
        out = getattr(self, f"_{self.scan.kind}" if self.scan.kind not in ("min", "max") else "_extreme")(batch, group, begin)
        self.carry = batch.column(self.scan.column)[-1] if self.scan.kind == "lag" else out[-1]
        return out

    def _count(self, batch, group, begin) -> pa.Array:
        before = self.carry.as_py() if self.carry is not None else 0
        return pa.array(np.arange(len(begin)) + 1 - np.maximum(begin, 0) + np.where(begin < 0, before, 0))

    def _numbers(self, batch: pa.RecordBatch, empty: Any) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(self.scan.column)
        if pa.types.is_temporal(column.type):
            column = column.cast(pa.int64() if pa.types.is_timestamp(column.type) else pa.int32()).cast(pa.int64())
        null = np.asarray(pc.is_null(column, nan_is_null=True))
        kind = pa.float64() if pa.types.is_floating(column.type) else pa.int64()
        return np.where(null, empty(kind), np.asarray(pc.fill_null(column.cast(kind), 0))), null

    def _sum(self, batch, group, begin) -> pa.Array:
        value, null = self._numbers(batch, lambda kind: 0)
        head = begin < 0
        if self.carry is not None and self.carry.is_valid and head[0]:
            value[0] += self.carry.as_py()
            null[0] = False
        total = pd.Series(value).groupby(group).cumsum().to_numpy()
        seen = pd.Series(~null).groupby(group).cummax().to_numpy()
        return pa.array(total, self.kind, mask=~seen.astype(bool))

    def _extreme(self, batch, group, begin) -> pa.Array:
        low = self.scan.kind == "max"
        empty = lambda kind: (-np.inf if low else np.inf) if kind == pa.float64() else (np.iinfo(np.int64).min if low else np.iinfo(np.int64).max)
        value, null = self._numbers(batch, empty)
        if self.carry is not None and self.carry.is_valid and begin[0] < 0:
            before = self.carry.as_py() if not pa.types.is_temporal(self.kind) else self.carry.value
            value[0] = (max if low else min)(value[0], before)
            null[0] = False
        by = pd.Series(value).groupby(group)
        best = (by.cummax() if low else by.cummin()).to_numpy()
        seen = pd.Series(~null).groupby(group).cummax().to_numpy().astype(bool)
        plain = pa.array(best, mask=~seen)
        return plain.cast(pa.int32()).cast(self.kind) if pa.types.is_date32(self.kind) else plain.cast(self.kind)

    def _taken(self, column: pa.Array, at: np.ndarray, begin: np.ndarray) -> pa.Array:
        """``column`` at places that lie in the row's group, what came before the batch where the group does too, else null."""
        before = pa.array([self.carry.as_py() if self.carry is not None else None], column.type)
        place = np.where(at >= np.maximum(begin, 0), at + 1, np.where(begin < 0, 0, -1))
        return pa.concat_arrays([before, column]).take(pa.array(place, mask=place < 0))

    def _last(self, batch, group, begin) -> pa.Array:
        column = batch.column(self.scan.column)
        valid = np.asarray(pc.is_valid(column))
        return self._taken(column, np.maximum.accumulate(np.where(valid, np.arange(len(begin)), -1)), begin)

    def _lag(self, batch, group, begin) -> pa.Array:
        return self._taken(batch.column(self.scan.column), np.arange(len(begin)) - 1, begin)


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that ``df`` doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


#: Characters of a string that ranges are cut by.
CUT = 64


def _fixed(kind: T.DataType) -> bool:
    """Whether values of a type take a bounded number of bytes."""
    if isinstance(kind, T.StructType):
        return all(_fixed(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.VariantType)


def in_ranges(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """The rows in ranges of the order, one a partition, each sorted; and the name of the column that has the range's number.

    Groups (``by``) come in the order of two hashes of their keys. What ranges are cut by is sampled to the driver, so it's kept short: strings by their first
    CUT characters, after which no further column cuts, nor does one of no fixed size. Columns that aren't given by name should be short."""
    number, place = _names(df, "range", "place")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n <= 0:
        raise InvalidParameter("at least one range is needed")
    told = [x for c in by for x in (F.col(c), F.col(c).isNull())]
    groups = [F.xxhash64(*told), F.xxhash64(F.lit("second"), *told)] if by else []
    cut, whole = list(groups), True
    for c in order:
        kind = df.schema[c].dataType if isinstance(c, str) else None
        if kind is None or _fixed(kind):
            cut.append(c)
            continue
        if isinstance(kind, T.StringType | T.BinaryType):
            cut.append(F.substring(c, 1, CUT))
        whole = False
        break
    dealt = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(n, *(cut or [order[0]]), *([place] if whole else []))
    return dealt.sortWithinPartitions(*groups, *order, place).drop(place).withColumn(number, F.spark_partition_id()), number


def _edged(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Batches with rows; whether they are the first and the last ones."""
    held, first = None, True
    for batch in stream:
        if len(batch):
            if held is not None:
                yield held, first, False
                first = False
            held = batch
    if held is not None:
        yield held, first, True


def scan(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), ranges: int | None = None, **scans: Scan) -> DataFrame:
    """``df`` with a column for each of ``scans``, over the rows of its group (``by``) up to and including each row, in ``order``.

    The order should tell all rows of a group apart; otherwise which of equal ones comes first is open. Nulls come first in
    ascending columns and are a group of their own in ``by``; sums and extremes skip nulls and NaN, and are null before the first value.
    """
    if not scans:
        raise InvalidParameter("nothing to scan")
    types = {name: s.type_in(df) for name, s in scans.items()}
    dealt, number = in_ranges(df, order, ranges, by)
    head, edge, *local = _names(dealt, "head", "edge", *(f"{name}_here" for name in scans))
    schema = T.StructType([*dealt.schema.fields, T.StructField(head, T.BooleanType()), T.StructField(edge, T.IntegerType()), *(T.StructField(c, t) for c, t in zip(local, types.values(), strict=True))])
    arrow = {name: _arrow_type(t) for name, t in types.items()}

    def first_pass(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Local(s, arrow[name]) for name, s in scans.items()]
        before: list[pa.Array] | None = None  # the keys of the last row
        groups = 0
        for batch, is_first, is_last in _edged(stream):
            n = len(batch)
            new = np.zeros(n, bool)
            for k, c in enumerate(by):
                column = batch.column(c)
                new[1:] |= _differs(column.slice(0, n - 1), column.slice(1))
                if before is not None:
                    new[0] |= _differs(before[k], column.slice(0, 1))[0]
            new[0] |= is_first
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            group = groups + np.cumsum(new) - int(is_first)
            flags = np.zeros(n, np.int32)
            flags[0] |= _FIRST * is_first
            flags[-1] |= _LAST * is_last
            columns = [x.add(batch, group, starts) for x in own]
            before, groups = [batch.column(c).slice(n - 1) for c in by], int(group[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group == 0), pa.array(flags), *columns], [*batch.schema.names, head, edge, *local])

    kept = written(dealt.mapInArrow(first_pass, schema), "scan")
    told = [c for c in dict.fromkeys([*by, *(s.column for s in scans.values() if s.kind == "lag")])]
    edges = kept.filter(F.col(edge) > 0).select(F.col(number).alias("r"), F.col(edge).alias("e"), F.col(head).alias("h"), F.struct(*(F.col(c) for c in told), F.lit(0)).alias("row"), F.struct(*local).alias("here")).collect()
    carries = _carries(edges, list(scans.values()), by)
    carried = [f"{c}_before" for c in local]
    table = df.sparkSession.createDataFrame(carries, T.StructType([T.StructField(number, T.IntegerType()), *(T.StructField(c, t) for c, t in zip(carried, types.values(), strict=True))]))
    joined = kept.join(F.broadcast(table), number, "left")
    first = (F.col(edge).bitwiseAND(_FIRST)) > 0
    out = []
    for name, s, here, before in zip(scans, scans.values(), local, carried, strict=True):
        out.append(F.when(F.col(head) & F.col(before).isNotNull(), s.with_carry(F.col(before), F.col(here), first)).otherwise(F.col(here)).alias(name))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in scans), *out)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _carries(edges: list, scans: list[Scan], by: Sequence[str]) -> list[tuple]:
    """What the rows before each range leave to its first group; (range, values) where that's anything."""
    same = lambda a, b: a == b or (a != a and b != b)
    out, before, last = [], None, None
    for r in sorted(edges, key=lambda x: (x["r"], x["e"])):
        if r["e"] & _FIRST:
            goes_on = last is not None and all(same(last["row"][c], r["row"][c]) for c in by)
            before = before if goes_on else None
            if before is not None:
                out.append((r["r"], *before))
        if r["e"] & _LAST:
            local = [r["row"][s.column] if s.kind == "lag" else r["here"][k] for k, s in enumerate(scans)]
            before = [s.merged(b, v) for s, b, v in zip(scans, before, local, strict=True)] if before is not None and r["h"] else local
            last = r
    return out


def scan_python(df: DataFrame, order: Sequence[str | Column], name: str, kind: str, step: Callable[[Any, pd.DataFrame], Sequence], combine: Callable[[Any, Any], Any], ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``, what an associative fold has after each row.

    ``step`` takes what the fold has (None at the start of a range) and the next rows in order, and returns what it has after each of them; ``combine`` puts
    what earlier rows and later rows have together."""
    dealt, number = in_ranges(df, order, ranges)
    edge, here, before = _names(dealt, "edge", f"{name}_here", f"{name}_before")

    def first_pass(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch, _, is_last in _edged(stream):
            values = list(step(state, batch.to_pandas()))
            state = values[-1]
            flags = np.zeros(len(batch), bool)
            flags[-1] = is_last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags), pa.array(values)], [*batch.schema.names, edge, here])

    schema = T.StructType([*dealt.schema.fields, T.StructField(edge, T.BooleanType()), T.StructField(here, T._parse_datatype_string(kind))])
    kept = written(dealt.mapInArrow(first_pass, schema), "scan")
    totals = sorted(kept.filter(edge).select(number, here).collect())
    carries, state = [], None
    for r, total in totals:
        if state is not None:
            carries.append((r, state))
        state = total if state is None else combine(state, total)
    table = df.sparkSession.createDataFrame(carries, f"`{number}` int, `{before}` {kind}")

    def second_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            known = rows[before].notna()
            rows[here] = [combine(b, v) if k else v for k, b, v in zip(known, rows[before], rows[here], strict=True)]
            yield rows.drop(columns=[before]).rename(columns={here: name})

    joined = kept.join(F.broadcast(table), number, "left").select(*(f"`{c}`" for c in df.columns), before, here)
    return joined.mapInPandas(second_pass, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "task_index", ranges: int | None = None, ties: bool = True) -> DataFrame:
    """``df`` with a dense number from 0 on, in ``order``. ``ties``: the other columns, as they come, decide between equal rows: strings by their first
    CUT characters, and what's longer or of no fixed size by its hash, after all others."""
    named = {c for c in order if isinstance(c, str)}
    plain = [f for f in df.schema.fields if f.name not in named and not isinstance(f.dataType, T.MapType | T.VariantType)]
    short = [f.name if _fixed(f.dataType) else F.substring(f.name, 1, CUT) for f in plain if _fixed(f.dataType) or isinstance(f.dataType, T.StringType | T.BinaryType)]
    long = [f.name for f in plain if not _fixed(f.dataType)]
    made = scan(df, [*order, *([*short, *([F.xxhash64(*long)] if long else [])] if ties else [])], ranges=ranges, **{name: Scan("count")})
    return made.withColumn(name, F.col(name) - 1)


def cost_slices(df: DataFrame, order: Sequence[str | Column], cost: Column, slices: int, name: str = "slice_index", ranges: int | None = None) -> DataFrame:
    """``df`` with the slice of each row: contiguous in ``order``, each within one row's cost of the mean, and rows of a mean or more alone.

    A row is in the slice that its cost begins in; one that costs a mean or more starts a slice, and the next row is beyond it. Costs that are null or
    negative count as nothing; where all do, every row counts as one. Slices are numbered from 0 without gaps, at most 2 * ``slices`` of them.
    """
    if slices <= 0:
        raise InvalidParameter("at least one slice is needed")
    own, upto = _names(df, "cost", "cost_upto")
    costed = df.withColumn(own, F.greatest(F.coalesce(cost, F.lit(0)), F.lit(0)))
    total = costed.agg(F.sum(own)).first()[0] or 0
    if total == 0:
        costed = df.withColumn(own, F.lit(1).cast("long"))
        total = costed.count()
    made = scan(costed, order, ranges=ranges, **{upto: Scan("sum", own)})
    begins, whole = F.col(upto) - F.col(own), isinstance(costed.schema[own].dataType, _WHOLE)
    part = F.call_function("div", begins.cast("decimal(38,0)") * slices, F.lit(int(total)).cast("decimal(38,0)")) if whole else F.floor(begins * slices / F.lit(float(total)))
    raw = F.least(part.cast("long"), F.lit(slices - 1).cast("long")) * 2 + (F.col(own) * slices >= F.lit(total)).cast("long")
    cut = made.withColumn(name, raw)
    used = sorted(r[0] for r in cut.select(name).distinct().collect())
    dense = df.sparkSession.createDataFrame(list(enumerate(used)), f"dense long, `{name}` long")
    return cut.join(F.broadcast(dense), name).select(*(f"`{c}`" for c in df.columns if c != name), F.col("dense").alias(name))


def is_dense(df: DataFrame, key: str) -> tuple[bool, int]:
    """Whether ``key`` has each number from 0 on just once, and the number of rows. Exact, by one bitmap of 4 KB for each 32,768 numbers."""
    k = F.col(key).cast("long")
    marked = df.filter(k >= 0).groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"), F.count("*").alias("n"), F.max(k).alias("most"))
    one = marked.agg(F.sum(F.bitmap_count("bits")).alias("distinct"), F.sum("n").alias("n"), F.max("most").alias("most")).first()
    n, rows = one["n"] or 0, df.count()
    return rows == n == (one["distinct"] or 0) == (one["most"] if one["most"] is not None else -1) + 1, rows


def group_ranks(df: DataFrame, order: Sequence[str | Column], by: Sequence[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's number within its group, from 1 on, crowded groups included."""
    return scan(df, order, by, ranges, **{name: Scan("count")})


__all__ = ["Scan", "cost_slices", "group_ranks", "in_ranges", "is_dense", "numbered", "scan", "scan_python"]
