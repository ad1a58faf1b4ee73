"""Expanding adaptors: a row becomes any number of rows, with opaque functions in Arrow batches or with expressions, and dense indices for what comes out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter
from ..sources.frame import KEY, IndexedFrame
from .scans import Scan, scan

#: Rows that an opaque function gets at once.
BATCH = 2048


def expanded(df: DataFrame, items: Column, name: str = "item", position: str = "position", keep_empty: bool = False) -> DataFrame:
    """``df`` with a row for each element of the array (or entry of the map) ``items`` and its place in it; ``keep_empty``: one with nulls where there's none."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    kinds = df.select(items.alias("x")).schema["x"].dataType
    names = [position, name] if isinstance(kinds, T.ArrayType) else [position, f"{name}_key", f"{name}_value"]
    return df.select("*", explode(items).alias(*names))


def expanded_python(df: DataFrame, columns: Sequence[str], function: Callable[[pa.RecordBatch], tuple[Sequence[int], dict[str, Sequence]]], schema: str) -> DataFrame:
    """``df`` joined sideways with what ``function`` makes of each row: it gets batches of ``columns`` and returns how many rows each row
    becomes, and the new columns' values, those of the first row first. Columns of ``df`` are repeated; rows that become none go."""
    told = T._parse_datatype_string(schema)
    if taken := set(told.names) & set(df.columns):
        raise InvalidParameter(f"the table has {sorted(taken)}")
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in told.fields]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for k in range(0, len(whole), BATCH):
                batch = whole.slice(k, BATCH)
                counts, made = function(batch.select(list(columns)))
                at = pa.array(np.repeat(np.arange(len(batch)), np.asarray(counts, np.int64)))
                new = [pa.array(made[f.name], kind) for f, kind in zip(told.fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), *new], [*batch.schema.names, *told.names])

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, *told.fields]))


def indexed(df: DataFrame, order: Sequence[str | Column]) -> IndexedFrame:
    """What an expansion has made as an indexed frame: numbered in ``order``, which should tell all rows apart."""
    return IndexedFrame.from_ordered(df, list(order))


def offsets(df: DataFrame, order: Sequence[str | Column], count: Column, name: str = "first") -> DataFrame:
    """``df`` with where each row's elements begin if all rows' elements (``count`` each, null as none) are laid one after another. No element is made for it."""
    n = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("long")
    made = scan(df.withColumn("__count", n), order, **{name: Scan("sum", "__count")})
    return made.withColumn(name, F.col(name) - F.col("__count")).drop("__count")


def laid_out(frame: IndexedFrame, items: Column, name: str = "value") -> IndexedFrame:
    """The elements of all rows one after another, as a frame of their own: element j of row i has the index of i's first element plus j."""
    placed = offsets(frame.df.withColumn("__items", items), [KEY], F.size("__items"), "__first")
    made = placed.select((F.col("__first")).alias("__first"), F.posexplode("__items").alias("__j", name))
    length = int(placed.agg(F.coalesce(F.max(F.col("__first") + F.greatest(F.size("__items"), F.lit(0))), F.lit(0))).first()[0])
    return IndexedFrame(made.select((F.col("__first") + F.col("__j")).cast("long").alias(KEY), name), length)
