"""Exact order statistics by histogram refinement, without a sort.

Each wanted rank has an interval that holds its value. A round counts each interval's rows in ``BINS`` bins of equal width, together with each
bin's least and largest value, and narrows the interval to the bin that has the rank. Counts are combined before they're
shuffled, so a group with very many rows is a few partial rows a task. Once an interval has one value or at most ``GATHERED`` rows it's done.

Which bin a value is in never decreases with the value, whatever doubles are rounded to, so results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidParameter
from ..runtime import written
from .scans import Scan, scan

BINS = 4096
GATHERED = 4096


def _valued(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The groups and the value as ``v``; nulls and NaN have no rank."""
    v = F.col(value)
    return df.select(*by, v.cast("double").alias("v") if df.schema[value].dataType.simpleString() in ("float", "double") else v.cast("decimal(38,6)").alias("v")).filter("v IS NOT NULL").filter("v = v AND NOT isnan(v)")


def kth(df: DataFrame, by: Sequence[str], value: str, ranks: DataFrame, bins: int = BINS, gathered: int = GATHERED) -> DataFrame:
    """(by, rank, value): the element of each ``rank`` (from 0) of its group, for all rows (by, rank) of ``ranks``; null beyond the group's end.

    Values are compared as doubles, or as decimals of six places where they aren't floating-point numbers."""
    rows, by = _valued(df, by, value), list(by)
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = ranks.select(*by, F.col("rank").cast("long").alias("rank")).distinct()
    sizes = whole.select(*(F.col(c).alias(f"of_{c}") for c in by), "n", "lo", "hi")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    joined = wanted.join(sizes if by else F.broadcast(sizes), same, "left").select(*by, "rank", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "lo", "hi")
    state = written(joined.withColumn("left", F.col("rank")), "ranks")
    none = state.filter("rank < 0 OR rank >= n").select(*by, "rank", F.lit(None).cast(rows.schema["v"].dataType).alias("value"))
    state, done = state.filter("rank >= 0 AND rank < n"), none
    keys = [*by, "rank"]
    while True:
        done = done.unionByName(state.filter("lo = hi").select(*keys, F.col("lo").alias("value")))
        open_, few = state.filter(f"lo < hi AND n > {gathered}"), state.filter(f"lo < hi AND n <= {gathered}")
        found = _within(rows, few, by).groupBy(*keys, "left").agg(F.sort_array(F.collect_list("v")).alias("all"))
        done = done.unionByName(found.select(*keys, F.expr("element_at(all, CAST(left AS INT) + 1)").alias("value")))
        if open_.isEmpty():
            return done.withColumn("value", F.col("value").cast(df.schema[value].dataType))
            # halves keep the difference of the largest doubles finite
        place = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1)).cast("long")
        counts = _within(rows, open_, by).withColumn("bin", place).groupBy(*keys, "left", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))  # at most ``bins`` rows
        cut = counts.withColumn("upto", upto).filter("left < upto AND left >= upto - n")
        state = written(cut.select(*keys, "n", "lo", "hi", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left")), "ranks")


def _within(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Each row with every interval of its group that it's in."""
    spans = state.select(*(F.col(c).alias(f"of_{c}") for c in by), "rank", "left", "lo", "hi")
    on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(F.broadcast(spans) if not by else spans, on).drop(*(f"of_{c}" for c in by))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float], interpolate: bool = True, **how) -> DataFrame:
    """(by, quantile, value): exact quantiles of each group. ``interpolate``: between the two neighbouring elements, else the first element whose share of
    rows up to it is ``quantile`` or more."""
    if any(not 0 <= q <= 1 for q in at):
        raise InvalidParameter("quantiles are from 0 to 1")
    by = list(by)
    sizes = _valued(df, by, value).groupBy(*by).agg(F.count("*").alias("n")).filter("n > 0")
    q = F.explode(F.array(*(F.lit(float(x)) for x in at)))
    asked = written(sizes.withColumn("quantile", q), "quantiles")
    exact = F.col("quantile") * (F.col("n") - 1)
    low = F.floor(exact) if interpolate else F.greatest(F.ceil(F.col("quantile") * F.col("n")) - 1, F.lit(0))
    asked = asked.withColumns({"low": low.cast("long"), "high": (F.ceil(exact) if interpolate else low).cast("long"), "part": exact - F.floor(exact)})
    ranks = asked.select(*by, F.explode(F.array("low", "high")).alias("rank"))
    found = written(kth(df, by, value, ranks, **how), "elements")
    of = lambda name: found.select(*(F.col(c).alias(f"{name}_{c}") for c in by), F.col("rank").alias(f"{name}_rank"), F.col("value").alias(f"{name}_value"))
    out = asked
    for name in ("low", "high"):
        on = F.col(name) == F.col(f"{name}_rank")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
        out = out.join(of(name), on)
    if not interpolate:
        return out.select(*by, "quantile", F.col("low_value").alias("value"))
    a, b = F.col("low_value").cast("double"), F.col("high_value").cast("double")
    return out.select(*by, "quantile", F.when(F.col("part") == 0, a).otherwise(a + (b - a) * F.col("part")).alias("value"))


def ranks_of(df: DataFrame, value: str, chosen: DataFrame, ranges: int | None = None) -> DataFrame:
    """(value, below, upto): for every distinct value of ``chosen`` (a column ``value``), how many rows of ``df`` have less, and how many not more.

    Rows are counted by value first, so the sweep has one row for each distinct value and repeated ones cost nothing."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    asked = chosen.select(F.col("value").cast(df.schema[value].dataType)).filter("value IS NOT NULL").distinct()
    both = counts.withColumn("asked", F.lit(False)).unionByName(asked.select("value", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    merged = both.groupBy("value").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    swept = scan(merged, ["value"], ranges=ranges, upto=Scan("sum", "n"))
    return swept.filter("asked").select("value", (F.col("upto") - F.col("n")).alias("below"), "upto")
