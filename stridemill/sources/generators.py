"""Random inputs of the two applications, from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(key: str, n: int, low: float, high: float, seed: int):
    """From a hash of key and seed, so that it doesn't depend on partitions."""
    return F.lit(low) + F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(n), F.lit(seed)), 11) * F.lit((high - low) * 2.0**-53)


def embeddings(spark: SparkSession, n: int, dims: int = 64, seed: int = 42) -> DataFrame:
    """(vec_id, embedding) with components uniform in [-1, 1)."""
    parts = F.array(*(_uniform("vec_id", d, -1.0, 1.0, seed).cast("float") for d in range(dims)))
    return spark.range(n).withColumnRenamed("id", "vec_id").select("vec_id", parts.alias("embedding"))


def bodies(spark: SparkSession, n: int, seed: int = 42, masses: tuple[float, float] = (1e20, 1e25)) -> DataFrame:
    """(id, x, y, z, vx, vy, vz, m): positions and velocities uniform in [0, 1)."""
    unit = [_uniform("id", k, 0.0, 1.0, seed).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))]
    return spark.range(n).select("id", *unit, _uniform("id", 6, *masses, seed).alias("m"))
