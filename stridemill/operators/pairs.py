"""All pairs of two tables without a cross join that depends on one side being small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which the replicated side is broadcast: its counted rows times what a row takes.
BROADCAST_BYTES = 64 << 20
#: Rows of each side in a block, where both sides are dealt into blocks.
BLOCK_ROWS = 32_768
#: Pairs that a task should have: about a tenth of a second's work for a light kernel, whatever the partitions that rows come in.
TASK_PAIRS = 1 << 24


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def against_all(rows: DataFrame, others: DataFrame, key: str, row_bytes: int = 64, broadcast_bytes: int = BROADCAST_BYTES, blocks: int | None = None) -> DataFrame:
    """Each of ``rows`` with each of ``others``, a row per pair: for small inputs, and to check what works by blocks.

    ``others`` is broadcast while its counted rows times ``row_bytes`` are within the bound. Beyond, ``rows`` are dealt into
    blocks by their key and ``others`` sent once to each: an equi-join on the block, whose tasks stay small.
    """
    if others.count() * row_bytes <= broadcast_bytes:
        return rows.crossJoin(F.broadcast(others))
    n = blocks or _blocks(rows.count(), BLOCK_ROWS)
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n)))
    copies = others.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return dealt.join(copies, "__block").drop("__block")


def by_blocks(
    rows: DataFrame,
    others: DataFrame,
    key: str,
    other_key: str,
    kernel: Callable[[Iterator[pa.Table], pa.Table], pa.Table],
    schema: str,
    row_bytes: int,
    broadcast_bytes: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """What ``kernel`` makes of parts of ``rows`` against parts of ``others``, without a row per pair. The caller combines what it makes.

    While ``others`` is within the bound in bytes (counted rows times ``row_bytes``) it is broadcast, and a part of ``rows`` is a
    partition, given batch by batch. Rows are dealt out anew where that makes more tasks: one for each TASK_PAIRS pairs, so work is spread however few
    files the rows come from. Beyond the bound, both sides are dealt into blocks, and each pair of blocks is a group of its own.
    """
    bound, block = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes, block or BLOCK_ROWS
    n_others = others.count()
    if n_others * row_bytes <= bound:
        every = rows.sparkSession.sparkContext.broadcast(others.toArrow())

        def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from kernel((pa.Table.from_batches([b]) for b in batches), every.value).to_batches()

        return spread(rows, n_others, key).mapInArrow(partition, schema)
    n, m = _blocks(rows.count(), block), _blocks(n_others, block)
    numbers = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    left = rows.select("*", F.pmod(F.xxhash64(key), F.lit(n)).alias("__row_block"), numbers(m).alias("__other_block"))
    right = others.select("*", numbers(n).alias("__row_block"), F.pmod(F.xxhash64(other_key), F.lit(m)).alias("__other_block"))
    keys = ["__row_block", "__other_block"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(lambda a, b: kernel(iter([a]), b), schema)


def spread(rows: DataFrame, n_others: int, key: str) -> DataFrame:
    """``rows`` in a partition for each TASK_PAIRS pairs with ``n_others`` others, unless a scan's splits, by the planner's size, are as many."""
    n = rows.count()
    wanted = min(n, _blocks(n * n_others, TASK_PAIRS))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(wanted, key) if wanted > max(1, size // split) else rows
