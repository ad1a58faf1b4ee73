"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder

#: Spark's settings for what ``stored`` writes: a query's shuffle files go at its end; rows, and bytes, that Python gets at once.
CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Word separators of the byte-oriented operators: space and U+0009 to U+000D. ``bytes.split()`` splits at just these.
SEPARATORS = " \t\n\x0b\x0c\r"


class _Made(threading.local):
    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    _made.paths.append(shared_folder(spark, name))
    return _made.paths[-1]


def discard(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders that this thread's operators have made, once what was read from them is stored elsewhere."""
    for place in [p for p in _made.paths if p not in keep]:
        _delete(spark, place)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if place in _made.paths:
        _made.paths.remove(place)


def stored(df: DataFrame, name: str, batch: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing.

    The write's shuffle files go as soon as it's done; nothing reads them again. ``batch``: rows that Python gets at once, where they are long;
    ``batch_bytes``: about so many bytes of them, whatever their length."""
    spark, place = df.sparkSession, new_folder(df.sparkSession, name)
    settings = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {}) | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(place)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made = spark.read.schema(df.schema).parquet(place)
    made.place = place
    return made


def forget(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``stored`` has returned and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.place)


#: A key is hot if more rows carry it than a HOT-th of an even share of one shuffle partition.
HOT = 4


def spread_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows``, which are stored, joined to the one row of ``values`` for each ``key``.

    Keys that more rows carry than a task should get are joined by broadcast: by that measure there are at most HOT for each
    shuffle partition, whatever the data. The others are joined by a shuffle, whose tasks then stay even."""
    share = rows.count() / (HOT * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = stored(rows.groupBy(key).count().filter(F.col("count") > share).select(key).join(values, key), "hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each id, that with the smallest text digest (rows without an id all stay).

    Of rows with one text the smallest hash of the other columns decides; where no id repeats, the input is returned."""
    some = F.col(id_col).isNotNull()
    twice = docs.filter(some).groupBy(id_col).count().filter("count > 1")
    if twice.isEmpty():
        return docs
    own, least = fresh(docs, "own_order"), fresh(docs, "least_order")
    plain = [f"`{f.name}`" for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    keyed = docs.filter(some).withColumn(own, F.struct(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), F.xxhash64(*plain)))
    first = stored(keyed.groupBy(F.col(id_col).alias(fresh(docs, "of"))).agg(F.min(own).alias(least)), "first")
    of = first.columns[0]
    kept = keyed.join(first, (F.col(id_col) == F.col(of)) & (F.col(own) == F.col(least))).dropDuplicates([id_col]).select(*(f"`{c}`" for c in docs.columns))
    return stored(kept.unionByName(docs.filter(~some)), "one-row-per-id")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` and ``text`` (null as empty), whatever else the input has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text each; a longer text is a batch of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        block = np.cumsum(size) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(size)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, after which the worker forgets what it has learned and gives free memory back to the system.

    Workers live on between tasks, and would otherwise keep their largest task's memory beside the executor's own."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(stream)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run
