"""Sessions, what a session runs on, background actions and written intermediates."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .errors import InvalidParameter, StartFailed, UnsupportedPlatform


def session(name: str = "stridemill", cores: int | str = "*", config: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's defaults; on a cluster the submit configuration wins."""
    if cores != "*" and int(cores) <= 0:
        raise InvalidParameter("at least one worker is needed")
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.appName(name).config(map=defaults | (config or {}))
    if not SparkSession.getActiveSession():
        builder = builder.master(f"local[{cores}]")
    try:
        return builder.getOrCreate()
    except Exception as e:
        raise StartFailed(str(e)) from e


def ship(spark: SparkSession) -> str:
    """Send this package's own files to all workers of the session, present and future, where they haven't got it installed. Returns the archive's path."""
    import stridemill

    root = Path(stridemill.__file__).parent
    place = Path(tempfile.mkdtemp(prefix="stridemill-package-")) / "stridemill.zip"
    with zipfile.ZipFile(place, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(place))
    return str(place)


def terminate(spark: SparkSession) -> None:
    """End the session; what runs is cancelled, intermediates are deleted, and a second call does nothing."""
    if not spark.sparkContext._jsc or spark.sparkContext._jsc.sc().isStopped():
        return
    spark.sparkContext.cancelAllJobs()
    discard(spark)
    spark.stop()


class Files:
    """A few file operations through Spark's own file systems, so that any store it reads will do."""

    def __init__(self, spark: SparkSession, place: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(place).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, place: str) -> list[str]:
        """Names in a folder; none where there's no folder."""
        path = self._path(place)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def delete(self, place: str) -> None:
        self._fs.delete(self._path(place), True)

    def read(self, place: str) -> str:
        stream = self._fs.open(self._path(place))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, place: str, text: str) -> None:
        """A file that is there whole or not at all: written under another name, then renamed."""
        path, other = self._path(place), self._path(f"{place}.{uuid.uuid4().hex}")
        stream = self._fs.create(other, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(path, False)
        if not self._fs.rename(other, path):
            raise OSError(f"{place} can't be written")


def files_of(spark: SparkSession, place: str) -> Files:
    return Files(spark, place)


class _Folders:
    """Every folder of intermediates that this process has made and not deleted, by whatever thread."""

    def __init__(self):
        self._lock, self._places = threading.Lock(), []

    def add(self, place: str) -> str:
        with self._lock:
            self._places.append(place)
        return place

    def taken(self, places: Iterable[str] | None, keep: Iterable[str]) -> list[str]:
        """Those of ``places`` (None: all) that aren't kept, which are no longer listed."""
        with self._lock:
            wanted = set(self._places if places is None else places) - set(keep)
            gone, self._places = [p for p in self._places if p in wanted], [p for p in self._places if p not in wanted]
        return gone

    def listed(self) -> list[str]:
        with self._lock:
            return list(self._places)


_folders = _Folders()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which driver and executors share; where that's unset and all runs in one process (tests), in a new folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise UnsupportedPlatform("set spark.checkpoint.dir to a folder that driver and executors share")
        place = _folders.add(tempfile.mkdtemp(prefix="stridemill-"))
        spark.conf.set("spark.checkpoint.dir", place)
    return _folders.add(f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def intermediates() -> list[str]:
    """The folders of intermediates that there are."""
    return _folders.listed()


def discard(spark: SparkSession, places: Iterable[str] | None = None, keep: Iterable[str] = ()) -> None:
    """Delete intermediates (None: all of them) once what was read from them is stored elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    for place in _folders.taken(places, keep):
        files_of(spark, place).delete(place)
        if place == root:
            spark.conf.unset("spark.checkpoint.dir")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates that are made within, by this thread or others, are deleted at its end, however it ends."""
    before = set(_folders.listed())
    try:
        yield
    finally:
        root = spark.conf.get("spark.checkpoint.dir", None)
        discard(spark, set(_folders.listed()) - before - {root})


def stored_as(spark: SparkSession, make: Callable[[], DataFrame], place: str, mode: str = "errorifexists") -> DataFrame:
    """What ``make`` returns, written to ``place`` as Parquet and read from there; all intermediates on the way are gone then."""
    with scratch(spark):
        made = make()
        schema = made.schema
        made.write.mode(mode).parquet(place)
    return spark.read.schema(schema).parquet(place)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and survives lost executors. It's deleted by ``discard``, at the end of
    a ``scratch`` or ``stored_as`` around it, or with the session."""
    place = shared_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def topology(spark: SparkSession) -> DataFrame:
    """One row: cores, nodes, shards (one per node), quality levels (always 1), memory, version and capabilities of the session."""
    sc, status = spark.sparkContext, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().iterator()
    hosts, memory = set(), 0
    while status.hasNext():
        entry = status.next()
        hosts.add(str(entry._1()).rpartition(":")[0])
        memory += int(entry._2()._1())
    row = (sc.defaultParallelism, len(hosts), len(hosts), 1, memory, __version__, capabilities(spark))
    return spark.createDataFrame([row], "logical_cores long, numa_nodes long, colocations long, quality_levels long, memory_bytes long, version string, capabilities string")


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks, finished tasks) of every stage that runs just now."""
    tracker = spark.sparkContext.statusTracker()
    infos = (tracker.getStageInfo(k) for k in tracker.getActiveStageIds())
    return [(i.stageId, i.numTasks, i.numCompletedTasks) for i in infos if i is not None]


def capabilities(spark: SparkSession) -> str:
    """What the session can do, joined by plus signs."""
    on = lambda key, default: spark.conf.get(key, default) == "true"
    parts = ["columnar", *(["adaptive"] if on("spark.sql.adaptive.enabled", "true") else []), *(["codegen"] if on("spark.sql.codegen.wholeStage", "true") else []), *(["offheap"] if on("spark.memory.offHeap.enabled", "false") else [])]
    return "+".join(parts)


class Action:
    """An action that runs in the background once started. ``start`` and ``join`` may be called again; leaving the context joins."""

    def __init__(self, work: Callable[[], Any], pool: str | None = None, spark: SparkSession | None = None):
        self._work, self._pool, self._spark = work, pool, spark
        self._thread: InheritableThread | None = None
        self._value: Any = None
        self._error: BaseException | None = None

    def start(self) -> Action:
        if self._thread is None:
            self._thread = InheritableThread(target=self._run)
            self._thread.start()
        return self

    def _run(self) -> None:
        try:
            if self._pool and self._spark:
                self._spark.sparkContext.setLocalProperty("spark.scheduler.pool", self._pool)
            self._value = self._work()
        except BaseException as e:  # raised again in join
            self._error = e

    def join(self) -> Any:
        """The action's value, after starting it if need be; raises what it has raised."""
        self.start()._thread.join()
        if self._error is not None:
            raise self._error
        return self._value

    def __enter__(self) -> Action:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.join()


def started(loop: Callable[[], DataFrame], name: str = "loop") -> Action:
    """A loop (``for_n``, ``for_n_dynamic``, ``for_slices`` or any other plan) that runs in the background from now on; ``join`` returns what
    it made, as a table in the shared folder, and so reads it as often as wanted without running it again."""
    return Action(lambda: written(loop(), name)).start()


def broadcast_to_workers(spark: SparkSession, workers: int, function: Callable[[int], Any], simultaneous: bool = False) -> DataFrame:
    """One row per worker with what ``function`` returns for its number, as text. ``simultaneous``: all at once, in barrier mode."""
    if workers <= 0:
        raise InvalidParameter("at least one worker is needed")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(value=[str(function(int(k))) for k in frame["thread_index"]])

    rows = spark.range(0, workers, 1, workers).withColumnRenamed("id", "thread_index")
    return rows.mapInPandas(call, "thread_index long, value string", barrier=simultaneous)
