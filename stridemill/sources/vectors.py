"""Vector shards: a Spark data source for vectors of 16-bit floats (bfloat16), fixed in width.

    df.write.format("vector_shards").option("shards", 4).mode("append").save(path)   # vec_id, embedding
    spark.read.format("vector_shards").load(path).filter("colocation_index = 2")     # reads shard 2 only

A vector lies in shard vec_id % shards. Each task writes one file for each shard that it has rows of, block after block; a block is a count, the
ids, and two bytes for each entry. Nothing is readable before the driver has put the file list, ``_vectors``, into its place, which it
does once all tasks have succeeded; what a failed write has left isn't in the list. Each listed file is a partition of a read, and shards that a
filter on ``colocation_index`` excludes aren't opened.

Entries are rounded to the nearest bfloat16, ties to even. Vectors that are null, hold nulls or differ in length, and null ids, are refused.
Places are paths or URIs that pyarrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..errors import InvalidParameter

LIST = "_vectors"
SCHEMA = "vec_id long, embedding array<float>, colocation_index int"
#: Vectors of a block at most.
BLOCK = 4096


def to_bf16(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of 32-bit floats, rounded to the nearest, ties to even; NaN stays NaN."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    rounded = (bits + (np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1)))) >> np.uint32(16)
    return np.where(np.isnan(x), (bits >> np.uint32(16)) | np.uint32(0x40), rounded).astype("<u2")


def from_bf16(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32)


def _opened(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def _listed(place: str) -> dict | None:
    files, root = _opened(place)
    if files.get_file_info(f"{root}/{LIST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{root}/{LIST}") as stream:
        return json.loads(stream.read())


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class _File(InputPartition):
    path: str
    shard: int

    def __init__(self, path: str, shard: int):
        super().__init__(None)
        self.path, self.shard = path, shard


class VectorShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        shards = int(self.options.get("shards", 4))
        if shards <= 0:
            raise InvalidParameter("at least one shard is needed")
        return _Writer(self.options["path"], shards, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, place: str):
        self.place, self.wanted = place, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the shard choose files; Spark still applies all."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("colocation_index",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f

    def partitions(self) -> list[InputPartition]:
        told = _listed(self.place)
        if told is None:
            raise FileNotFoundError(f"no vectors in {self.place}")
        return [_File(f["path"], f["shard"]) for f in told["files"] if self.wanted is None or f["shard"] in self.wanted]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left to read
            return
        files, root = _opened(self.place)
        with files.open_input_stream(f"{root}/{partition.path}") as stream:
            while head := stream.read(8):
                n, d = struct.unpack("<II", head)
                ids = np.frombuffer(stream.read(8 * n), "<i8")
                flat = pa.array(from_bf16(np.frombuffer(stream.read(2 * n * d), "<u2")))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(np.full(n, partition.shard, np.int32))], ["vec_id", "embedding", "colocation_index"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, place: str, shards: int, overwrite: bool):
        self.place, self.shards, self.overwrite = place, shards, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _opened(self.place)
        streams: dict[int, tuple[str, pa.NativeFile]] = {}
        counts: dict[int, int] = {}
        width = None
        try:
            for batch in iterator:
                for k in range(0, len(batch), BLOCK):
                    ids, x = _checked(batch.slice(k, BLOCK))
                    if width not in (None, x.shape[1]):
                        raise InvalidParameter("vectors of different lengths")
                    width = x.shape[1]
                    shard = ids % self.shards
                    for s in np.unique(shard).tolist():
                        own = shard == s
                        if s not in streams:
                            name = f"shard-{s}-{uuid.uuid4().hex}"
                            files.create_dir(root, recursive=True)
                            streams[s] = name, files.open_output_stream(f"{root}/{name}")
                        streams[s][1].write(struct.pack("<II", int(own.sum()), width) + ids[own].astype("<i8").tobytes() + to_bf16(x[own]).tobytes())
                        counts[s] = counts.get(s, 0) + int(own.sum())
        finally:
            for _, stream in streams.values():
                stream.close()
        return _Written([{"path": name, "shard": s, "rows": counts[s], "width": width} for s, (name, _) in streams.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Put the list of all files into its place: the write is readable from then on. Files that an overwrite has replaced go after that."""
        files, root = _opened(self.place)
        before = _listed(self.place)
        new = [f for m in messages if m is not None for f in m.files]
        old = before["files"] if before and not self.overwrite else []
        if old and before["shards"] != self.shards:
            self.abort(messages)
            raise InvalidParameter(f"{self.place} has {before['shards']} shards")
        if len({f["width"] for f in [*old, *new]}) > 1:
            self.abort(messages)
            raise InvalidParameter("vectors of different lengths")
        files.create_dir(root, recursive=True)
        name = f"{root}/{LIST}.{uuid.uuid4().hex}"
        with files.open_output_stream(name) as stream:
            stream.write(json.dumps({"shards": self.shards, "files": [*old, *new]}).encode())
        files.move(name, f"{root}/{LIST}")
        for f in (before["files"] if before and self.overwrite else []):
            files.delete_file(f"{root}/{f['path']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.place)
        for f in (f for m in messages if m is not None for f in m.files):
            if files.get_file_info(f"{root}/{f['path']}").type != fs.FileType.NotFound:
                files.delete_file(f"{root}/{f['path']}")


def _checked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    flat = vectors.flatten()
    if ids.null_count or vectors.null_count or flat.null_count:
        raise InvalidParameter("null ids, vectors or entries can't be stored")
    sizes = np.asarray(pc.list_value_length(vectors))
    if len(sizes) and sizes.min() != sizes.max():
        raise InvalidParameter("vectors of different lengths")
    return np.asarray(ids).astype(np.int64), np.asarray(flat).astype(np.float32).reshape(len(batch), -1)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorShards)
