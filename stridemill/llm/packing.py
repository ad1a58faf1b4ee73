"""Bounded-space online packing of token documents into sequences of fixed length.

Every partition keeps a fixed number of open windows. A document first fills whole windows of its own; what remains goes
where it leaves the least room. When it fits nowhere, the fullest window is emitted: as it is if it lacks only
``slack`` tokens, otherwise topped up with the beginning of the piece at hand. Windows still open at the end of a partition
leave with their ids, and groups of neighbouring partitions merge theirs: poured one into the next, fullest first, into full
sequences, the rest cut into powers of two, which need no padding.

Space is bounded by the open windows per partition, by ``BYTES`` of texts (or one longer text) and ``KEPT`` pieces of them at a time, and by
``GROUP`` partitions of windows in a merge, whatever the input.

Defined results: null and empty texts are the end token alone; documents of any length are cut; repeated rows and ids are packed as
separate documents; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stored, text_rows
from .pieces import Pieces

#: Partitions whose leftovers are merged together.
GROUP = 8
#: Bytes of texts that a worker takes at once, and pieces whose ids it keeps: two workers stand beside an executor's heap.
BYTES, KEPT = 2_000_000, 100_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]

_encoders: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """The word-end encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Pieces(path, blanks=False, kept=KEPT)
    return _encoders[path]


def _forget() -> None:
    for known in _encoders.values():
        known.forget()


def encoded(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each text with its end token, and all ids, little-endian 32-bit."""
    n, ids = encoder(path).encode(texts.cast(pa.string()), True)
    return n + 1, np.insert(ids, np.cumsum(n), end).astype("<u4")


class Packer:
    """Open windows of one partition. Emitted sequences gather in ``out`` as piece rows."""

    def __init__(self, size: int, windows: int, slack: int, first_id: int):
        self.size, self.windows, self.slack, self.next_id = size, windows, slack, first_id
        self.open: list[list] = []  # [filled, pieces]; a piece is (doc_id, start, ids, doc_tokens)
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.emit([(doc, at, ids[at : at + self.size], total)])
            at += self.size
        if at < total:
            self.place(doc, at, ids[at:], total)

    def place(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        n = len(ids)
        best = max((w for w in self.open if w[0] + n <= self.size), key=lambda w: w[0], default=None)
        if best is None:
            if len(self.open) == self.windows:
                fullest = max(self.open, key=lambda w: w[0])
                room = self.size - fullest[0]
                if room > self.slack:
                    fullest[1].append((doc, start, ids[:room], total))
                    start, ids, n = start + room, ids[room:], n - room
                self.open.remove(fullest)
                self.emit(fullest[1])
            best = [0, []]
            self.open.append(best)
        best[0] += n
        best[1].append((doc, start, ids, total))
        if best[0] == self.size:
            self.open.remove(best)
            self.emit(best[1])


def poured(pieces: list[tuple], packer: Packer) -> None:
    """Emit pieces one after another in full sequences, then the rest in powers of two, the largest first."""
    left = sum(len(p[2]) for p in pieces)
    room, now = 0, []
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            if not room:
                room = packer.size if left >= packer.size else 1 << (left.bit_length() - 1)
            take = min(room, len(ids) - at)
            now.append((doc, start + at, ids[at : at + take], total))
            at, room, left = at + take, room - take, left - take
            if not room:
                packer.emit(now)
                now = []


def _pack(path: str, end: int, size: int, windows: int, slack: int):
    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(_NAMES)
        none = [pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *none], [*_NAMES, "source", "ids"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        packer = Packer(size, windows, slack, here << 32)
        for batch in slices(stream, most=BYTES):
            n, ids = encoded(batch.column("text"), path, end)
            stops = np.cumsum(n)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), (stops - n).tolist(), stops.tolist(), strict=True):
                packer.add(doc, ids[a:b])
            for w in packer.open:  # or a window would hold on to the whole batch
                w[1] = [(d, s, i if i.base is None else i.copy(), t) for d, s, i, t in w[1]]
            yield rows(packer.out)
            packer.out = []
        left = sorted(packer.open, key=lambda w: -w[0])
        flat = [(d, s, len(i), 0, t, k, o) for k, w in enumerate(left) for o, (d, s, i, t) in enumerate(w[1])]
        cols = list(zip(*flat, strict=True)) or [()] * len(_NAMES)
        ids = [i.tobytes() for w in left for _, _, i, _ in w[1]]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols), pa.array([here] * len(ids), pa.int32()), pa.array(ids, pa.binary())], [*_NAMES, "source", "ids"]
        )

    return batches


def _merge(size: int):
    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, 0, 0, (1 << 61) | (int(key[0]) << 32))
        fill = pdf.groupby(["source", "sequence_id"])["length"].transform("sum")
        pdf = pdf.assign(fill=fill).sort_values(["fill", "source", "sequence_id", "offset"], ascending=[False, True, True, True], kind="stable")
        docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
        poured(list(zip(docs, pdf["start"].tolist(), [np.frombuffer(i, "<u4") for i in pdf["ids"]], pdf["doc_tokens"].tolist(), strict=True)), packer)
        out = pd.DataFrame(packer.out, columns=_NAMES)
        return out.astype({"doc_id": "Int64"})

    return group


def pack(docs: DataFrame, tokenizer_path: str, end: int, size: int = 4096, windows: int = 16, slack: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece rows (PIECE_SCHEMA): which ids of which document stand where in which sequence.

    The first pass is written once, as its emitted pieces and its leftovers must be of the same run.
    """
    schema = f"{PIECE_SCHEMA}, source int, ids binary"
    first = stored(text_rows(docs, id_col, text_col).mapInArrow(lean(_pack(tokenizer_path, end, size, windows, slack), _forget), schema), "packed", batch_bytes=BYTES)
    merged = first.filter("source IS NOT NULL").groupBy(F.expr(f"source div {GROUP}").alias("g")).applyInPandas(_merge(size), PIECE_SCHEMA)
    return first.filter("source IS NULL").select(*_NAMES).unionAll(merged)
