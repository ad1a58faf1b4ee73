"""SimHash near-duplicates through covering locality-sensitive hashing.

A document's 64-bit fingerprint has a bit where over half the hashes of its four-word shingles have it. To find all
fingerprints within radius r, every bit position gets a vector of r + 1 bits; each non-zero vector of r + 1 bits makes a table whose
mask has the positions with an odd inner product. Whatever r positions two fingerprints differ in, some non-zero vector is
orthogonal to all of theirs, so that table's mask avoids them and the two meet in one of its buckets. With r = 4 that's
31 tables of 32 bits each, with r = 5 63: no pair is lost, and buckets stay small.

Equal fingerprints are one row before any bucket is made. Within a bucket, fingerprints within the radius are compared
in full and leave as spanning edges to the smallest id, never as all pairs.

Edited copies move a fingerprint of shingles by more than a few bits, and no radius is certain to reach a given similarity of
their shingle sets. ``without_duplicates`` with ``similarity`` therefore takes what the tables find for fingerprints of the
distinct words, which edits hardly move, as proposals, counts the shingle sets in full, and has ``shingle_join`` complete the links.

Defined results: documents without words have the zero fingerprint and are linked like any other; null texts are empty;
texts are read whole; rows with a null id are left out; rows that share an id count as one node; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, one_row_per_id, spread_join, stored, text_rows
from .components import components

BITS = 64


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)], "<u8")


def _majority(h: np.ndarray) -> np.ndarray:
    """One 64-bit number with the bits that over half the hashes have."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        total += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0]


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return int(_majority(_hashes(words, shingle, seed))) if words else 0


def word_fingerprint(text: str, seed: int = 42) -> int:
    """The fingerprint of the distinct words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return int(_majority(_hashes(sorted(set(words)), 1, seed))) if words else 0


def _fingerprint_batches(shingle: int):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return batches


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: a fingerprint's 64 bits as a long)."""
    rows = text_rows(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit numbers: 2 ** (radius + 1) - 1 of them."""
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i in range(BITS) if ((i % 2 ** (radius + 1)) & v).bit_count() & 1)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


SMALL = 32


def _bucket_edges(starts: np.ndarray, sizes: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, smallest node of its component) within buckets; rows of a bucket are sorted by node."""

    def linked(x, y):
        return np.bitwise_count(fp[x] ^ fp[y]) <= radius

    label = np.arange(len(fp))
    a, b = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(size, 1)
        rows = starts[sizes == size]
        for k in range(0, len(rows), max(1, 2_000_000 // len(i))):
            x, y = (rows[k : k + max(1, 2_000_000 // len(i)), None] + i).ravel(), (rows[k : k + max(1, 2_000_000 // len(i)), None] + j).ravel()
            near = linked(x, y)
            a.append(x[near])
            b.append(y[near])
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        while True:
            old = label.copy()
            np.minimum.at(label, y, label[x])
            np.minimum.at(label, x, label[y])
            if (old == label).all():
                break
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rest = np.arange(start, start + size)
        while len(rest):  # a search from each row that nothing has reached yet, which only looks at such rows
            root, todo = rest[0], [rest[0]]
            rest = rest[1:]
            while todo and len(rest):
                near = linked(rest, todo.pop())
                if near.any():
                    label[rest[near]] = root
                    todo += rest[near].tolist()
                    rest = rest[~near]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return node[moved], node[label[moved]]


def _edges(radius: int):
    def found(cols: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        """Edges of the buckets that start at ``bounds[:-1]``; the last bound is their end."""
        n = int(bounds[-1])
        u, v = _bucket_edges(bounds[:-1], np.diff(bounds), cols[2][:n].view(np.uint64), cols[3][:n], radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # the parts of the last bucket, which may go on in the next batch
        for batch in stream:
            if not len(batch):
                continue
            cols = [np.asarray(batch.column(k)) for k in range(4)]
            same = bool(kept) and cols[0][0] == kept[0][0][0] and cols[1][0] == kept[0][1][0]
            bounds = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            if same and not len(bounds):
                kept.append(cols)
                continue
            if kept:
                head = int(bounds[0]) if same else 0
                whole = [np.concatenate(x) for x in zip(*kept, [c[:head] for c in cols], strict=True)]
                yield found(whole, np.array([0, len(whole[0])]))
                cols, bounds = [c[head:] for c in cols], bounds[1:] - head if same else bounds
            last = int(bounds[-1]) if len(bounds) else 0
            kept = [[c[last:] for c in cols]]
            if last:
                yield found(cols, np.concatenate([[0], bounds]))
        if kept:
            whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
            yield found(whole, np.array([0, len(whole[0])]))

    return batches


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) that connect just the fingerprints linked within ``radius``. ``prints``: fp, distinct, and node."""
    tables = F.array(*(F.struct(F.lit(n).alias("table"), F.lit(m).alias("mask")) for n, m in enumerate(masks(radius))))
    rows = prints.select("fp", "node", F.explode(tables).alias("t")).select(F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp", "node")
    return rows.repartition("table", "key").sortWithinPartitions("table", "key", "node").mapInArrow(_edges(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every document; component_id is the smallest id that links reach."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "prints")
    found = components(links(prints, radius))
    labels = stored(prints.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "labels")
    forget(prints)
    return spread_join(rows, labels, "fp").select("doc_id", "fp", "component_id")


def without_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every component, the one with the smallest id; rows with a null id all stay.

    With ``exact`` components are those of shingle sets of Jaccard similarity 0.8 or more: the tables propose, ``shingle_join`` decides.
    """
    if exact:
        from .shingle_join import without_duplicates as exactly  # which imports this module

        return exactly(docs, shingle, radius, id_col, text_col)
    docs = one_row_per_id(docs, id_col, text_col)
    extra = fresh(docs, "extra")
    gone = near_duplicates(docs, radius, shingle, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(extra))
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(extra), "left_anti")
