"""A script of positional edits as one mapping.

Editing a vector one element at a time makes a plan as deep as the script is long. Here the script alone is played through first, on an
order-statistic tree of position ranges: it starts as one range, all positions, and each edit splits a range or two. What is left is a
list of pieces, at most two for each edit and one more, that tells where every range of old positions has gone. One narrow pass maps the rows by it.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import InvalidParameter, OutOfBounds
from .vector import PositionalVector


@dataclass(frozen=True)
class Edit:
    """insert ``value`` before ``at``, remove the element at ``at``, move it from ``at`` to ``to`` (counted without it), or set it to ``value``."""

    kind: str
    at: int
    value: Any = None
    to: int = 0


class _Node:
    """A range of old positions (first >= 0) or of new elements (first < 0, numbered from -1 downwards), with its subtree's length."""

    __slots__ = ("first", "left", "length", "priority", "right", "total")

    def __init__(self, first: int, length: int, priority: float):
        self.first, self.length, self.total, self.priority, self.left, self.right = first, length, length, priority, None, None


def _total(node: _Node | None) -> int:
    return node.total if node else 0


def _counted(node: _Node) -> _Node:
    node.total = _total(node.left) + node.length + _total(node.right)
    return node


class PositionTree:
    """A treap of ranges, ordered by position."""

    def __init__(self, length: int, seed: int = 0):
        self._random = random.Random(seed)
        self.root = _Node(0, length, self._random.random()) if length else None

    def __len__(self) -> int:
        return _total(self.root)

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._join(a.right, b)
            return _counted(a)
        b.left = self._join(a, b.left)
        return _counted(b)

    def _split(self, node: _Node | None, at: int) -> tuple[_Node | None, _Node | None]:
        """The first ``at`` positions, and the others."""
        if node is None:
            return None, None
        before = _total(node.left)
        if at <= before:
            a, node.left = self._split(node.left, at)
            return a, _counted(node)
        if at >= before + node.length:
            node.right, b = self._split(node.right, at - before - node.length)
            return _counted(node), b
        cut = at - before  # within the node's own range
        rest = _Node(node.first + cut if node.first >= 0 else node.first - cut, node.length - cut, self._random.random())
        right, node.right, node.length = node.right, None, cut
        return _counted(node), self._join(rest, right)

    def take(self, at: int) -> _Node:
        """Remove the element at a position and return it."""
        if not 0 <= at < len(self):
            raise OutOfBounds(f"position {at} of {len(self)}")
        a, b = self._split(self.root, at)
        one, b = self._split(b, 1)
        self.root = self._join(a, b)
        return one

    def put(self, at: int, node: _Node) -> None:
        if not 0 <= at <= len(self):
            raise OutOfBounds(f"position {at} of {len(self)}")
        a, b = self._split(self.root, at)
        self.root = self._join(self._join(a, node), b)

    def pieces(self) -> Iterator[tuple[int, int]]:
        """(first, length) of every range, in order."""
        path, node = [], self.root
        while path or node:
            while node:
                path.append(node)
                node = node.left
            node = path.pop()
            yield node.first, node.length
            node = node.right


def played(length: int, script: Iterable[Edit]) -> tuple[np.ndarray, list[tuple[int, Any]], int]:
    """(old first, old end, new first) of the ranges that are left, ascending; (position, value) of new elements; the new length."""
    tree, values = PositionTree(length), []
    for edit in script:
        if edit.kind == "insert":
            tree.put(edit.at, _Node(-1 - len(values), 1, tree._random.random()))
            values.append(edit.value)
        elif edit.kind == "remove":
            tree.take(edit.at)
        elif edit.kind == "move":
            node = tree.take(edit.at)
            tree.put(edit.to, node)
        elif edit.kind == "set":
            tree.take(edit.at)
            tree.put(edit.at, _Node(-1 - len(values), 1, tree._random.random()))
            values.append(edit.value)
        else:
            raise InvalidParameter(f"no edit of kind {edit.kind}")
    old, new, at = [], [], 0
    for first, size in tree.pieces():
        if first >= 0:
            old.append((first, first + size, at))
        else:
            new += [(at + k, values[-1 - (first - k)]) for k in range(size)]
        at += size
    ranges = np.array(sorted(old), np.int64).reshape(-1, 3)
    return ranges, new, at


def edited(vector: PositionalVector, script: Iterable[Edit]) -> PositionalVector:
    """``vector`` after all edits, each on what the ones before have left. The plan is a pass over the rows and a union, however long the script.

    Bounds are checked before anything runs. The script and its pieces are on the driver and sent to every worker: 24 bytes a piece."""
    ranges, new, length = played(len(vector), script)
    schema = vector.df.select("pos", "value").schema
    shared = vector.df.sparkSession.sparkContext.broadcast(ranges)

    def mapped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, end, to = shared.value.T if len(shared.value) else (np.empty(0, np.int64),) * 3
        for batch in stream:
            pos = np.asarray(batch.column("pos")).astype(np.int64)
            at = np.searchsorted(first, pos, "right") - 1
            kept = (at >= 0) & (pos < end[at]) if len(first) else np.zeros(len(pos), bool)
            moved = pos[kept] - first[at[kept]] + to[at[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(moved), batch.column("value").filter(pa.array(kept))], ["pos", "value"])

    out = vector.df.select("pos", "value").mapInArrow(mapped, schema)
    if new:
        added = vector.df.sparkSession.createDataFrame(new, f"pos long, value {schema['value'].dataType.simpleString()}")
        out = out.unionByName(added.select(F.col("pos"), F.col("value")))
    return PositionalVector(out, length, vector.shard)
