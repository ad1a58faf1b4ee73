"""Gravity of very many bodies: near pairs one by one, far ones by cells, whatever the bodies' places.

Space is cut into a tree of cubes by counts of bodies. Two cubes of one size that aren't near (``NEAR``) act on each other by what they do at fixed places
(``Skeleton``): the field of any bodies that far off is given there to a relative error of about 1e-13, which is near to what sums of
doubles lose anyway. Nothing is left out: each pair of bodies is either in near cubes, and summed by itself, or in exactly one pair of cubes.
Work grows with the bodies, not with their square.

Bodies at the same place are one mass. A block is a cube of the tree with at most ``BLOCK_BODIES`` of them. Blocks are tasks: one pass tells what each cube
holds (``_charges``), joins bring each block the bodies near it and the cubes further off, and a last pass sums them (``_summed``). The driver
gets counts of cubes (TREE_CELLS at most, about), never bodies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from itertools import permutations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder

AXES = ("x", "y", "z")
#: Cubes of one size are near if no more than this, squared and in cubes, lies between their centres.
NEAR = 6
#: Nodes of a cube's grid on each axis, and what's left of a field beyond a skeleton, relative to it.
NODES, TOLERANCE = 14, 1e-13
#: Cubes that are cut no further, and those that are a task.
LEAF_BODIES, BLOCK_BODIES = 352, 32_768
#: Levels of the tree at most: a cube's number has 60 bits.
DEPTH = 20
#: Cubes that the driver lists at most, about: leaves are larger where bodies are very many.
TREE_CELLS = 1 << 20
#: Pairs of bodies up to which two cubes that aren't near are summed pair by pair, as that is less work.
FEW_PAIRS = 1 << 13

#: Random fields that skeletons are picked by, and the most that they are softened by, in squares of a cube's half side: smaller cubes aren't cut.
FIELDS, SOFTEST = 3000, 1e-3

_TURNS = [(axes, signs) for axes in permutations(range(3)) for signs in product((1, -1), repeat=3)]
_REFLECTIONS = list(enumerate(product((1, -1), repeat=3)))


# Fields in a cube


class Skeleton(NamedTuple):
    """Places in the cube [-1, 1]^3 that tell any field of far bodies, and what follows from values there."""

    places: np.ndarray
    #: Values at the grid's nodes with no negative part from those at the places; other nodes follow by reflection.
    spread: np.ndarray
    #: Values at the places of the cube's eighth at (+, +, +) from those at its own.
    eighth: np.ndarray
    #: For each of 48 turns and reflections, the place that each place goes to.
    turned: np.ndarray

    def on_grid(self, fields: np.ndarray) -> np.ndarray:
        """(fields, grid) from (fields, places)."""
        out, half = np.empty((len(fields), *(NODES,) * 3)), NODES // 2
        for turn, (x, y, z) in _REFLECTIONS:
            out[:, ::x, ::y, ::z][:, :half, :half, :half] = (fields[:, self.turned[turn]] @ self.spread.T).reshape(len(fields), half, half, half)
        return out

    def off_grid(self, charges: np.ndarray) -> np.ndarray:
        """(charges, places) from (charges, grid): ``on_grid``, transposed."""
        half = NODES // 2
        out, grid = np.empty((len(charges), len(self.turned[0]))), charges.reshape(len(charges), *(NODES,) * 3)
        parts = [(turn, grid[:, ::x, ::y, ::z][:, :half, :half, :half].reshape(len(grid), half**3) @ self.spread) for turn, (x, y, z) in _REFLECTIONS]
        out[:, self.turned[0]] = parts[0][1]
        for turn, part in parts[1:]:
            out[:, self.turned[turn]] += part
        return out


def _is_far(offsets: np.ndarray) -> np.ndarray:
    return (offsets**2).sum(-1) > NEAR


def _polynomials(p: np.ndarray) -> np.ndarray:
    """For places on an axis: the polynomials (NODES, places) that are 1 at one node and 0 at the others."""
    t = np.empty((NODES, len(p)))
    t[0], t[1] = 1, p
    for k in range(1, NODES - 1):
        t[k + 1] = 2 * p * t[k] - t[k - 1]
    weights = np.cos(np.outer((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES), np.arange(NODES))) * np.where(np.arange(NODES), 2, 1) / NODES
    return weights @ t


@lru_cache(maxsize=1)
def skeleton() -> Skeleton:
    """Grid nodes picked where fields of random far bodies, softened by little or much, differ most from what those before them tell."""
    rng, half = np.random.default_rng(0), NODES // 2
    nodes = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    at = np.stack(np.meshgrid(*[np.arange(half)] * 3, indexing="ij"), -1).reshape(-1, 3)
    far = rng.uniform(-7, 7, (8 * FIELDS, 3))
    far = far[_is_far(np.rint(far / 2))][:FIELDS]
    shares = np.linspace(0.3, 1, 141)  # two of three go as near as they may be
    nearest = shares[_is_far(np.rint(far[:, None] * shares[:, None] / 2)).argmax(1)]
    far *= np.where(np.arange(FIELDS) % 3, nearest, 1)[:, None]
    softened = np.where(np.arange(FIELDS) % 2, 10 ** rng.uniform(-9, np.log10(SOFTEST), FIELDS), 0)
    fields_at = lambda which: (((nodes[which][:, None] - far[None]) ** 2).sum(-1) + softened) ** -0.5
    scale = np.linalg.norm(fields_at(at), axis=0)
    left = fields_at(at) / scale
    most, basis, picked, done = np.sqrt((left**2).sum(1).max()), np.empty((0, len(far))), [], np.zeros(len(at), bool)
    while (norms := np.where(done, 0, np.sqrt((left**2).sum(1)))).max() > TOLERANCE * most:
        same = np.sort(at, 1) == np.sort(at[norms.argmax()])
        done |= same.all(1)
        picked.append(np.concatenate([np.where(np.array(s) > 0, at[same.all(1)], NODES - 1 - at[same.all(1)]) for _, s in _REFLECTIONS]))
        rows = fields_at(picked[-1]) / scale
        for _ in range(2):
            rows -= (rows @ basis.T) @ basis
        _, sizes, rows = np.linalg.svd(rows, full_matrices=False)
        rows = rows[sizes > max(sizes[0] * 1e-3, 1e-16 * most)]
        basis = np.concatenate([basis, rows])
        for _ in range(2):
            left -= (left @ rows.T) @ rows
    chosen = np.concatenate(picked)
    u, sizes, rows = np.linalg.svd(fields_at(chosen) / scale, full_matrices=False)
    some = sizes > sizes[0] * 1e-15
    spread = (fields_at(at) / scale @ rows[some].T / sizes[some]) @ u[:, some].T
    number, where = np.array([NODES * NODES, NODES, 1]), np.full(NODES**3, -1)
    where[chosen @ number] = np.arange(len(chosen))
    turned = np.array([where[np.where(np.array(signs) > 0, chosen[:, axes], NODES - 1 - chosen[:, axes]) @ number] for axes, signs in _TURNS])
    bare = Skeleton(nodes[chosen], spread, spread[:0], turned)
    x, y, z = (_polynomials(0.5 + bare.places[:, k] / 2).T for k in range(3))
    return bare._replace(eighth=bare.off_grid(x[:, :, None, None] * y[:, None, :, None] * z[:, None, None, :]))


def _turn(offset: np.ndarray) -> tuple[tuple[int, int, int], int]:
    """The offset that has falling, positive parts, and the turn that leads from it to ``offset``."""
    order = np.argsort(-np.abs(offset), kind="stable")
    axes, signs = tuple(np.argsort(order).tolist()), tuple(np.where(offset < 0, -1, 1).tolist())
    return tuple(np.abs(offset)[order].tolist()), _TURNS.index((axes, signs))


def _actions(sk: Skeleton, offset: tuple[int, int, int], softening: float) -> np.ndarray:
    """(from, 3 x to): what unit charges at a cube's places pull at those of a cube that is ``offset`` apart with, on each axis."""
    apart = [np.subtract.outer(sk.places[:, k], sk.places[:, k] + 2 * offset[k]) for k in range(3)]
    squared = np.full(apart[0].shape, float(softening))
    for part in apart:
        squared += part * part
    squared *= np.sqrt(squared)
    return np.concatenate([part / squared for part in apart], 1)


# The tree


def _interleaved(v: np.ndarray) -> np.ndarray:
    """Numbers of cubes from (..., 3) whole places of up to 20 bits."""
    v = v.astype(np.int64)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = (v | (v << shift)) & mask
    return (v[..., 0] << 2) | (v[..., 1] << 1) | v[..., 2]


def _places(cells: np.ndarray) -> np.ndarray:
    """(..., 3) whole places from numbers of cubes."""
    v = np.stack([cells >> 2, cells >> 1, cells], -1) & 0x1249249249249249
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        v = (v | (v >> shift)) & mask
    return v


class Tree(NamedTuple):
    """Cubes by level, with the places in each. A cube's number at a level begins with its parent's; ``1 << 3 * level`` before it makes it one in all levels."""

    low: np.ndarray
    size: float
    leaf: int
    depth: int
    few: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    leaf_starts: np.ndarray
    block_starts: np.ndarray
    blocks: list[tuple[int, int]]
    #: The numbers that Spark deals blocks by, each to a partition of its own.
    labels: np.ndarray

    def codes(self, places: np.ndarray) -> np.ndarray:
        at = np.floor((places - self.low) / self.size * (1 << DEPTH)).astype(np.int64)
        return _interleaved(np.clip(at, 0, (1 << DEPTH) - 1))

    def counts(self, level: int, cells: np.ndarray) -> np.ndarray:
        """Places in cubes, 0 for those that the tree doesn't have."""
        keys, counts = self.levels[level]
        at = np.minimum(np.searchsorted(keys, cells), len(keys) - 1)
        return np.where(keys[at] == cells, counts[at], 0)

    def leaves(self, level: int, counts: np.ndarray) -> np.ndarray:
        return (counts <= self.leaf) | (level == self.depth)

    def inside(self, block: int, level: int) -> np.ndarray:
        """The cubes of a level that the block is in or that are in the block."""
        own, cell = self.blocks[block]
        if level <= own:
            return np.array([cell >> 3 * (own - level)], np.int64)
        keys = self.levels[level][0] if level < len(self.levels) else np.empty(0, np.int64)
        return keys[np.searchsorted(keys, cell << 3 * (level - own)) : np.searchsorted(keys, (cell + 1) << 3 * (level - own))]

    def framed(self, level: int, cell: int, places: np.ndarray) -> np.ndarray:
        """Places as they are in a cube's own frame, [-1, 1]^3."""
        half = self.size / (2 << level)
        return (places - (self.low + half * (2 * _places(np.int64(cell)) + 1))) / half


def _start(level: int, cell: np.ndarray) -> np.ndarray:
    return cell << 3 * (DEPTH - level)


def _grown(placed: DataFrame, low: np.ndarray, size: float, n: int, softening: float) -> Tree:
    """Counts of cubes, level by level where they hold too many."""
    leaf = max(LEAF_BODIES, 8 * n // TREE_CELLS)
    block = max(BLOCK_BODIES, leaf)
    depth = DEPTH if not softening else int(np.clip(np.log2(size / 2 * (SOFTEST / softening) ** 0.5), 0, DEPTH))
    spark = placed.sparkSession
    at = lambda level: F.shiftright("code", 3 * (DEPTH - level)).alias("cell")

    def counted(rows: DataFrame, level: int) -> tuple[np.ndarray, np.ndarray]:
        told = rows.groupBy(at(level)).count().toArrow()
        keys, counts = (told.column(c).to_numpy() for c in ("cell", "count"))
        order = np.argsort(keys)
        return keys[order], counts[order]

    levels = [counted(placed, 4)]
    while len(levels) < 5:
        keys, counts = levels[0]
        above, first = np.unique(keys >> 3, return_index=True)
        levels.insert(0, (above, np.add.reduceat(counts, first)))
    levels = levels[: depth + 1]
    while (crowded := levels[-1][0][levels[-1][1] > leaf]).size and len(levels) <= depth:
        level = len(levels)
        some = spark.createDataFrame(pa.table({"cell": crowded}))
        levels.append(counted(placed.select("code", at(level - 1)).join(F.broadcast(some), "cell", "left_semi"), level))
    for level in range(1, len(levels)):
        (keys, counts), (above, totals) = levels[level], levels[level - 1]
        kept = np.isin(keys >> 3, above[totals > leaf])
        levels[level] = (keys[kept], counts[kept])
    levels = [x for x in levels if len(x[0])]
    ends, blocks = [], []
    for level, (keys, counts) in enumerate(levels):
        done = (counts <= leaf) | (level == depth)
        ends.append(_start(level, keys[done]))
        top = np.ones(len(keys), bool) if not level else np.isin(keys >> 3, (up := levels[level - 1])[0][up[1] > block])
        blocks += [(level, int(c)) for c in keys[top & (done | (counts <= block))]]
    blocks.sort(key=lambda b: _start(*b))
    starts = np.array([_start(*b) for b in blocks], np.int64)
    return Tree(low, size, leaf, depth, FEW_PAIRS, levels, np.sort(np.concatenate(ends)), starts, blocks, _labels(spark, len(blocks)))


def _labels(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` numbers that Spark's hash sends to ``n`` partitions, one each; beyond some thousands chance is as even."""
    if n <= 4096:
        slots = spark.range(24 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("slot")).agg(F.min("id").alias("id")).orderBy("slot").toArrow()
        if slots.num_rows == n:
            return slots.column("id").to_numpy()
    return np.arange(n)


def _meetings(tree: Tree, block: int) -> tuple[np.ndarray, np.ndarray]:
    """What acts on a block, as rows (level, cube of the block, other cube): those summed pair by pair, and those by cubes."""
    own, _ = tree.blocks[block]
    near, far = [], []

    def add(to: list, level: int, a: np.ndarray, b: np.ndarray) -> None:
        to.append(np.stack([np.full(len(a), level), a, b], 1))

    a = b = np.zeros(1, np.int64)
    if tree.leaves(0, tree.levels[0][1])[0]:
        add(near, 0, a, b)
        a = b = a[:0]
    size = int(tree.counts(own, np.array([tree.blocks[block][1]]))[0])
    for level in range(1, len(tree.levels)):
        mine = tree.inside(block, level)
        a, b = ((x[:, None, None] << 3) + np.arange(8).reshape(s) for x, s in ((a, (1, 8, 1)), (b, (1, 1, 8))))
        a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
        some = np.isin(a, mine)
        a, b = a[some], b[some]
        held = tree.counts(level, b)
        a, b, held = a[held > 0], b[held > 0], held[held > 0]
        counts = tree.counts(level, a)
        apart = _is_far(_places(a) - _places(b))
        few = np.minimum(counts, size) * held <= tree.few
        alone = ~apart & (tree.leaves(level, counts) | tree.leaves(level, held))
        add(far, level, a[apart & ~few], b[apart & ~few])
        add(near, level, a[alone | (apart & few)], b[alone | (apart & few)])
        a, b = a[~apart & ~alone], b[~apart & ~alone]
    none = np.empty((0, 3), np.int64)
    return np.concatenate([none, *near]), np.concatenate([none, *far])


# Passes


def _columns(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names])


def _routes(tree: Tree, far: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to (label, what): the leaves whose bodies they need, or the cubes."""

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                level, _, cell = _meetings(tree, block)[far].T
                if far:
                    what = np.unique(cell | (np.int64(1) << 3 * level))
                else:
                    first, end = (np.searchsorted(tree.leaf_starts, (cell + k) << 3 * (DEPTH - level)) for k in (0, 1))
                    what = np.unique(np.concatenate([np.empty(0, np.int64), *(np.arange(*x) for x in set(zip(first.tolist(), end.tolist(), strict=True)))]))
                yield pa.record_batch([pa.array(np.full(len(what), tree.labels[block], np.int64)), pa.array(what.astype(np.int64))], names=["label", "what"])

    return routes


def _charges(tree: Tree, sk: Skeleton, table: pa.Table) -> pa.Table:
    """What a block's cubes hold, as charges at their places: those inside of it, and its part of those that it's in."""
    code = table.column("code").to_numpy()
    order = np.argsort(code)
    code, places, mass = code[order], _columns(table, AXES).T[order], table.column("m").to_numpy()[order]
    block = int(np.searchsorted(tree.block_starts, code[0], "right")) - 1
    own = tree.blocks[block][0]
    below, out = (np.empty(0, np.int64), np.empty((0, len(sk.places)))), []
    for level in range(len(tree.levels) - 1, 1, -1):
        cells = tree.inside(block, level)
        charges = np.zeros((len(cells), len(sk.places)))
        for octant in range(8):
            some = np.flatnonzero(below[0] & 7 == octant)
            turn = sk.turned[_octant(octant)]
            into = np.searchsorted(cells, below[0][some] >> 3)
            charges[into[:, None], turn] += below[1][some][:, turn] @ sk.eighth
        ends = cells[tree.leaves(level, tree.counts(level, cells))] if level >= own else cells[:0]
        for part in np.array_split(ends, max(1, len(ends) // 128)):
            grids = np.zeros((len(part), NODES**3))
            for k, cell in enumerate(part):
                a, b = np.searchsorted(code, [_start(level, cell), _start(level, cell + 1)])
                for i in range(a, b, 4096):
                    x, y, z = (_polynomials(p) for p in tree.framed(level, cell, places[i : min(b, i + 4096)]).T)
                    grids[k] += ((x * mass[i : min(b, i + 4096)])[:, None] * y[None]).reshape(NODES**2, -1).dot(z.T).ravel()
            charges[np.searchsorted(cells, part)] += sk.off_grid(grids)
        below = cells, charges
        out.append(pa.table([pa.array(cells | (np.int64(1) << 3 * level)), pa.array([level < own] * len(cells), pa.bool_()), pa.array([c.tobytes() for c in charges], pa.binary())], names=["cell", "part", "charges"]))
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.binary())], names=["cell", "part", "charges"])
    return pa.concat_tables([empty, *out])


def _octant(octant: int) -> int:
    return _TURNS.index(((0, 1, 2), tuple(1 if octant >> k & 1 else -1 for k in (2, 1, 0))))


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, float) for c in table.column("charges").to_pylist())
    return pa.table([table.column("cell")[:1], pa.array([total.tobytes()], pa.binary())], names=["cell", "charges"])


def _fields(tree: Tree, sk: Skeleton, block: int, far: np.ndarray, held: pa.Table, softening: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, cubes, (3, cubes, places) pulls of far cubes) for each level from 2 on; what pulls a cube pulls its eighths."""
    ids = held.column("cell").to_numpy()
    order = np.argsort(ids)
    ids, charges = ids[order], np.frombuffer(b"".join(held.column("charges").to_pylist()), float).reshape(len(ids), len(sk.places))[order]
    above = None
    for level in range(2, len(tree.levels)):
        cells = tree.inside(block, level)
        if not len(cells):
            return
        fields = np.zeros((3, len(cells), len(sk.places)))
        if above is not None:
            for octant in range(8):
                some = np.flatnonzero(cells & 7 == octant)
                turn = sk.turned[_octant(octant)]
                fields[:, some[:, None], turn] += above[1][:, np.searchsorted(above[0], cells[some] >> 3)][:, :, turn] @ sk.eighth.T
        _, a, b = far[far[:, 0] == level].T
        offsets, which = np.unique(_places(a) - _places(b), axis=0, return_inverse=True)
        kinds: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
        for k, offset in enumerate(offsets):
            plain, turn = _turn(offset)
            kinds.setdefault(plain, []).append((turn, np.flatnonzero(which == k)))
        to, of = np.searchsorted(cells, a), np.searchsorted(ids, b | (np.int64(1) << 3 * level))
        half = tree.size / (2 << level)
        for plain, turns in kinds.items():
            actions = _actions(sk, plain, softening / half**2) / half**2
            sizes = np.cumsum([len(rows) for _, rows in turns])
            for part in np.split(np.arange(len(turns)), np.flatnonzero(np.diff(sizes // 1024)) + 1):  # large products, bounded in memory
                some = [turns[k] for k in part]
                found = np.concatenate([charges[of[rows]].take(sk.turned[turn], 1) for turn, rows in some]) @ actions
                for turn, rows in some:  # a cube is once among the rows of an offset
                    back, pulled, found = np.argsort(sk.turned[turn]), found[: len(rows)], found[len(rows) :]
                    for k, (axis, sign) in enumerate(zip(*_TURNS[turn], strict=True)):
                        fields[k][to[rows]] += sign * pulled.take(axis * len(back) + back, 1)
        yield level, cells, fields
        above = cells, fields


def _inside(sk: Skeleton, fields: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(fields, places): a cube's fields at places in its frame."""
    x, y, z = (_polynomials(places[:, k]) for k in range(3))
    found = (sk.on_grid(fields).reshape(-1, NODES) @ z).reshape(len(fields), NODES, NODES, -1)
    return np.einsum("fib,ib->fb", np.einsum("fijb,jb->fib", found, y), x)


def _summed(tree: Tree, sk: Skeleton, block: int, near_bodies: pa.Table, held: pa.Table, softening: float, pulls: Callable) -> pa.Table:
    """What all bodies pull at the places of a block with, for unit mass and constant."""
    code = near_bodies.column("code").to_numpy()
    order = np.argsort(code)
    code, bodies = code[order], _columns(near_bodies, (*AXES, "m"))[:, order]
    range_of = lambda level, cell: np.searchsorted(code, [_start(level, cell), _start(level, cell + 1)]).tolist()
    level, cell = tree.blocks[block]
    a, b = range_of(level, cell)
    out = np.zeros((3, len(code)))
    near, far = _meetings(tree, block)
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for at, mine, other in near.tolist():
        groups.setdefault((a, b) if at <= level else tuple(range_of(at, mine)), []).append(range_of(at, other))
    for (i, j), others in groups.items():
        out[:, i:j] += pulls(bodies[:3, i:j], np.concatenate([bodies[:, s:e] for s, e in others], 1))
    for at, cells, fields in _fields(tree, sk, block, far, held, softening):
        ends = tree.leaves(at, tree.counts(at, cells)) & (at >= level)
        for k in np.flatnonzero(ends):
            first, end = range_of(at, cells[k])
            for i in range(first, end, 4096):
                j = min(end, i + 4096)
                out[:, i:j] += _inside(sk, fields[:, k], tree.framed(at, int(cells[k]), bodies[:3, i:j].T))
    return pa.table([pa.array(x) for x in (*bodies[:3, a:b], *out[:, a:b])], names=[*AXES, *(f"p{c}" for c in AXES)])


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def intermediates_of_steps() -> Iterator[list[str]]:
    """Lists the folders that ``pulls_by_cells`` writes within, so that a loop can delete those of steps that are over."""
    token = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(token)


def pulls_by_cells(bodies: DataFrame, softening: float, pulls: Callable, low: np.ndarray, size: float) -> DataFrame:
    """``bodies`` with (px, py, pz), what all bodies pull at their places with for unit mass and constant; ``pulls(own, others)`` sums near ones.

    All places are finite and in the cube at ``low`` of ``size``. Intermediates are written to the shared folder (``intermediates_of_steps`` lists them)."""
    spark = bodies.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        place = shared_folder(spark, name)
        if (made := _made.get()) is not None:
            made.append(place)
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    bare = Tree(low, size, 0, 0, 0, [], *[np.empty(0, np.int64)] * 2, [], np.empty(0, np.int64))
    names = [*AXES, "m", "code"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in AXES], 1)
            yield pa.record_batch([*batch.columns, pa.array(bare.codes(places))], names=names)

    bodies = written(bodies, "bodies")  # found again by their places below, which a plan that runs twice may round otherwise
    masses = bodies.select(*AXES, "m").groupBy(*AXES).agg(F.sum("m").alias("m"))
    placed = written(masses.mapInArrow(coded, "x double, y double, z double, m double, code long"), "places")
    tree = _grown(placed, low, size, placed.count(), softening)
    shared = spark.sparkContext.broadcast((tree, skeleton()))
    n, block_of = len(tree.blocks), {int(label): k for k, label in enumerate(tree.labels)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            code = batch.column("code").to_numpy()
            leaf, block = (np.searchsorted(x, code, "right") - 1 for x in (known.leaf_starts, known.block_starts))
            yield pa.record_batch([*batch.columns, pa.array(leaf), pa.array(known.labels[block])], names=[*names, "what", "label"])

    located = placed.mapInArrow(dealt, "x double, y double, z double, m double, code long, what long, label long")
    charges = located.repartition(n, "label").groupBy("label").applyInArrow(lambda t: _charges(*shared.value, t), "cell long, part boolean, charges binary")
    charges = written(charges, "charges")
    parts = charges.filter("part").groupBy("cell").applyInArrow(_added, "cell long, charges binary")
    whole = charges.filter("NOT part").select("cell", "charges").unionByName(parts)
    asked = [spark.range(0, n, 1, n).mapInArrow(lambda batches, far=far: _routes(shared.value[0], far)(batches), "label long, what long") for far in (False, True)]
    near = located.drop("label").join(asked[0], "what").select("label", *names)
    far = whole.join(asked[1].withColumnRenamed("what", "cell"), "cell").select("label", "cell", "charges")

    def summed(key: tuple, bodies: pa.Table, held: pa.Table) -> pa.Table:
        return _summed(*shared.value, block_of[key[0].as_py()], bodies, held, softening, pulls)

    left, right = (df.repartition(n, "label").groupBy("label") for df in (near, far))
    found = left.cogroup(right).applyInArrow(summed, "x double, y double, z double, px double, py double, pz double")
    return bodies.join(found, list(AXES))
