"""All-pairs gravity in doubles: forces, one semi-implicit Euler step, and a number of steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard
from .cells import intermediates_of_steps, pulls_by_cells
from .iterate import iterate
from .pairs import against_all, by_blocks

# Fixed values of the simulation.
GRAVITY = 6.674e-11
TIME_STEP = 0.01
SOFTENING = 1e-9

AXES = ("x", "y", "z")
#: Pairs that one block of rows and bodies holds at a time: its arrays stay in a core's cache.
TILE = (64, 512)
#: Pairs up to which all of them are summed one by one; beyond, far ones go by cells.
DIRECT_PAIRS = 1 << 32
_FORCE_SCHEMA = "id long, fx double, fy double, fz double"


def inverse_cube(squared: Column) -> Column:
    """``squared`` to the power -1.5; a root and a division take half the time of ``pow``."""
    return 1 / (squared * F.sqrt(squared))


def forces_by_pairs(bodies: DataFrame) -> DataFrame:
    """(id, fx, fy, fz) from a row per pair, by expressions alone: to check ``forces`` with."""
    i = bodies.select("id", *AXES, "m")
    j = bodies.select(*(F.col(a).alias(f"j{a}") for a in (*AXES, "m")))
    delta = {a: F.col(f"j{a}") - F.col(a) for a in AXES}
    squared = delta["x"] * delta["x"] + delta["y"] * delta["y"] + delta["z"] * delta["z"] + SOFTENING
    pull = F.lit(GRAVITY) * F.col("m") * F.col("jm") * inverse_cube(squared)
    terms = against_all(i, j, "id").select("id", pull.alias("pull"), *(delta[a].alias(f"d{a}") for a in AXES))
    return terms.groupBy("id").agg(*(F.sum(F.col("pull") * F.col(f"d{a}")).alias(f"f{a}") for a in AXES))


#: Fixed value: the bits that half the bits of a float are taken from for a first guess at one over its root.
ROOT_BITS = 0x5F3759DF


def fast_inverse_root(x: np.ndarray) -> np.ndarray:
    """One over the root of 32-bit floats by their bits and one Newton step: within 0.18 % of it."""
    x = np.asarray(x, np.float32)
    guess = (np.uint32(ROOT_BITS) - (x.view(np.uint32) >> np.uint32(1))).view(np.float32)
    return guess * (np.float32(1.5) - np.float32(0.5) * x * guess * guess)


def _pulls(own: np.ndarray, others: np.ndarray, fast: bool = False) -> np.ndarray:
    """What bodies ``others`` (x, y, z, m) pull at places ``own`` (x, y, z) with, for unit mass and constant."""
    out = np.zeros((3, own.shape[1]))
    tall, wide = TILE
    buffers = [np.empty(TILE) for _ in range(5)]
    for i in range(0, own.shape[1], tall):
        rows = own[:, i : i + tall]
        for j in range(0, others.shape[1], wide):
            at = others[:, j : j + wide]
            *delta, squared, pull = (b[: rows.shape[1], : at.shape[1]] for b in buffers)
            squared.fill(SOFTENING)
            for k in range(3):
                np.subtract(at[k][None], rows[k][:, None], out=delta[k])
                np.multiply(delta[k], delta[k], out=pull)
                squared += pull
            if fast:
                np.multiply(at[3][None], fast_inverse_root(squared.astype(np.float32)).astype(float) ** 3, out=pull)
            else:
                np.sqrt(squared, out=pull)
                pull *= squared
                np.divide(at[3][None], pull, out=pull)
            for k in range(3):
                out[k, i : i + tall] += np.einsum("ij,ij->i", pull, delta[k])
    return out


def _kernel(parts: Iterator[pa.Table], others: pa.Table, fast: bool = False) -> pa.Table:
    columns = lambda table, names: np.stack([np.asarray(table.column(c), float) for c in names])
    every, out = columns(others, ("jx", "jy", "jz", "jm")), []
    for part in parts:
        pull = _pulls(columns(part, AXES), every, fast) * (GRAVITY * np.asarray(part.column("m"), float))
        out.append(pa.table([part.column("id").cast(pa.int64()), *(pa.array(p) for p in pull)], names=["id", "fx", "fy", "fz"]))
    empty = pa.table([pa.array([], pa.int64()), *(pa.array([], pa.float64()) for _ in AXES)], names=["id", "fx", "fy", "fz"])
    return pa.concat_tables([empty, *out])


def forces(bodies: DataFrame, fast: bool = False, **how) -> DataFrame:
    """(id, fx, fy, fz): the sum over all bodies; a body's own term is exactly zero. ``fast``: with ``fast_inverse_root`` of distances in 32 bits.

    Bodies meet in blocks (``pairs.by_blocks``), which NumPy sums, so no row stands for a pair; sums of blocks are then added. Beyond DIRECT_PAIRS
    pairs only near bodies meet one by one, and far ones by ``cells``, with the same sums to about 1e-13.
    """
    bodies = bodies.select("id", *(F.col(c).cast("double").alias(c) for c in (*AXES, "m")))
    if not fast and (cube := _cube(bodies)):
        found = pulls_by_cells(bodies, SOFTENING, _pulls, *cube)
        return found.select(F.col("id").cast("long").alias("id"), *((F.lit(GRAVITY) * F.col("m") * F.col(f"p{a}")).alias(f"f{a}") for a in AXES))
    others = bodies.select(F.col("id").alias("jid"), *(F.col(a).alias(f"j{a}") for a in (*AXES, "m")))
    found = by_blocks(bodies, others, "id", "jid", partial(_kernel, fast=fast), _FORCE_SCHEMA, 40, **how)
    return found.groupBy("id").agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in AXES))


def _cube(bodies: DataFrame) -> tuple[np.ndarray, float] | None:
    """The corner and size of a cube with all bodies, if they are more than are summed pair by pair, and each has a finite place and mass."""
    if bodies.count() ** 2 <= DIRECT_PAIRS:
        return None
    finite = [F.abs(a) < float("inf") for a in (*AXES, "m")]
    ends = [f(a).alias(f"{a}{k}") for k, f in enumerate((F.min, F.max)) for a in AXES]
    row = bodies.agg(*ends, F.count_if(F.coalesce(finite[0] & finite[1] & finite[2] & finite[3], F.lit(False))).alias("whole"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if row["whole"] < row["n"] or row["ids"] < row["n"]:
        return None
    low, high = (np.array([row[f"{a}{k}"] for a in AXES]) for k in (0, 1))
    size = float((high - low).max())
    return (low, size * (1 + 1e-9) or 1.0) if size < 1e100 else None


def applied(bodies: DataFrame, pulls: DataFrame) -> DataFrame:
    """Velocities first, then positions with the new velocities."""
    v = {a: F.col(f"v{a}") + F.col(f"f{a}") / F.col("m") * TIME_STEP for a in AXES}
    x = {a: F.col(a) + v[a] * TIME_STEP for a in AXES}
    return bodies.join(pulls, "id").select("id", *(x[a].alias(a) for a in AXES), *(v[a].alias(f"v{a}") for a in AXES), "m")


def step(bodies: DataFrame, blocks: bool = True) -> DataFrame:
    return applied(bodies, forces(bodies) if blocks else forces_by_pairs(bodies))


def simulate(bodies: DataFrame, steps: int, write_every: int = 1, blocks: bool = True, place: str | None = None) -> DataFrame:
    """``steps`` steps, with forces in ``blocks`` unless pairs are wanted. State is written to the shared folder as it goes, or plans would grow with the
    steps; a state is deleted once the next is there. With a folder of its own (``place``) the simulation goes on where a lost driver has left it."""
    taken = iter(range(steps))
    with intermediates_of_steps() as made:

        def once(state: DataFrame, k: int) -> DataFrame:
            if next(taken) % write_every == 0:  # what came before is in the state
                discard(bodies.sparkSession, made)
            return step(state, blocks)

        try:
            return iterate(bodies, once, steps, place, write_every)
        finally:
            discard(bodies.sparkSession, made)
