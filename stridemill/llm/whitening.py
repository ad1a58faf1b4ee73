"""Whitening of embeddings by a one-sided Jacobi SVD over blockwise TSQR.

Entries become whole numbers x = floor(256 * c), so counts, sums and deviations are exact. Each distinct x vector is in the fit list once.

1. The fit list is written once; a partial sum per partition and dimension gives n and S.
2. TSQR: each partition folds its centred rows (n * x - S) / n, block by block, into one triangular R of the dimensions' size.
   Stacks of ``FAN`` such R are folded again, level by level, in tasks of a fixed size; the last R has the Gram matrix of all rows.
3. Plane rotations make the columns of R orthogonal (one-sided Jacobi). Their lengths over sqrt(n) are the standard deviations,
   small ones as accurate as large ones, as no covariance matrix is ever formed; the rotations accumulated are the components.
4. One narrow pass projects the rows. Another over the fit list sums products of whitened values for ``identity_error``.

Only matrices of the dimensions' size reach the driver (the R of the last level, the components), whatever the number of rows.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are those with another number of
entries than most vectors have (of lengths equally frequent, the larger counts). Null ids stay null and repeated rows each get their
results. Components without variance (a deviation below the rounding of the largest) don't exist, so where all vectors are equal there are no
rows. A deviation that no long holds is null. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: R matrices that one task folds into one.
FAN = 16
#: Bytes of doubles that one block of rows takes.
BLOCK_BYTES = 8_000_000
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the whole numbers of every vector that takes part, whatever its length."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * 256))
    return vectors.filter((F.size(v) > 0) & finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), d)


def _blocks(stream: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK_BYTES // (8 * d))
    for batch in stream:
        for k in range(0, len(batch), rows):
            part = batch.slice(k, rows)
            yield part, _matrix(part.column("x"), d)


def totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension."""

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for part, x in _blocks(stream, d):
            total += x.sum(axis=0)
            n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total), pa.array(np.full(d, n))], ["dim", "total", "n"])

    rows = fit.mapInArrow(partial, "dim long, total long, n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["dim"])
    return (rows[0]["n"] if rows else 0), np.array([r["total"] for r in rows], np.int64)


def folded(upper: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The R of ``upper`` with the rows of ``block`` under it."""
    return np.linalg.qr(block if upper is None else np.vstack([upper, block]), mode="r")


def tsqr(fit: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """R of all centred rows: one small matrix for each partition, folded FAN by FAN."""
    d = len(total)

    def leaves(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for _, x in _blocks(stream, d):
            upper = folded(upper, (n * x - total) / n)
        if upper is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([upper.tobytes()])], ["part", "r"])

    def fold(table: pa.Table) -> pa.Table:
        upper = None
        for row in sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True)):
            upper = folded(upper, np.frombuffer(row[1]).reshape(-1, d))
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "r": [upper.tobytes()]})

    level, width = fit.mapInArrow(leaves, "part long, r binary"), fit.rdd.getNumPartitions()
    while True:
        level = level.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(fold, "part long, r binary")
        width = -(-width // FAN)
        if width == 1:
            return np.frombuffer(level.first()["r"]).reshape(-1, d)


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tournament: in each round every column meets one other, after all rounds each pair has met once."""
    even = d + d % 2
    ring, out = list(range(1, even)), []
    for _ in range(even - 1):
        players = [0, *ring]
        pairs = [(min(a, b), max(a, b)) for a, b in zip(players[: even // 2], players[: even // 2 - 1 : -1], strict=True) if max(a, b) < d]
        out.append(tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2)
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of ``r``, the largest first, by plane rotations of its columns."""
    d = r.shape[1]
    u, v, eps = r.astype(float), np.eye(d), np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(d):
            a, b = np.einsum("ij,ij->j", u[:, p], u[:, p]), np.einsum("ij,ij->j", u[:, q], u[:, q])
            g = np.einsum("ij,ij->j", u[:, p], u[:, q])
            turn = np.abs(g) > 4 * eps * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            p, q, a, b, g = p[turn], q[turn], a[turn], b[turn], g[turn]
            z = (b - a) / (2 * g)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    size = np.sqrt(np.einsum("ij,ij->j", u, u))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


def identity_error(fit: DataFrame, n: int, total: np.ndarray, projection: np.ndarray) -> float:
    """The largest entry, without sign, of the whitened fit list's covariance minus the identity."""
    d, k = projection.shape

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for _, x in _blocks(stream, d):
            w = ((n * x - total) / n) @ projection
            sums += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "total"])

    rows = fit.mapInArrow(partial, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    sums = np.array([r["total"] for r in sorted(rows, key=lambda r: r["cell"])]).reshape(k + 1, k) / n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """SCHEMA: each vector's exact deviation and its whitened value by each of the first ``components`` components."""
    spark = vectors.sparkSession
    every = quantised(vectors, id_col, vector_col)
    widths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if widths is None:
        return spark.createDataFrame([], SCHEMA)
    d = int(widths["d"])
    rows = every.filter(F.size("x") == d)
    fit = stored(rows.select("x").distinct(), "fit-list")
    n, total = totals(fit, d)
    size, vectors_of = jacobi(tsqr(fit, n, total))
    k = int((size[:components] > size[0] * d * np.finfo(float).eps).sum())
    if k == 0:
        return spark.createDataFrame([], SCHEMA)
    values = size * size / n
    projection = vectors_of[:, :k] / np.sqrt(values[:k])
    explained, error = values[:k] / values.sum(), identity_error(fit, n, total, projection)

    def project(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(stream, d):
            off = n * x - total
            if d * float(np.abs(off).max()) ** 2 < 2**62:
                deviation = pa.array(np.repeat((off * off).sum(axis=1), k))
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in off.tolist()]
                deviation = pa.array([e if e < 2**63 else None for e in exact for _ in range(k)], pa.int64())
            ids, b = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(part)), k))), len(part)
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, n)), deviation, pa.array(((off / n) @ projection).ravel()), pa.array(np.tile(explained, b)), pa.array(np.full(b * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, SCHEMA)
