"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks by their id, and so are queries, into blocks that are large too: every pair of blocks is one
task, no task grows with the data, and with the blocks' sizes as they are each vector is sent a few dozen times even
among hundreds of millions. A block keeps one list per dimension, sorted by that component. For a query the lists are read in
parallel from whichever end adds most; whatever turns up is scored in full; and reading stops when the sum of the
components just read, the most that anything unread can score, is below the kth score. Each block's k best are then merged,
those of one task first.

In many dimensions the bound falls slowly and most of a block gets scored, of vectors without any preferred direction all
of it; ``report`` says how much. The result is exact either way.

Defined results: vectors that are null, empty or hold a null, a non-finite or a component beyond 64-bit integers once scaled take no part;
only vectors of equal length meet; ties go to the smaller id; repeated candidate rows each count, repeated query rows once; a
null id takes no part; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, x): vectors with components floor(scale * component) as longs."""
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < 2.0**62)
    x = F.transform(vector_col, lambda v: v.cast("double"))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("d"))
        .filter((F.size("d") > 0) & F.col("id").isNotNull() & F.forall("d", fits))
        .select("id", F.transform("d", lambda v: F.floor(v * scale).cast("long")).alias("x"))
    )


class Block:
    """Candidates with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.lists, axis=0)
        #: Products and their sums stay exact in doubles below 2 ** 53.
        self.top = float(np.abs(self.x.astype(float)).max(initial=0))
        self.real = self.x.astype(float) if self.top < 2**40 else None

    def scores(self, rows: np.ndarray, q: np.ndarray, products: "Products | None" = None) -> np.ndarray:
        if self.real is not None and self.top * float(np.abs(q.astype(float)).max()) * len(q) < 2**53:
            if 4 * len(rows) > len(self.real):  # for most of the rows one product over all is cheaper than gathering them
                return (products.of(self.real, q) if products else self.real @ q.astype(float))[rows].astype(np.int64)
            return (self.real[rows] @ q.astype(float)).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in self.x[rows]], object)

    def top_k(self, own: int, q: np.ndarray, k: int, step: int = 32, products: "Products | None" = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores) other than ``own``, and how many rows were scored for them."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        down = q[used] > 0
        high, low = used[down], used[~down]
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, own) : np.searchsorted(self.ids, own, "right")] = True  # never the query's own row
        left = int(n - seen.sum())
        rows, score = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, scored = 0, 0
        while depth < n and scored < left:
            reach = min(n, max(step, 2 * depth))
            met = np.full(n, not len(used))
            met[self.lists[n - reach : n - depth, high]] = True
            met[self.lists[depth:reach, low]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scored += len(new)
            rows, score = np.append(rows, new), np.append(score, self.scores(new, q, products))
            if len(rows) > k:  # all ties of the kth score stay until they're sorted
                fit = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[fit], score[fit]
            best = np.lexsort((rows, -score))[:k]
            rows, score = rows[best], score[best]
            depth = reach
            at = np.where(down, n - depth, depth - 1)
            bound = sum(int(a) * int(b) for a, b in zip(q[used], self.sorted[at, used], strict=True))
            if len(rows) == k and bound < score[-1]:  # at equal scores an unread row might have a smaller id
                break
        return self.ids[rows], score, scored


class Products:
    """Inner products of all rows of a block with a few queries at a time, made when the first of these needs them."""

    def __init__(self, queries: np.ndarray):
        self.queries, self.made = queries, None

    def of(self, real: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.made is None:
            self.made = dict(zip(map(bytes, self.queries), self.queries.astype(float) @ real.T, strict=True))
        return self.made[bytes(q)]


#: Queries that share one product with a block.
TOGETHER = 32


def _solve(k: int):
    def task(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            block = Block(candidates["id"].to_numpy(), np.stack(candidates["x"].to_list()))
            n = len(block.ids)
            for a in range(0, len(queries), TOGETHER):
                part = queries.iloc[a : a + TOGETHER]
                x = np.stack(part["y"].to_list())
                products = Products(x)
                for own, mark, q in zip(part["query"], part["mark"], x, strict=True):
                    ids, score, scored = block.top_k(own, q, k, products=products)
                    out += [(own, mark, i, int(s), scored, n) for i, s in zip(ids, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score", "scored", "block"])

    return task


def _found(candidates: DataFrame, queries: DataFrame, k: int, block: int, query_block: int) -> DataFrame:
    queries = queries.dropDuplicates(["id", "x"])
    n, m = _blocks(candidates, block), _blocks(queries, query_block)
    part: Column = F.pmod(F.xxhash64("id"), F.lit(n))
    share: Column = F.pmod(F.xxhash64("id"), F.lit(m))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<long>"))
    left = candidates.select("id", "x", F.size("x").alias("dims"), part.alias("b"), every(m).alias("q"))
    right = queries.select(F.col("id").alias("query"), F.col("x").alias("y"), F.xxhash64("x").alias("mark"), F.size("x").alias("dims"), every(n).alias("b"), share.alias("q"))
    keys = ["dims", "b", "q"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_solve(k), "query_id long, mark long, vec_id long, score long, scored long, block long")


def _blocks(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


#: Vectors in a block of candidates (of 64 components: 70 MB with lists and doubles) and in a block of queries.
CANDIDATES, QUERIES = 32_768, 16_384


def top_k(candidates: DataFrame, queries: DataFrame, k: int, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query. Both tables are (id, x: array of long)."""
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    found = _found(candidates, queries, k, block, query_block)
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(candidates: DataFrame, queries: DataFrame, k: int, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """``query_id, scored, candidates``: of how many candidates each query took the score before its bound let it stop."""
    found = _found(candidates, queries, k, block, query_block).select("query_id", "mark", "scored", "block", F.spark_partition_id().alias("p"))
    once = found.groupBy("query_id", "mark", "p", "block").agg(F.max("scored").alias("scored"))
    return once.groupBy("query_id", "mark").agg(F.sum("scored").alias("scored"), F.sum("block").alias("candidates")).drop("mark")
