"""Brute-force vector search: the best of all other vectors for every query.

Vectors meet in blocks: one matrix product of a batch of the corpus with the queries, of which each query (and shard) keeps its
best. Scores within rounding of a best are summed again term by term, so equal vectors tie whatever the blocks, and ties go to the
smaller index. Vectors that are null, empty or hold nulls, and pairs of unequal lengths, take no part; NaN never wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import against_all, by_blocks
from .vector import PositionalVector

_FOUND = ["query_id", "colocation_index", "best_index", "score"]
_FOUND_SCHEMA = "query_id long, colocation_index long, best_index long, score double"


def dot(a: Column, b: Column) -> Column:
    """The inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored(corpus: DataFrame, queries: DataFrame, score: str = "dot", include_self: bool = False) -> DataFrame:
    """(query_id, best_index, score) of every query and vector: a row per pair, by expressions alone, to check the blocks with."""
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) if score == "cosine" else F.lit(1.0)  # once per vector, not per pair
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), norm.alias("q_norm"))
    c = corpus.select(F.col("vec_id").alias("best_index"), F.col("embedding").alias("e"), norm.alias("e_norm"))
    pairs = against_all(c, q, "best_index", row_bytes=1024)
    if not include_self:
        pairs = pairs.filter(F.col("query_id") != F.col("best_index"))
    product = dot(F.col("q"), F.col("e"))
    if score == "cosine":
        product = 1 - F.try_divide(product, F.col("q_norm") * F.col("e_norm"))  # null, so none, for vectors without length
    return pairs.select("query_id", "best_index", product.alias("score")).filter(~F.isnan("score"))


def _matrices(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by length."""
    table = table.combine_chunks()
    size = np.asarray(pc.list_value_length(table.column(1)))
    out = {}
    for d in np.unique(size[size > 0]):
        own = table.filter(pa.array(size == d))
        flat = own.column(1).combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
        out[int(d)] = np.asarray(own.column(name)).astype(np.int64), np.asarray(flat.flatten(), float).reshape(len(own), d)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def _kernel(cosine: bool, include_self: bool, shards: int, together: int = 4_000_000):
    """The best of a part of the corpus for every query, by shard. Distances are negated, so that the largest is the best."""

    def kernel(parts: Iterator[pa.Table], queries: pa.Table) -> pa.Table:
        asked = _matrices(queries, "query_id")
        best = {d: (np.full((len(ids), shards), -np.inf), np.full((len(ids), shards), -1)) for d, (ids, _) in asked.items()}
        lengths = {d: _norms(q) if cosine else None for d, (_, q) in asked.items()}
        for part in parts:
            for d, (index, e) in _matrices(part, "best_index").items():
                if d not in asked:
                    continue
                ids, q = asked[d]
                norm = _norms(e) if cosine else None
                step = max(1, together // len(q))
                for shard in range(shards):
                    own = np.flatnonzero(index % shards == shard)
                    own = own[np.argsort(index[own], kind="stable")]
                    for a in range(0, len(own), step):
                        rows = own[a : a + step]
                        with np.errstate(invalid="ignore", divide="ignore"):
                            s = q @ e[rows].T
                            if cosine:
                                s = s / (lengths[d][:, None] * norm[rows]) - 1
                        if not include_self:
                            s[ids[:, None] == index[rows]] = np.nan
                        s[np.isnan(s)] = -np.inf
                        near = s.max(axis=1, initial=-np.inf)
                        near = np.where(np.isfinite(near), near - 1e-9 * (1 + np.abs(near)), near)
                        k, c = np.nonzero((s >= near[:, None]) & (s > -np.inf))
                        exact = np.cumsum(q[k] * e[rows[c]], axis=1)[:, -1]
                        if cosine:
                            exact = exact / (lengths[d][k] * norm[rows[c]]) - 1
                        order = np.lexsort((index[rows[c]], -exact, k))  # the first of each query is its best here
                        k, c, exact = k[order], c[order], exact[order]
                        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
                        k, found, exact = k[first], index[rows[c[first]]], exact[first]
                        held, at = best[d]
                        better = (exact > held[k, shard]) | ((exact == held[k, shard]) & (found < at[k, shard])) | (at[k, shard] < 0)
                        held[k[better], shard], at[k[better], shard] = exact[better], found[better]
        columns = []
        for d, (ids, _) in asked.items():
            k, shard = np.nonzero(best[d][1] >= 0)
            columns.append((ids[k], shard, best[d][1][k, shard], best[d][0][k, shard]))
        whole = [np.concatenate(x) for x in zip(*columns, strict=True)] if columns else [np.zeros(0, int)] * 3 + [np.zeros(0)]
        return pa.table([pa.array(w) for w in whole], names=_FOUND)

    return kernel


def best_by_shard(corpus: DataFrame, queries: DataFrame, score: str = "dot", shards: int = 1, include_self: bool = False, **how) -> DataFrame:
    """(query_id, colocation_index, best_index, score): the best of every shard for each query. ``corpus`` and ``queries``: vec_id, embedding."""
    whole = lambda df, name: df.select(F.col("vec_id").cast("long").alias(name), F.col("embedding").cast("array<double>").alias(f"{name}_vector")).filter(
        F.col(name).isNotNull() & F.forall(f"{name}_vector", lambda x: x.isNotNull())
    )
    c, q = whole(corpus, "best_index"), whole(queries, "query_id")
    width = q.agg(F.max(F.size("query_id_vector"))).first()[0] or 1
    found = by_blocks(c, q, "best_index", "query_id", _kernel(score == "cosine", include_self, shards), _FOUND_SCHEMA, 8 * int(width) + 8, **how)
    return best(found, by_shard=True).withColumn("score", -F.col("score") if score == "cosine" else F.col("score"))


def best(found: DataFrame, by_shard: bool = False) -> DataFrame:
    """The best row of each query (and shard): ties go to the smaller index."""
    keys = ["query_id", "colocation_index"] if by_shard else ["query_id"]
    top = F.max(F.struct("score", (-F.col("best_index")).alias("negated"), F.col("colocation_index").alias("of"))).alias("top")
    columns = {"query_id": F.col("query_id"), "colocation_index": F.col("top.of"), "best_index": -F.col("top.negated"), "score": F.col("top.score")}
    return found.groupBy(*keys).agg(top).select(*(c.alias(name) for name, c in columns.items()))


def search_dot(corpus: DataFrame, queries: DataFrame, shards: int = 4, include_self: bool = False, **how) -> DataFrame:
    """(query_id, best_index, colocation_index, best_similarity)."""
    found = best_by_shard(corpus, queries, "dot", 1, include_self, **how)
    return found.select("query_id", "best_index", F.pmod("best_index", F.lit(shards)).alias("colocation_index"), F.col("score").alias("best_similarity"))


def search_sharded(corpus: DataFrame, queries: DataFrame, shards: int = 4, include_self: bool = False, **how) -> DataFrame:
    """As ``search_dot``, by way of the best of every shard."""
    partial = best_by_shard(corpus, queries, "dot", shards, include_self, **how)
    return best(partial).select("query_id", "best_index", "colocation_index", F.col("score").alias("best_similarity"))


def search_cosine(corpus: DataFrame, queries: DataFrame, include_self: bool = False, **how) -> DataFrame:
    """(query_id, best_index, best_distance): the smallest cosine distance."""
    found = best_by_shard(corpus, queries, "cosine", 1, include_self, **how)
    return found.select("query_id", "best_index", F.col("score").alias("best_distance"))


def with_empty(found: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for every query; those without a candidate get -infinity and index 0."""
    every = queries.select(F.col("vec_id").alias("query_id")).join(found, "query_id", "left")
    return every.fillna({"best_index": 0, "colocation_index": 0}).withColumn("best_similarity", F.coalesce("best_similarity", F.lit(float("-inf"))))


def appended(halves: tuple[PositionalVector, PositionalVector], more: PositionalVector) -> tuple[PositionalVector, PositionalVector]:
    """Two halves of a corpus with the elements of ``more`` appended one after another, each to the half that is then the shorter.

    The first ones fill the shorter half up; from then on halves take turns, the first half before the second."""
    a, b = halves
    lead = min(abs(a.length - b.length), more.length)
    short, pos, rest = (0 if a.length <= b.length else 1), F.col("pos"), more.length - lead
    half = F.when(pos < lead, F.lit(short)).otherwise(F.pmod(pos - lead, F.lit(2)))
    place = F.when(pos < lead, pos).otherwise(F.call_function("div", pos - lead, F.lit(2)))
    given = more.df.select(half.alias("half"), place.alias("pos"), (pos < lead).alias("leading"), "value")
    out = []
    for k, own in enumerate(halves):
        before = own.length + (lead if k == short else 0)
        start = F.when(F.col("leading"), F.lit(own.length)).otherwise(F.lit(before))
        added = given.filter(F.col("half") == k).select((F.col("pos") + start).cast("long").alias("pos"), "value")
        out.append(PositionalVector(own.df.unionByName(added), before + (rest + 1 - k) // 2, own.shard))
    return out[0], out[1]
