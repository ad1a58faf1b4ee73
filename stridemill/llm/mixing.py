"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token counts are summed into cells (source, language, topic) first; the raking sees only cells. Each sweep scales the
cells so that one marginal after another meets its target shares, and never takes more of a cell than it has.
A document's probability is what its cell keeps over what its cell has; it's kept if a hash of its id falls below that.

A share of the budget that a value's tokens can't fill is projected to the nearest that they can: the value gives all it has,
and the rest of its share goes to the others in proportion. ``probabilities`` has both, and what the raking reached.

Up to ``DRIVER_CELLS`` cells (counted first) are raked on the driver, more as tables. Probabilities are rounded to
1e-6, far above what the order of summation changes, so both ways sample the same documents.

Defined results: null sources, languages and topics are the value "(none)"; null and empty texts have no tokens and their cell's probability;
cells without tokens keep the budget's share; repeated rows share their fate, as the hash is of the id (a null id has a hash too);
an empty table gives an empty table; target values that don't occur are ignored and the others fill up; values that a mapping leaves out,
"(none)" among them, share what it leaves, so they are excluded only by a mapping of shares that sum to 1; other columns are kept by
``sample``, whatever their names, and ignored by ``probabilities``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Up to so many cells are raked on the driver and broadcast (a few dozen MB); the count is checked, more are raked as a table.
DRIVER_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")

#: Explicit shares by value, or an exponent that the observed shares are raised to (0: equal shares, 1: as they are).
Target = Mapping[str, float] | float


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


#: Words this long or longer can name a topic; shorter ones are mostly grammar.
TOPIC_WORD = 6
WORD = re.compile("[^ \\t\\n\\x0b\\f\\r]+")


def leading_topic(text: str | None, topics: int = 8) -> str:
    """The class, of ``topics``, of the word of TOPIC_WORD characters or more that a text has most (of equally frequent ones the first
    in order); "none" without such words. Texts about one thing keep naming it, so they share a class."""
    count = Counter(w for w in WORD.findall((text or "").lower()) if len(w) >= TOPIC_WORD)
    if not count:
        return "none"
    most = max(count.values())
    return f"topic{zlib.crc32(min(w for w, n in count.items() if n == most).encode('utf-8', 'surrogatepass')) % topics}"


def word_topic(text: Column, topics: int = 8) -> Column:
    """``leading_topic`` of a column: what stands in for a topic model where a table has no topics. In Arrow batches; the same by
    expressions over sorted arrays of words took three times the CPU."""

    def batches(texts: pa.Array) -> pa.Array:
        return pa.array([leading_topic(t, topics) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(batches, "string")(text)


_KEYS = [f"__mix_{d}" for d in DIMENSIONS]


def keyed(docs: DataFrame, topic: Column, text_col: str = "text") -> DataFrame:
    """__mix_source, __mix_lang, __mix_topic, __mix_tokens, and ``docs`` as the struct __mix_row."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    columns = {"__mix_source": value(F.col("source")), "__mix_lang": value(F.col("lang")), "__mix_topic": value(topic), "__mix_tokens": word_count(F.col(text_col))}
    return docs.select(*(c.alias(k) for k, c in columns.items()), F.struct(*(f"`{c}`" for c in docs.columns)).alias("__mix_row"))


def shares(observed: np.ndarray, names: list[str], target: Target) -> np.ndarray:
    """Target shares of the values of one dimension. Values that a mapping leaves out split what it leaves, as observed."""
    p = observed / observed.sum()
    if isinstance(target, Mapping):
        given = np.array([target.get(v, np.nan) for v in names])
        rest = np.isnan(given)
        left = max(0.0, 1 - np.nansum(given)) if rest.any() else 0.0
        p = np.where(rest, left * p / max(p[rest].sum(), 1e-300), np.nan_to_num(given))
    else:
        p = np.where(p > 0, p, 0) ** target * (p > 0)
    return p / p.sum()


def feasible(goal: np.ndarray, have: np.ndarray, budget: float) -> np.ndarray:
    """``goal`` (shares) with no value above what it has: ``have`` tokens of ``budget`` times them all."""
    most = have / (budget * have.sum())
    full = np.zeros(len(goal), bool)
    while True:
        left, rest = 1 - most[full].sum(), goal[~full].sum()
        now = np.where(full, most, goal * (left / rest if rest > 0 else 0.0))
        over = ~full & (now > most)
        if not over.any():
            return now
        full |= over


def rake(tokens: np.ndarray, codes: np.ndarray, goals: list[np.ndarray], budget: float, sweeps: int, tolerance: float) -> np.ndarray:
    """Tokens to keep of each cell. ``codes``: one row per dimension, of the cells' values; ``goals``: target shares."""
    total = budget * tokens.sum()
    kept = budget * tokens
    for _ in range(sweeps):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            have = np.bincount(code, kept, len(goal))
            ratio = np.where(have > 0, goal * total / np.maximum(have, 1e-300), 1.0)
            new = np.minimum(kept * ratio[code], tokens)
            worst = max(worst, float(np.abs(new - kept).sum() / total))
            kept = new
        if worst < tolerance:
            break
    return kept


def _goals(cells: DataFrame, dimension: str, target: Target, budget: float) -> DataFrame:
    """(value, goal, have) of one dimension, as ``shares`` and ``feasible`` would have it, for any number of values."""
    value = f"__mix_{dimension}"
    seen = cells.groupBy(value).agg(F.sum("tokens").cast("double").alias("have"))
    if isinstance(target, Mapping):
        given = F.create_map(*(x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(value)] if target else F.lit(None).cast("double")
        seen = seen.withColumn("g", given)
        known, rest = seen.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("have"))), F.lit(0.0))).first()
        p = F.when(F.col("g").isNotNull(), F.col("g")).otherwise(F.lit(max(0.0, 1 - known)) * F.col("have") / F.lit(max(float(rest), 1e-300)))
    else:
        p = F.when(F.col("have") > 0, F.pow(F.col("have"), F.lit(float(target)))).otherwise(0.0)
    seen = stored(seen.select(value, "have", p.alias("p")), "seen")
    total, all_p = seen.agg(F.sum("have"), F.sum("p")).first()
    most = F.col("have") / F.lit(budget * total)
    full, found = F.lit(False), -1
    while True:  # each round fills at least one more value
        left, rest, filled = seen.agg(F.lit(1.0) - F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("p") / all_p)), F.lit(0.0)), F.sum(full.cast("int"))).first()
        scale = left / rest if rest > 0 else 0.0
        now = F.when(full, most).otherwise(F.col("p") / all_p * scale)
        if filled == found:
            return stored(seen.select(value, now.alias("goal"), "have", (F.col("p") / all_p).alias("target")), "goal")
        found = filled
        over = F.col("p") / all_p * scale > most
        seen = stored(seen.withColumn("full", full | over), "seen")
        full = F.col("full")


def _rake_table(cells: DataFrame, goals: dict[str, DataFrame], budget: float, sweeps: int, tolerance: float) -> DataFrame:
    """The same for more cells than the driver should hold: one written table per sweep, marginals by aggregation and join."""
    total = budget * cells.agg(F.sum("tokens")).first()[0]
    cells = cells.withColumn("kept", F.col("tokens") * budget)
    for _ in range(sweeps):
        before, old = cells.select(*_KEYS, F.col("kept").alias("before")), []
        for d in DIMENSIONS:
            have = cells.groupBy(f"__mix_{d}").agg(F.sum("kept").alias("have")).join(goals[d].select(f"__mix_{d}", "goal"), f"__mix_{d}")
            ratio = have.select(f"__mix_{d}", F.when(F.col("have") > 0, F.col("goal") * total / F.col("have")).otherwise(1.0).alias("ratio"))
            last, cells = cells, stored(cells.join(ratio, f"__mix_{d}").withColumn("kept", F.least(F.col("kept") * F.col("ratio"), F.col("tokens").cast("double"))).drop("ratio"), "cells")
            old.append(last)
        moved = cells.join(before, _KEYS).agg(F.sum(F.abs(F.col("kept") - F.col("before")))).first()[0]
        forget(*(t for t in old if hasattr(t, "place")))
        if moved / total < tolerance:
            break
    return cells


#: What ``probabilities`` says of each marginal: the share asked for, the nearest that its tokens can fill, and the share reached.
_MARGINALS = [f"{d}_{what}" for d in DIMENSIONS for what in ("target", "goal", "reached")]


def cell_probabilities(rows: DataFrame, targets: Mapping[str, Target], budget: float = 0.5, sweeps: int = 100, tolerance: float = 1e-9, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """(__mix_source, __mix_lang, __mix_topic, __mix_p, and _MARGINALS) of every cell of keyed rows, and whether that is small enough to broadcast."""
    spark = rows.sparkSession
    cells = stored(rows.groupBy(*_KEYS).agg(F.sum("__mix_tokens").alias("tokens")), "cells")
    if cells.count() <= driver_cells:
        got = sorted(map(tuple, cells.collect()))
        forget(cells)
        tokens = np.array([r[3] for r in got], float)
        kept, said = budget * tokens, np.zeros((len(got), len(_MARGINALS)))
        if tokens.sum() > 0:
            coded = [np.unique([r[k] for r in got], return_inverse=True) for k in range(3)]
            asked = [shares(np.bincount(c, tokens), list(v), targets.get(d, 1.0)) for d, (v, c) in zip(DIMENSIONS, coded, strict=True)]
            goals = [feasible(g, np.bincount(c, tokens), budget) for g, (_, c) in zip(asked, coded, strict=True)]
            kept = rake(tokens, np.stack([c for _, c in coded]), goals, budget, sweeps, tolerance)
            for k, (_, c) in enumerate(coded):
                said[:, 3 * k : 3 * k + 3] = np.stack([asked[k], goals[k], np.bincount(c, kept) / kept.sum()], axis=1)[c]
        p = np.where(tokens > 0, kept / np.maximum(tokens, 1), budget).round(6)
        schema = ", ".join([f"{k} string" for k in _KEYS] + [f"{k} double" for k in ("__mix_p", *_MARGINALS)])
        return spark.createDataFrame([(*r[:3], float(x), *map(float, m)) for r, x, m in zip(got, p, said.round(6), strict=True)], schema), True
    if cells.filter("tokens > 0").isEmpty():
        return cells.select(*_KEYS, F.lit(budget).alias("__mix_p"), *(F.lit(0.0).alias(m) for m in _MARGINALS)), False
    goals = {d: _goals(cells, d, targets.get(d, 1.0), budget) for d in DIMENSIONS}
    cells = _rake_table(cells, goals, budget, sweeps, tolerance)
    reached = cells.agg(F.sum("kept")).first()[0]
    for d in DIMENSIONS:
        own = cells.groupBy(f"__mix_{d}").agg((F.sum("kept") / reached).alias(f"{d}_reached")).join(goals[d], f"__mix_{d}")
        cells = cells.join(own.select(f"__mix_{d}", F.col("target").alias(f"{d}_target"), F.col("goal").alias(f"{d}_goal"), f"{d}_reached"), f"__mix_{d}")
    p = F.when(F.col("tokens") > 0, F.col("kept") / F.greatest("tokens", F.lit(1))).otherwise(budget)
    return stored(cells.select(*_KEYS, F.round(p, 6).alias("__mix_p"), *(F.round(m, 6).alias(m) for m in _MARGINALS)), "probabilities"), False


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) * F.lit(math.ldexp(1.0, -53))


def _calibrated(docs: DataFrame, topic: Column, targets: Mapping[str, Target], budget: float, seed: int, **how) -> DataFrame:
    rows = keyed(docs, topic)
    cells, small = cell_probabilities(rows.select(*_KEYS, "__mix_tokens"), targets, budget, **how)
    joined = rows.join(F.broadcast(cells) if small else cells, _KEYS)
    return joined.withColumn("__mix_kept", uniform(F.col("__mix_row.doc_id"), seed) < F.col("__mix_p"))


def probabilities(docs: DataFrame, topic: Column, targets: Mapping[str, Target], budget: float = 0.5, seed: int = 1, **how) -> DataFrame:
    """Every document's cell, tokens, probability, weight (its inverse) and whether it's sampled, and its cell's _MARGINALS."""
    named = {"__mix_source": "source", "__mix_lang": "lang", "__mix_topic": "topic", "__mix_tokens": "n_tokens", "__mix_p": "probability"}
    out = _calibrated(docs.select("doc_id", "source", "lang", "text"), topic, targets, budget, seed, **how)
    weight = F.try_divide(F.lit(1.0), F.col("__mix_p")).alias("weight")
    return out.select("__mix_row.doc_id", *(F.col(a).alias(b) for a, b in named.items()), weight, F.col("__mix_kept").alias("selected"), *_MARGINALS)


def sample(docs: DataFrame, topic: Column, targets: Mapping[str, Target], budget: float = 0.5, seed: int = 1, **how) -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    return _calibrated(docs, topic, targets, budget, seed, **how).filter("__mix_kept").select("__mix_row.*")
