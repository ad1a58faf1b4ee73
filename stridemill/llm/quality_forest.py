"""Quality rules with an isolation forest over rule statistics.

Each document gets rule statistics (counts of words, symbols, repeated lines and repeated three-word windows).
Hard rules fail some documents outright. For the rest isolation trees are grown on labelled rows (each on a random few of all of them), over
length-free ratios of those statistics: one group of trees that split on all ratios, and one group for each ratio, since random
splits over many ratios dilute what a single rule says. A group's expected path length over its random splits is a
score; short paths are anomalous. Each group has a threshold calibrated on the labelled rows, first the group over all ratios,
then those of single ratios for what is left, the one that gains most first; a document that is anomalous to any group goes. Labels place thresholds only.

Defined results: null or empty texts have zero words and fail; texts are read whole; repeated rows are judged each;
an empty table gives an empty table; without labels of both kinds only the hard rules decide; of rows that share a labelled id
the text with the smallest digest is learned from; rows with a null id are judged like others and never learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import numbered
from .common import SEPARATORS, stored, text_rows

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + w[2:]
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    hit = times[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The values of COUNTS."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    full = dup = 0
    for line in lines:
        if line.strip(SEPARATORS):
            full += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(words),
        full,
    )


def ratios(c: np.ndarray) -> np.ndarray:
    """Length-free features of rows of COUNTS."""
    words = np.maximum(c[:, 0], 1)
    chars = np.maximum(c[:, 1], 1)
    lines = np.maximum(c[:, 5], 1)
    return np.stack([c[:, 1] / words, c[:, 2] / chars, c[:, 3] / lines, c[:, 4] / words], axis=1)


def harmonic_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points, which leaves of n points add."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as complete binary arrays: ``feature`` (-1 in leaves), ``split`` and ``path`` of each node."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    size: int
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, about 0.5 and less for the bulk."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                down = f >= 0
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(down, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(harmonic_path(self.size)), 1e-9))


def picks(n: int, trees: int = 100, size: int = 256, seed: int = 7) -> list[np.ndarray]:
    """Which of n rows each tree splits."""
    rng = np.random.default_rng([seed, 1])
    return [rng.choice(n, min(size, n), replace=False) for _ in range(trees)]


def grow(x: np.ndarray, trees: int = 100, size: int = 256, seed: int = 7, picked: list[np.ndarray] | None = None) -> Forest:
    """An isolation forest; each tree splits a random subsample (``picked``) at random values of random features."""
    rng = np.random.default_rng(seed)
    picked = picks(len(x), trees, size, seed) if picked is None else picked
    size = len(picked[0])
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, x[picked[t]])]
        while todo:
            node, level, own = todo.pop()
            low, high = own.min(0), own.max(0)
            live = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(live):
                path[t, node] = level + float(harmonic_path(len(own)))
                continue
            f = rng.choice(live)
            at = rng.uniform(low[f], high[f])
            at = at if at > low[f] else high[f]
            feature[t, node], split[t, node] = f, at
            right = own[:, f] >= at
            todo += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return Forest(feature, split, path, size, depth)


COUNT_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], [*kept, *COUNTS])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS of every document."""
    return text_rows(docs, id_col, text_col).mapInArrow(_count_batches, COUNT_SCHEMA)


def base_failed(c: np.ndarray, least_words: int = 50, most_repeated: int = 50) -> np.ndarray:
    """The hard rules: too few words, or over ``most_repeated`` per cent of words in repeated windows."""
    return (c[:, 0] < least_words) | (100 * c[:, 4] > most_repeated * c[:, 0])


@dataclass
class Verdicts:
    """Groups of trees, each with the ratios that it splits on and the score above which a document is anomalous to it."""

    groups: list[tuple[Forest, list[int], float]]

    def __call__(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of the group over all ratios, and whether every group lets the document pass."""
        x, kept, first = ratios(c), np.ones(len(c), bool), np.zeros(len(c))
        for k, (forest, own, threshold) in enumerate(self.groups):
            score = forest.score(x[:, own])
            kept &= score <= threshold
            first = score if k == 0 else first
        return first, kept


def calibrated(score: np.ndarray, bad: np.ndarray, price: float) -> tuple[float, float]:
    """The threshold with the largest share of bad rows above it, less ``price`` times that of good rows, and that difference."""
    if not len(score):
        return 1.0, 0.0
    order = np.argsort(-score, kind="stable")
    s = score[order]
    gain = np.cumsum(bad[order]) / max(1, bad.sum()) - price * np.cumsum(~bad[order]) / max(1, (~bad).sum())
    last = np.append(s[1:] < s[:-1], True)
    gain = np.where(last, gain, -np.inf)
    at = int(np.argmax(gain))
    if gain[at] <= 0:
        return 1.0, 0.0
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else 0.0, float(gain[at])


def learned(c: np.ndarray, bad: np.ndarray, price: float, **forest) -> Verdicts:
    """Groups and thresholds from rows of COUNTS that pass the hard rules, and which of these are bad."""
    if len(c) < 16 or bad.all() or not bad.any():
        return Verdicts([])
    x, groups = ratios(c), []
    left = np.ones(len(x), bool)
    waiting = [[k] for k in range(x.shape[1])]
    grown = {tuple(own): (model, model.score(x[:, own])) for own in [list(range(x.shape[1])), *waiting] for model in [grow(x[:, own], **forest)]}
    own = list(range(x.shape[1]))
    while True:
        model, score = grown[tuple(own)]
        threshold, _ = calibrated(score[left], bad[left], price) if bad[left].any() else (1.0, 0.0)
        groups.append((model, own, threshold))
        left &= score <= threshold
        if not waiting:
            return Verdicts(groups)
        own = max(waiting, key=lambda k: calibrated(grown[tuple(k)][1][left], bad[left], price)[1] if bad[left].any() else 0.0)
        waiting.remove(own)


#: Labelled rows up to which all are learned from in one place.
GATHERED = 8192


def fit(docs: DataFrame, labels: DataFrame, price: float = 100.0, **forest) -> Verdicts:
    """Grow the trees on labelled rows and place their thresholds, by all labelled rows.

    A document labelled twice counts with its lowest quality. ``price`` is what losing a share of good rows costs in shares of bad rows: at 100,
    a hundredth of the good rows costs as much as all bad ones are worth. Up to GATHERED labelled rows are ``learned`` from on the driver, more by
    ``_learned_apart``, with the same result.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("of"), "quality").dropna().groupBy("of").agg(F.min("quality").alias("quality")).filter("quality IN (0, 1)")
    told = text_rows(docs).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).mapInArrow(_count_batches, f"doc_id long, digest string, {COUNT_SCHEMA.partition(', ')[2]}")
    least = F.min(F.struct("digest", *COUNTS)).alias("least")
    rows = stored(told.join(ids, F.col("doc_id") == F.col("of")).groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "least.*").drop("digest"), "labelled")
    if rows.count() > GATHERED:
        return _learned_apart(rows, price, **forest)
    got = sorted(map(tuple, rows.select("doc_id", "quality", *COUNTS).collect()))
    c, bad = np.array([r[2:] for r in got], np.int64).reshape(-1, len(COUNTS)), np.array([r[1] == 0 for r in got], bool)
    passed = ~base_failed(c)
    return learned(c[passed], bad[passed], price, **forest)


def _learned_apart(rows: DataFrame, price: float, **forest) -> Verdicts:
    """``learned`` on rows that stay where they are: the driver gets just the rows that trees split, and sums of score ranges."""
    passed = rows.filter("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words").withColumn("bad", (F.col("quality") == 0).cast("long"))
    passed = stored(numbered(passed.select("doc_id", "bad", *COUNTS), ["doc_id"], "number"), "passed")
    n, bad = passed.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if n < 16 or bad in (0, n):
        return Verdicts([])
    chosen = picks(n, **forest)
    needed = np.unique(np.concatenate(chosen))
    wanted = passed.sparkSession.createDataFrame([(int(k),) for k in needed], "number long")
    got = sorted(map(tuple, passed.join(F.broadcast(wanted), "number").select("number", *COUNTS).collect()))
    x, picked = ratios(np.array([r[1:] for r in got], np.int64)), [np.searchsorted(needed, p) for p in chosen]
    owns = [list(range(x.shape[1])), *([k] for k in range(x.shape[1]))]
    models = [grow(x[:, own], picked=picked, **forest) for own in owns]
    names = [f"s{k}" for k in range(len(owns))]
    model = passed.sparkSession.sparkContext.broadcast(models)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own = ratios(np.stack([np.asarray(batch.column(c)) for c in COUNTS], axis=1).reshape(-1, len(COUNTS)))
            yield pa.RecordBatch.from_arrays([batch.column("bad"), *(pa.array(m.score(own[:, k])) for m, k in zip(model.value, owns, strict=True))], ["bad", *names])

    left = stored(passed.mapInArrow(batches, "bad long, " + ", ".join(f"{c} double" for c in names)), "scores")
    groups, waiting, k = [], list(range(1, len(owns))), 0
    best = _calibrated_apart(left, [0], price)
    while True:
        groups.append((models[k], owns[k], best[k][0]))
        left = left.filter(F.col(names[k]) <= best[k][0])
        if not waiting:
            return Verdicts(groups)
        best = _calibrated_apart(left, waiting, price)
        k = max(waiting, key=lambda w: best[w][1])
        waiting.remove(k)


def _calibrated_apart(left: DataFrame, of: list[int], price: float) -> dict[int, tuple[float, float]]:
    """``calibrated`` of the scores of each group in ``of``. Where a range of scores is best doesn't depend on the rows above it, so a range is a row to the driver."""
    n, bad = left.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    out = {k: (1.0, 0.0) for k in of}
    if not bad:
        return out
    share = lambda b, g: b / max(1, bad) - price * g / max(1, n - bad)

    def ranges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in stream if len(b)]
        if held:
            table = pa.Table.from_batches(held)
            k, s, b, g = (np.asarray(table.column(c)) for c in ("k", "s", "b", "g"))
            found = []
            for one in np.unique(k):
                own, cb, cg = s[k == one], np.cumsum(b[k == one]), np.cumsum(g[k == one])
                at = int(np.argmax(share(cb, cg)))
                found.append((int(one), float(own[0]), int(cb[-1]), int(cg[-1]), float(own[at]), int(cb[at]), int(cg[at]), float(own[at + 1]) if at + 1 < len(own) else None))
            yield pa.RecordBatch.from_pylist([dict(zip(columns, f, strict=True)) for f in found], pa.schema(list(zip(columns, kinds, strict=True))))

    columns, kinds = ["k", "first", "b", "g", "s", "cb", "cg", "next"], [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
    cells = left.select("bad", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("s")) for k in of))).alias("x")).groupBy("x.k", "x.s").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g"))
    order = [F.col("k"), F.col("s").desc()]
    dealt = cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(ranges, "k int, first double, b long, g long, s double, cb long, cg long, next double")
    told = sorted(map(tuple, dealt.collect()), key=lambda r: (r[0], -r[1]))
    before, gain = {k: (0, 0) for k in of}, dict.fromkeys(of, 0.0)
    for i, (k, _, b, g, s, cb, cg, after) in enumerate(told):
        now = share(before[k][0] + cb, before[k][1] + cg)
        if now > gain[k]:
            if after is None and i + 1 < len(told) and told[i + 1][0] == k:
                after = told[i + 1][1]
            gain[k], out[k] = now, ((s + after) / 2 if after is not None else 0.0, float(now))
        before[k] = (before[k][0] + b, before[k][1] + g)
    return out


def judge(docs: DataFrame, verdicts: Verdicts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS, ``base_failed``, ``anomaly`` and ``kept`` of every document. One pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(verdicts)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _count_batches(stream):
            c = np.stack([np.asarray(batch.column(name)) for name in COUNTS], axis=1).reshape(-1, len(COUNTS))
            failed = base_failed(c)
            score, kept = model.value(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept & ~failed)], [*batch.schema.names, "base_failed", "anomaly", "kept"])

    return text_rows(docs, id_col, text_col).mapInArrow(batches, f"{COUNT_SCHEMA}, base_failed boolean, anomaly double, kept boolean")
