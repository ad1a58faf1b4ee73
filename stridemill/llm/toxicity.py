"""Toxicity from a weighted lexicon, learned from labels and matched by an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and digit substitutions to plain letters, everything else to single blanks.
Lexicon entries are words and word beginnings with a log-odds weight. One automaton pass over the folded text finds
the entries at word starts; matches inside an exception phrase (two words, one an entry's, found in clean labelled texts and
in no toxic one) don't count. What a text has matched, in all and in proportion to its length, goes through a logistic curve.
The curve is fitted on what the lexicon of one half of the labelled rows finds in the other, as entries fit their own rows too well.

Defined results: null and empty texts match nothing and get the curve's value there; texts are read whole; repeated rows are
scored each; of rows that share a labelled id the text with the smallest digest is learned from; an empty table gives an empty
table; without labels of both kinds in both halves every score is 0; other columns are ignored. Rows with a null id are scored like
others and are held out, as no label is theirs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, slices, stored, text_rows

# Look-alike letters of other scripts, digits and signs, and the letters that they stand for.
_LOOKALIKES = "аa вb мm нh тt кk еe оo рp сc хx уy іi ѕs јj ԁd һh ԛq ԝw ɡg αa εe οo ρp νv κk ιi τt υu 0o 1i 3e 4a 5s 7t @a $s"
#: The shortest and the longest word beginning that can be an entry. Longer words are whole entries; their longer beginnings would
#: say little more, and all those of a word take the square of its length.
SHORTEST, LONGEST = 4, 9


class _Fold(dict):
    """For str.translate: filled as characters turn up."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = code if c.isalpha() else 0x20
        return self[code]


_FOLD = _Fold({ord(x[0]): ord(x[1]) for x in _LOOKALIKES.split()})


def fold(text: str) -> str:
    """Lower case, look-alikes to plain letters, all but letters to blanks."""
    return text.lower().translate(_FOLD)


def entries(words: set[str]) -> set[str]:
    """What can stand in a lexicon: " word " for whole words, " begin" for beginnings."""
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def in_train(doc_id: Column | str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


@dataclass
class Lexicon:
    """``weights`` by entry; ``exceptions``: phrases inside which entries don't count; ``curve``: of the logistic score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: np.ndarray | None = None
    _auto: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_auto": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for e, w in self.weights.items():
                self._auto.add_word(e, (len(e), w, False))
            for p in self.exceptions:
                phrase = f" {' '.join(fold(p).split())} "
                self._auto.add_word(phrase, (len(phrase), 0.0, True))
            self._auto.make_automaton()
        return self._auto

    def features(self, text: str) -> tuple[float, float, float]:
        """The largest weight matched, log(1 + sum of weights), and the sum over the square root of the words.

        At each word start only the heaviest entry counts."""
        words = fold(text).split()
        if not words or not self.weights and not self.exceptions:
            return 0.0, 0.0, 0.0
        line = f" {' '.join(words)} "
        at: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight, exempt) in self.automaton().iter(line):
            start = end - size + 1
            if exempt:
                free.append((start, end))
            elif weight > at.get(start, 0.0):
                at[start] = weight
        if free:
            at = {s: w for s, w in at.items() if not any(a <= s < b for a, b in free)}
        total = sum(at.values())
        return max(at.values(), default=0.0), math.log1p(total), total / math.sqrt(len(words))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights (the intercept first) of a ridge logistic regression by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entry_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each entry by kind (fold * 2 + label), summed over parts of the partition that have few entries enough."""
    counts = [Counter() for _ in range(4)]

    def emptied() -> Iterator[pa.RecordBatch]:
        every = sorted(set().union(*counts))
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[e] for e in every], pa.int64()) for c in counts)], ["entry", "k0", "k1", "k2", "k3"])
        for c in counts:
            c.clear()

    for batch in stream:
        for text, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            counts[kind].update(entries(set(fold(text).split())))
            if sum(map(len, counts)) > 200_000:
                yield from emptied()
    yield from emptied()


def _feature_batches(lexicon, keep: list[str]):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = np.array([lexicon.value.features(t.as_py()) for t in batch.column("text")], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(lexicon.value.scores(x)), *(pa.array(x[:, k]) for k in range(3))], [*keep, "score", "f0", "f1", "f2"])

    return batches


def _other_half(halves):
    """Features of each labelled row by the lexicon of the half that it isn't in."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            kinds = batch.column("kind").to_pylist()
            x = np.array([halves.value[1 - k // 2].features(t) for t, k in zip(batch.column("text").to_pylist(), kinds, strict=True)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), *(pa.array(x[:, k]) for k in range(3))], ["kind", "f0", "f1", "f2"])

    return batches


def phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Each word that an entry matches, with the word before it and with the word after it."""
    words = fold(text).split()
    starts, at = {}, 0
    for k, w in enumerate(words):
        starts[at] = k
        at += len(w) + 1
    hit = {starts[end - size + 1] for end, (size, _, exempt) in lexicon.automaton().iter(f" {' '.join(words)} ") if not exempt} if words and lexicon.weights else set()
    return {" ".join(words[k + d : k + d + 2]) for k in hit for d in (-1, 0) if k + d >= 0 and k + d + 2 <= len(words)}


def _phrase_batches(lexicon):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [(p, k % 2) for t, k in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True) for p in phrases(t, lexicon.value)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], ["phrase", "toxic"])

    return batches


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4096, least: int = 4, odds: float = 3.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn entries, weights, exception phrases and the curve from the labelled rows that ``in_train`` allows.

    ``sample`` bounds the labelled rows of each kind that are used (those with the smallest hash of the id), and with them all that is
    learned. An entry is found in ``least`` toxic documents or more and has log-odds of ``odds`` or more; an exception phrase is
    found in two clean documents or more and in no toxic one. ``exceptions`` are added to the learned ones.
    A document labelled twice counts as toxic if any label says so.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").dropna().filter(in_train()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = lambda y: ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    chosen = one(0).unionAll(one(1)).select("doc_id", (half * 2 + F.col("toxic").cast("int")).alias("kind"))
    smallest = F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256), "text", "kind")).alias("least")
    rows = stored(text_rows(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(smallest).select("least.text", "least.kind"), "labelled")
    n = dict(rows.groupBy("kind").count().collect())
    if not all(n.get(k) for k in range(4)):
        return Lexicon({}, exceptions)
    counted = rows.coalesce(32).mapInArrow(_entry_counts, "entry string, k0 long, k1 long, k2 long, k3 long").groupBy("entry").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in range(4)))

    def weight(toxic: tuple[int, ...], clean: tuple[int, ...]) -> Column:
        """The log-odds of an entry, null where it isn't one."""
        of = lambda kinds: (sum(F.col(f"k{k}") for k in kinds), sum(n[k] for k in kinds))
        (a, all_a), (b, all_b) = of(toxic), of(clean)
        w = F.log((a + 0.5) / (all_a + 1)) - F.log((b + 0.5) / (all_b + 1))
        return F.when((a >= least) & (w >= odds), F.round(w, 6))

    columns = [weight((1, 3), (0, 2)).alias("w"), weight((1,), (0,)).alias("w0"), weight((3,), (2,)).alias("w1")]
    picked = counted.select("entry", *columns).filter("w IS NOT NULL OR w0 IS NOT NULL OR w1 IS NOT NULL").collect()  # bounded by the sample
    every, *halves = (Lexicon({r["entry"]: r[c] for r in picked if r[c] is not None}) for c in ("w", "w0", "w1"))
    spoken = rows.mapInArrow(_phrase_batches(spark.sparkContext.broadcast(every)), "phrase string, toxic int").groupBy("phrase")
    free = spoken.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).filter("toxic = 0 AND n >= 2").select("phrase").collect()
    every.exceptions = tuple(sorted({r[0] for r in free} | set(exceptions)))
    got = rows.mapInArrow(_other_half(spark.sparkContext.broadcast(halves)), "kind int, f0 double, f1 double, f2 double").collect()
    x, y = np.array([r[1:] for r in got], float), np.array([r[0] % 2 for r in got], float)
    forget(rows)
    order = np.lexsort([*x.T, y])  # the same sums whatever the order of the rows
    every.curve = logistic(x[order], y[order])
    every._auto = None
    return every


def score(docs: DataFrame, lexicon: Lexicon, reject: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document. One pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)
    got = text_rows(docs, id_col, text_col).mapInArrow(_feature_batches(model, ["doc_id"]), "doc_id long, score double, f0 double, f1 double, f2 double")
    return got.select("doc_id", F.coalesce(~in_train(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def filtered(docs: DataFrame, lexicon: Lexicon, reject: float = 0.7) -> DataFrame:
    """``docs`` without those that score ``reject`` or more; columns stay as they are. One pass."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            x = np.array([model.value.features(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            yield batch.filter(pa.array(model.value.scores(x) < reject))

    return docs.mapInArrow(lean(batches), docs.schema)
