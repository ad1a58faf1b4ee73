"""Cross-tokenizer alignment by an event sweep.

Two tokenizers A and B cut the same bytes (a blank, then the text). Where a token of both ends at one byte a group ends. Tokens
of a group are linked, each of A with each of B.

1. Each side becomes end events: rows of a document, a side, the byte where a block of at most ``BLOCK`` tokens starts, and the block's
   ids; ends follow from the ids' byte lengths. Encoding goes by distinct words, as neither tokenizer merges over a blank
   between two other characters; texts where that isn't plain go to the library whole.
2. The union of both sides is dealt out by document and sorted by offset within partitions. A machine streams over it: its state is the
   open group's tokens, counters and a running digest, whatever the document's length. It emits a document's counters, its digest
   and its distinct id pairs with their numbers of links.
3. Pair counts: partial sums for each partition, then one row for each pair. The highest count of an A id is a table as
   long as A's vocabulary.
4. Documents look their pairs up: the most frequent ones (at most ``FREQUENT``) in a broadcast table, the others by a join. A
   pair beyond the broadcast has at most twice a FREQUENT-th of all rows, so no key of that join is hot.

Defined results: null and empty texts, and texts whose joined token bytes differ from blank and text on either side, have no tokens:
zeros and an empty digest string. Texts are read whole, whatever their length. Rows are told apart by id and text; rows that share both, or share a text and have no id, are as many
documents for the counts and get equal rows. Null ids stay null. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices, stored, text_rows
from .pieces import Pieces

#: Tokens of a block of events at most.
BLOCK = 4096
#: Pairs that are looked up in a broadcast table at most.
FREQUENT = 1 << 20
#: Distinct words that a worker keeps the ids of.
KEPT = 400_000
#: Links that are written out at once, bytes of text that are encoded at once, and bytes of blocks that are swept at once.
LINKS, TEXTS, BLOCKS = 1_000_000, 4_000_000, 400_000

_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHAR_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class ByteLevel:
    """A: byte-level BPE of a blank and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        self.pieces = Pieces(path, blanks=True)
        self.pieces.lib = self.lib
        special = {k: t.content for k, t in self.lib.get_added_tokens_decoder().items()}
        entry = lambda k: special[k].encode() if k in special else bytes(_CHAR_BYTES[c] for c in self.lib.id_to_token(k))
        self.bytes = [entry(k) for k in range(self.lib.get_vocab_size())]

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(" " + text, add_special_tokens=False).ids

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has with the blank or the line end before it, and all ids."""
        own = self.pieces
        own.index, own.sizes, own.ids = {}, [], []  # letter runs stay
        own._learn(words)
        return own.sizes[0], own.ids[0]


class Sentence:
    """B: a sentencepiece model, which adds the blank itself."""

    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.blank = self.lib.piece_to_id("▁")

        def entry(k: int) -> bytes:
            piece = self.lib.id_to_piece(k)
            return bytes([int(piece[1:-1], 16)]) if self.lib.is_byte(k) else piece.replace("▁", " ").encode()

        self.bytes = [entry(k) for k in range(self.lib.vocab_size())]

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``ByteLevel.words``. No piece has a line end, so what follows one is as after the added blank, which goes."""
        got = self.lib.encode(words, num_threads=1)
        got = [g[1:] if w[:1] == "\n" and g[0] == self.blank else g for w, g in zip(words, got, strict=True)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return count, np.fromiter(chain.from_iterable(got), np.int64, int(count.sum()))


class Side:
    """Ids of whole texts by way of their distinct words, and the bytes of each id."""

    def __init__(self, kind: type, path: str):
        self.lib = kind(path)
        self.kind = np.dtype("<u2" if len(self.lib.bytes) <= 1 << 16 else "<u4")
        self.table = pa.array(self.lib.bytes, pa.binary())
        self.size = np.array([len(b) for b in self.lib.bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, self.kind)
        self.first, self.count, self.odd = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        count, ids = self.lib.words(words)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids.astype(self.kind)])
        # a blank or line end next to white space or to an end of the text may belong to a longer piece
        bare = pc.utf8_slice_codeunits(pa.array(words), 0, 1)
        rest = pc.if_else(pc.equal(bare, "\n"), pc.utf8_slice_codeunits(pa.array(words), 1), pa.array(words))
        odd = pc.or_(pc.equal(rest, ""), pc.not_equal(pc.utf8_trim_whitespace(rest), rest))
        self.odd = np.concatenate([self.odd, np.asarray(odd)])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids one after another. ``texts`` has no nulls; empty ones have no ids."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if self.index and len(self.index) + len(new) > KEPT:
            self.forget()
            new = distinct
        self._learn(new)
        own = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[np.asarray(words.indices)]
        odd = np.logical_or.reduceat(self.odd[own], bounds[:-1]) | np.asarray(pc.starts_with(texts, "\n")) if len(texts) else np.empty(0, bool)
        count = self.count[own]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.first[own] - ends[:-1], count)]
        at, n = ends[bounds], ends[bounds[1:]] - ends[bounds[:-1]]
        if not odd.any():
            return n, ids
        parts = []
        for k, strange in enumerate(odd.tolist()):
            if strange:
                text = texts[k].as_py()
                part = np.array(self.lib.whole(text) if text else [], self.kind)
                n[k] = len(part)
            else:
                part = ids[at[k] : at[k + 1]]
            parts.append(part)
        return n, np.concatenate(parts)


@cache
def _side(kind: type, path: str) -> Side:
    return Side(kind, path)


_EVENTS = "k1 long, k2 long, doc_id long, copies long, side int, start long, ids binary"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values start and end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def end_events(docs: DataFrame, side: int, kind: type, path: str) -> DataFrame:
    """The blocks of one side's events. A document without tokens has one row that starts at -1."""

    def events(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, zip_ = _side(kind, path), zstandard.ZstdCompressor(1)
        for batch in slices(stream, most=TEXTS):
            texts = batch.column("text")
            n, ids = own.encode(texts)
            joined, at = _flat(own.table.take(pa.array(ids)))
            plain, bounds = _flat(texts)
            first = np.concatenate([[0], np.cumsum(n)])
            rows, starts, blocks = [], [], []
            for k in range(len(batch)):
                a, b = int(first[k]), int(first[k + 1])
                text, made = plain[bounds[k] : bounds[k + 1]], joined[at[a] : at[b]]
                if not len(text) or len(made) != len(text) + 1 or made[0] != 32 or not np.array_equal(made[1:], text):
                    rows.append(k), starts.append(-1), blocks.append(b"")
                    continue
                for c in range(a, b, BLOCK):
                    rows.append(k), starts.append(int(at[c] - at[a])), blocks.append(zip_.compress(ids[c : min(c + BLOCK, b)].tobytes()))
            take = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(take) for c in ("k1", "k2", "doc_id", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), side, np.int32)), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], ["k1", "k2", "doc_id", "copies", "side", "start", "ids"])

    return docs.mapInArrow(events, _EVENTS)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (count[k] numbers) for each k, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their weights."""
    if not len(keys):
        return keys, weight
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weight, first)


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray, n_ids: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, links) of distinct keys (owner, A id, B id), as one number, of groups with n_a and n_b tokens one after another in a and b."""
    pairs = n_ids[0] * n_ids[1]
    first_a, first_b, size = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    keys, weights = [], []
    large = size > LINKS
    for g in np.flatnonzero(large):  # by distinct ids, one of A at a time
        x, cx = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, cy = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        for i, c in zip(x.tolist(), cx.tolist(), strict=True):
            keys.append(owner[g] * pairs + i * n_ids[1] + y)
            weights.append(c * cy)
    small = np.flatnonzero(~large)
    lot = np.cumsum(size[small]) // LINKS
    for part in np.split(small, np.flatnonzero(np.diff(lot)) + 1) if len(small) else []:
        of_a = _runs(first_a[part], n_a[part])
        of_b = _runs(np.repeat(first_b[part], n_a[part]), np.repeat(n_b[part], n_a[part]))
        times = np.repeat(n_b[part], n_a[part])
        base = np.repeat(owner[part], n_a[part]) * pairs + a[of_a].astype(np.int64) * n_ids[1]
        key, weight = summed(np.repeat(base, times) + b[of_b], np.ones(len(of_b), np.int64))
        keys.append(key)
        weights.append(weight)
    return summed(np.concatenate(keys), np.concatenate(weights)) if keys else (np.empty(0, np.int64),) * 2


class _Open:
    """What is known of the document that the stream is in: counters, digest, pairs so far, and the open group's tokens."""

    def __init__(self, row: tuple):
        self.row, self.bad, self.counts, self.sha, self.pairs = row, False, np.zeros(4, np.int64), None, []
        self.ids, self.ends = [np.empty(0, np.int64)] * 2, [np.empty(0, np.int64)] * 2

    def add(self, counts: np.ndarray, text: bytes, pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.counts += counts
        if text:
            self.sha = self.sha or hashlib.sha256()
            self.sha.update(text if self.counts[2] > counts[2] else text[1:])  # no separator before the first group
        if len(pairs[0]):
            both = [*self.pairs, pairs]
            self.pairs = [pairs] if len(both) == 1 else [summed(*(np.concatenate(x) for x in zip(*both, strict=True)))]

    def result(self) -> tuple:
        if self.bad or self.sha is None:
            return (*self.row, 0, 0, 0, 0, "", b"")
        keys, weight = self.pairs[0]
        planes = np.concatenate([np.diff(keys, prepend=0), weight]).astype("<u8").view(np.uint8).reshape(-1, 8).T
        return (*self.row, *self.counts.tolist(), self.sha.hexdigest(), zstandard.ZstdCompressor(1).compress(planes.tobytes()))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pair, links) of one document."""
    if not blob:
        return (np.empty(0, np.int64),) * 2
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_ALIGNED_NAMES = ["k1", "k2", "doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
_ALIGNED = "k1 long, k2 long, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
#: Offsets fit below; documents of a batch count in this unit.
_DOC = 1 << 40


def _sweep(sides: tuple[tuple[type, str], tuple[type, str]]):
    """The machine: from rows sorted by (document, offset) to one row a document."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [_side(*s) for s in sides]
        n_ids = (len(both[0].size), len(both[1].size))
        pool = pa.array([mark + str(k) for marks, n in zip((";,", "|,"), n_ids, strict=True) for mark in marks for k in range(n)], pa.binary())
        unzip = zstandard.ZstdDecompressor()
        now: _Open | None = None
        done: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [pa.int64()] * 8 + [pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _ALIGNED_NAMES)

        for batch in slices(stream, "ids", BLOCKS):
            k1, k2, side, start = (np.asarray(batch.column(c)) for c in ("k1", "k2", "side", "start"))
            doc_id, copies = batch.column("doc_id"), batch.column("copies")
            goes_on = now is not None and now.row[:2] == (k1[0], k2[0])
            if now is not None and not goes_on:
                done.append(now.result())
                now = None
            new = np.append(not goes_on, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
            number = np.cumsum(new) - (0 if goes_on else 1)
            first_row = np.flatnonzero(new)
            opened = [_Open((int(k1[r]), int(k2[r]), doc_id[int(r)].as_py(), copies[int(r)].as_py())) for r in first_row]
            docs = [now, *opened] if goes_on else opened
            for r in np.flatnonzero(start < 0):
                docs[number[r]].bad = True
            bad = np.array([d.bad for d in docs])
            raw, tokens, keys = batch.column("ids"), [], []
            for s in (0, 1):
                rows = np.flatnonzero((side == s) & ~bad[number])
                parts = [np.frombuffer(unzip.decompress(raw[int(r)].as_py()), both[s].kind) for r in rows]
                count = np.fromiter(map(len, parts), np.int64, len(parts))
                ids = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
                size = both[s].size[ids]
                total = np.cumsum(size)
                before = np.repeat((total - size)[np.cumsum(count) - count] if len(count) else np.empty(0, np.int64), count)
                key = total - before + np.repeat(start[rows] + number[rows] * _DOC, count)
                if goes_on and not bad[0]:
                    ids, key = np.concatenate([now.ids[s], ids]), np.concatenate([now.ends[s], key])
                tokens.append(ids)
                keys.append(key)
            common = np.intersect1d(*keys, assume_unique=True)
            of_doc = common // _DOC
            group = [np.searchsorted(common, k) for k in keys]
            grouped = [tokens[s][group[s] < len(common)] for s in (0, 1)]
            n = [np.bincount(group[s][group[s] < len(common)], minlength=len(common)) for s in (0, 1)]
            last = docs[-1]
            last.ids = [tokens[s][group[s] == len(common)] for s in (0, 1)]
            last.ends = [keys[s][group[s] == len(common)] % _DOC for s in (0, 1)]
            if len(common):
                cum = [np.cumsum(x) - x for x in n]
                place = np.empty(len(grouped[0]) + len(grouped[1]), np.int64)
                for s in (0, 1):
                    g = np.repeat(np.arange(len(common)), n[s])
                    at = np.arange(len(g))
                    lead = at == cum[s][g]
                    base = 2 * n_ids[0] if s else 0
                    order = at + (cum[0] + n[0])[g] if s else at + cum[1][g]
                    place[order] = grouped[s] + base + np.where(lead, 0, n_ids[s])
                text, offsets = _flat(pool.take(pa.array(place)))
                bounds = np.searchsorted(of_doc, np.arange(len(docs) + 1))  # groups of each document
                upto = np.append(cum[0] + cum[1], len(place))
                pair, weight = links(*grouped, *n, of_doc, n_ids)
                split = np.searchsorted(pair, np.arange(len(docs) + 1) * (n_ids[0] * n_ids[1]))
                totals = [np.append(0, np.cumsum(x)) for x in (n[0], n[1], np.ones(len(common), np.int64), n[0] * n[1])]
                for k, d in enumerate(docs):
                    a, b = bounds[k], bounds[k + 1]
                    if a < b:
                        own = slice(split[k], split[k + 1])
                        counts = np.array([t[b] - t[a] for t in totals])
                        d.add(counts, text[offsets[upto[a]] : offsets[upto[b]]].tobytes(), (pair[own] - k * n_ids[0] * n_ids[1], weight[own]))
            done.extend(d.result() for d in docs[:-1])
            now = last
            if len(done) >= 2000:
                yield emit()
        if now is not None:
            done.append(now.result())
        if done:
            yield emit()

    return batches


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, copies, text): rows that share id and text are one, with their number. Only where there are such rows are texts shuffled."""
    rows = text_rows(docs, id_col, text_col)
    name = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")]
    rows = rows.select(F.xxhash64(*name).alias("k1"), F.xxhash64(F.lit("second"), *name).alias("k2"), "doc_id", "text")
    if rows.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
        return rows.select("k1", "k2", "doc_id", F.lit(1).cast("long").alias("copies"), "text")
    return stored(rows.groupBy("k1", "k2", "doc_id", "text").agg(F.count("*").alias("copies")).select("k1", "k2", "doc_id", "copies", "text"), "identified")


def aligned(docs: DataFrame, a: tuple[type, str], b: tuple[type, str]) -> DataFrame:
    """One row for each row of ``identified``: counters, the digest of its groups, its pairs and their links."""
    events = end_events(docs, 0, *a).unionAll(end_events(docs, 1, *b))
    ordered = events.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start", "side")
    return ordered.mapInArrow(_sweep((a, b)), _ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs): how many documents hold each pair."""

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held = [], [], 0
        out = lambda k, w: pa.RecordBatch.from_arrays([pa.array(k), pa.array(w)], ["pair", "docs"])
        for batch in stream:
            for blob, copies in zip(batch.column("pairs").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                key = unpacked(blob)[0]
                keys.append(key)
                weights.append(np.full(len(key), copies))
                held += len(key)
                if held > LINKS:
                    key, weight = summed(np.concatenate(keys), np.concatenate(weights))
                    if len(key) > LINKS // 2:
                        yield out(key, weight)
                        keys, weights, held = [], [], 0
                    else:
                        keys, weights, held = [key], [weight], len(key)
        if held:
            yield out(*summed(np.concatenate(keys), np.concatenate(weights)))

    return found.select("pairs", "copies").mapInArrow(partial, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs, ``most`` at most, with their counts; ascending by pair."""
    level = F.floor(F.log2("docs")).cast("int")
    cut, total = 64, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        cut = row["level"]
    table = counts.filter(level >= cut).toArrow()
    pair, docs = (np.asarray(table.column(c)).astype(np.int64) for c in ("pair", "docs"))
    order = np.argsort(pair)
    return pair[order], docs[order]


_LOOKED = "k1 long, k2 long, copies long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, links long, n_best long, count_sum long"


def align(docs: DataFrame, a: tuple[type, str], b: tuple[type, str], id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    found = stored(aligned(identified(docs, id_col, text_col), a, b), "aligned")
    n_b = len(_side(*b).size)
    counts = stored(pair_counts(found), "pair-counts")
    highest = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("docs").alias("highest"))
    top = np.zeros(len(_side(*a).size), np.int64)
    for row in highest.toLocalIterator():
        top[row["a"]] = row["highest"]
    context = docs.sparkSession.sparkContext
    known, best = context.broadcast(_frequent(counts, frequent)), context.broadcast(top)

    def look(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs_of = known.value
        names = ["k1", "k2", "copies", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for batch in stream:
            sums, rest = [], []
            for k, blob in enumerate(batch.column("pairs").to_pylist()):
                pair, weight = unpacked(blob)
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                docs = docs_of[at[hit]]
                sums.append((int(weight[hit][docs == best.value[pair[hit] // n_b]].sum()), int((weight[hit] * docs).sum())))
                if not hit.all():
                    rest.append((np.full((~hit).sum(), k), pair[~hit], weight[~hit]))
            of, pair, weight = (np.concatenate(x) for x in zip(*rest, strict=True)) if rest else [np.empty(0, np.int64)] * 3
            none, zero = pa.nulls(len(batch), pa.int64()), pa.array(np.zeros(len(of), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), none, none, *(pa.array(c, pa.int64()) for c in zip(*sums, strict=True))], [*names, "pair", "links", "n_best", "count_sum"])
            if len(of):
                own = [batch.column(c).take(pa.array(of)) for c in names[:3]] + [pa.nulls(len(of), batch.column(c).type) for c in names[3:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pair), pa.array(weight), zero, zero], [*names, "pair", "links", "n_best", "count_sum"])

    looked = stored(found.mapInArrow(look, _LOOKED), "looked-up")
    rare = looked.filter("pair IS NOT NULL").drop("n_best", "count_sum").join(counts, "pair").withColumn("a", F.expr(f"pair div {n_b}"))
    rare = rare.join(F.broadcast(highest), "a").withColumns({"n_best": F.when(F.col("docs") == F.col("highest"), F.col("links")).otherwise(0), "count_sum": F.col("links") * F.col("docs")})
    every = looked.filter("pair IS NULL").unionByName(rare.select(*looked.columns))
    same = ["doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = every.groupBy("k1", "k2").agg(*(F.max(c).alias(c) for c in same), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
