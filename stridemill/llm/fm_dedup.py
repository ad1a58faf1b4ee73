"""Removal of repeated passages of words with compressed FM-indexes.

A word goes if ``window`` consecutive words that cover it also start in a document with a smaller id.

1. Each window is assigned the smallest hash of its ``GRAM``-word strings (its key), so equal windows agree wherever they stand. Consecutive
   windows with the key at one place are a run. Runs of equal words under one key are settled where they meet: all but those
   of the smallest id go. Each batch first settles its own, so a passage that very many documents share is sent once a batch. Of equal runs in
   one text the first stands for all; at the end, windows of a text that are equal share their fate.
2. Of keys under which several different runs are left, each distinct run is a passage. Passages are dealt into shards by key, so that
   windows that may be equal are in one shard. A shard has about ``SHARD`` words at most, whatever the data; there are as many as that
   takes, and one for each shuffle partition at least.
3. A shard's passages become one FM-index: suffixes sorted by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix whose
   bit vectors keep only the words of 64 bits that are neither all zeros nor all ones. The shard's documents are streamed through it,
   all passages in step: a backward search word by word gives the matching statistics up to the threshold. At ``window`` words the
   range widens to all suffixes that begin with these words (the parent interval at that depth), whose smallest id is known. A passage is in
   the index itself, so a search never fails; an interval above the threshold goes where a smaller id has it.
4. A key with more than ``MOST`` words of passages, or half of a partition's even share, would make one shard large. Its windows are
   spread by digests of their own and settled by these, so that no task grows with such a group.

Equal words are told by 64-bit hashes, equal runs and windows by 128-bit digests of these; the index compares hash by hash.

Defined results: null and empty texts have no words; texts of any length are read whole; matches never cross texts. Rows with a null id
are returned whole and remove nothing. Rows are told apart by id and text: rows that share an id remove nothing from each other, each loses
what smaller ids have. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stored, text_rows
from .suffix_dedup import merged, mixed

GRAM = 16
SHARD = 1_000_000
#: Words under one key: at most so many in a shard; so few are never too many.
MOST, FEW = 400_000, 10_000
#: Window starts handled at once; positions then fit into 20 bits.
CHUNK = 1_000_000
#: Bytes of texts that are handled at once; rows of one id that are held back, as it isn't known yet whether others follow.
TEXTS, HELD = 4_000_000, 100_000
#: Words that a worker keeps the hashes of, and bytes that are split into words at once.
KEPT, LONG = 300_000, 16_000_000
_LOW = np.uint64((1 << 20) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so no power of it loses bits


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


_known = _Hashes()


def _forget() -> None:
    _known.clear()


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of each word of a text."""
    if len(_known) > KEPT:
        _known.clear()
    parts, at = [], 0
    while at < len(raw):
        end = at + LONG
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = raw[at:end].split()
        parts.append(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


def runs(words: np.ndarray, bounds: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, key) of the runs of texts words[bounds[k]:bounds[k + 1]]."""
    gram = min(GRAM, window)
    span = window - gram + 1
    for base in range(int(bounds[0]), int(bounds[-1]), CHUNK):
        own = words[base : min(base + CHUNK + window - 1, int(bounds[-1]))]
        if len(own) < window:
            continue
        hashed = np.zeros(len(own) - gram + 1, np.uint64)
        for k in range(gram):
            hashed = hashed * _BASE + own[k : k + len(hashed)]
        hashed = mixed(hashed)
        least = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        n = len(least)
        text = np.searchsorted(bounds, np.arange(base, base + n), "right") - 1
        valid = np.flatnonzero(np.arange(n) + base + window <= bounds[text + 1])
        if not len(valid):
            continue
        place, text = (least[valid] & _LOW).astype(np.int64), text[valid]
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
        yield text[first], valid[first] + base - bounds[text[first]], np.diff(np.append(first, len(valid))), hashed[place[first]]


#: Kinds of rows: intervals that go, marks of keys with several runs, runs, and runs known to be of such keys.
GONE, MARK, RUN, BORDER = range(4)
_RUN_NAMES = ["deal", "kind", "key", "b1", "b2", "doc", "dig", "lo", "n"]
_RUN_SCHEMA = "deal long, kind int, key long, b1 long, b2 long, doc long, dig long, lo long, n long"


def _emit(cols: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(cols[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], names)


def _rows(kind: int, deal, key, b1, b2, doc, dig, lo, n) -> Iterator[pa.RecordBatch]:
    signed = lambda x: np.ascontiguousarray(x).view(np.int64)
    yield from _emit([signed(deal), np.full(len(key), kind, np.int32), signed(key), signed(b1), signed(b2), doc, dig, lo, n], _RUN_NAMES)


def _dealt(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mixed((doc * 1_000_003 + lo).view(np.uint64))


def _gone(doc, dig, owner, lo, n) -> Iterator[pa.RecordBatch]:
    """Merged intervals of windows that go; ``owner`` numbers their documents."""
    of, a, b = merged(owner, lo, lo + n)
    first = np.zeros(int(owner.max()) + 1 if len(owner) else 0, np.int64)
    first[owner] = np.arange(len(owner))
    d, g, zero = doc[first[of]], dig[first[of]], np.zeros(len(of), np.int64)
    yield from _rows(GONE, _dealt(d, a), zero, zero, zero, d, g, a, b - a)


def _digests(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, make = memoryview(np.ascontiguousarray(words)).cast("B"), hashlib.blake2b
    body = b"".join([make(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
    both = np.frombuffer(body, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the row before; true at the first row."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [word_hashes(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _run_batches(window: int):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=TEXTS):
            ids, digs = (np.asarray(batch.column(c)).astype(np.int64) for c in ("doc_id", "dig"))
            words, bounds = _words_of(batch)
            parts = list(runs(words, bounds, window))
            if not parts:
                continue
            text, lo, n, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            b1, b2 = _digests(words, bounds[text] + lo, n - 1 + window)
            order = np.lexsort((lo, text, digs[text], ids[text], b2, b1, key))
            text, lo, n, key, b1, b2 = (x[order] for x in (text, lo, n, key, b1, b2))
            doc, dig = ids[text], digs[text]
            once = _changes(key, b1, b2, doc, dig)  # the first in its text; rows that share id and text are one
            text, lo, n, key, b1, b2, doc, dig = (x[once] for x in (text, lo, n, key, b1, b2, doc, dig))
            first = np.maximum.accumulate(np.where(_changes(key, b1, b2), np.arange(len(key)), 0))
            gone = doc > doc[first]
            yield from _gone(doc[gone], dig[gone], text[gone], lo[gone], n[gone])
            key, b1, b2, doc, dig, lo, n = (x[~gone] for x in (key, b1, b2, doc, dig, lo, n))
            starts = np.flatnonzero(_changes(key))
            size = np.diff(np.append(starts, len(key)))
            several = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), size)
            mark = np.zeros(len(key), bool)
            mark[starts] = True
            mark &= several
            zero = np.zeros(int(mark.sum()), np.int64)
            yield from _rows(MARK, key[mark], key[mark], zero, zero, zero, zero, zero, zero)
            deal = np.where(several, mixed(key ^ b1), key)
            for kind, of in ((RUN, ~several), (BORDER, several)):
                yield from _rows(kind, deal[of], key[of], b1[of], b2[of], doc[of], dig[of], lo[of], n[of])

    return batches


_SETTLED_NAMES = ["kind", "key", "b1", "b2", "doc", "dig", "lo", "n"]
_SETTLED = "kind int, key long, b1 long, b2 long, doc long, dig long, lo long, n long"


def _settle(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, b1, b2, doc, dig): intervals that go, and the runs of keys that have different runs in different documents."""
    last: tuple | None = None  # (key, b1, b2, doc, dig) of the last row
    body_doc, low, high, marked = 0, 0, 0, False  # the body's first id; ids of the last key's runs that stay
    waiting: list[list[np.ndarray]] = []  # the last key's runs, while they are all of one id

    def out(kind: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield from _emit([np.full(len(cols[0]), kind, np.int32), *cols], _SETTLED_NAMES)

    for batch in stream:
        kind = np.asarray(batch.column("kind"))
        cols = [np.asarray(batch.column(c)).astype(np.int64) for c in _SETTLED_NAMES[1:]]
        done = kind == GONE
        if done.any():
            yield from out(GONE, [c[done] for c in cols])
            kind, cols = kind[~done], [c[~done] for c in cols]
        if not len(kind):
            continue
        key, doc, head = cols[0], cols[3], tuple(int(c[0]) for c in cols[:5])
        new_row = _changes(*cols[:5])
        new_row[0] = last != head
        new_row |= kind == MARK
        new_body = _changes(*cols[:3])
        at = np.maximum.accumulate(np.where(new_body, np.arange(len(kind)), 0))
        least = doc[at]
        if last is not None and last[:3] == head[:3] and kind[0] != MARK:
            least[at == 0] = body_doc
        gone = (kind != MARK) & (doc > least) & new_row
        if gone.any():
            yield from out(GONE, [c[gone] for c in cols])
        stay = (kind != MARK) & (doc <= least) & new_row
        group = np.cumsum(_changes(key)) - 1
        starts = np.flatnonzero(_changes(key))
        least_of = np.minimum.reduceat(np.where(stay, doc, np.iinfo(np.int64).max), starts)
        most_of = np.maximum.reduceat(np.where(stay, doc, np.iinfo(np.int64).min), starts)
        known = np.logical_or.reduceat((kind == MARK) | (kind == BORDER), starts)
        goes_on = last is not None and last[0] == key[0]
        if goes_on:
            least_of[0], most_of[0], known[0] = min(low, least_of[0]), max(high, most_of[0]), marked or known[0]
        known |= least_of < most_of
        if not goes_on:
            waiting = []
        elif known[0]:
            for held in waiting:
                yield from out(RUN, held)
            waiting = []
        emit = stay & known[group]
        if emit.any():
            yield from out(RUN, [c[emit] for c in cols])
        if not known[-1]:
            rest = stay & (group == group[-1])
            waiting = [*(waiting if goes_on and group[-1] == 0 else []), [c[rest] for c in cols]]
            if sum(len(w[0]) for w in waiting) > HELD:  # very many rows of one id: let the index see them
                for held in waiting:
                    yield from out(RUN, held)
                waiting, known[-1] = [], True
        elif group[-1] > 0:
            waiting = []
        last, body_doc = tuple(int(c[-1]) for c in cols[:5]), int(least[-1])
        low, high, marked = int(least_of[-1]), int(most_of[-1]), bool(known[-1])


_PASSAGE = "shard long, key long, b1 long, b2 long, doc long, dig long, lo long, n long, words binary"
_PASSAGE_NAMES = ["shard", "key", "b1", "b2", "doc", "dig", "lo", "n", "words"]
_INTERVALS = "doc long, dig long, lo long, hi long"


def _passages(window: int, shards: int):
    """The words of each run in a text's list."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=TEXTS):
            words, bounds = _words_of(batch)
            own = batch.column("runs")
            text = np.repeat(np.arange(len(batch)), np.asarray(own.value_lengths()))
            flat = own.flatten()
            key, b1, b2, lo, n = (np.asarray(flat.field(c)) for c in ("key", "b1", "b2", "lo", "n"))
            raw, start = memoryview(words).cast("B"), bounds[text] + lo
            for k in range(0, len(key), 5000):
                part = slice(k, k + 5000)
                bodies = [bytes(raw[8 * a : 8 * b]) for a, b in zip(start[part].tolist(), (start + n - 1 + window)[part].tolist(), strict=True)]
                ids = [batch.column(c).take(pa.array(text[part])) for c in ("doc_id", "dig")]
                columns = [pa.array(mixed(key[part].view(np.uint64)) % np.uint64(shards)).cast(pa.int64()), *(pa.array(x[part]) for x in (key, b1, b2)), *ids, pa.array(lo[part]), pa.array(n[part]), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, _PASSAGE_NAMES)

    return batches


class Bits:
    """A bit vector with rank. Of its words of 64 bits those that are all zeros or all ones aren't kept."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-len(bits) // 64) + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        mixed_words = (ones > 0) & (ones < 64)
        self.place = np.append(np.cumsum(mixed_words) - mixed_words, mixed_words.sum()).astype(np.int32)
        self.words = np.append(words[mixed_words], np.uint64(0))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before place i."""
        w, r = i >> 6, i & 63
        before = self.before[w]
        all_ones = self.before[w + 1] - before == 64
        part = np.bitwise_count(self.words[np.where(self.place[w + 1] > self.place[w], self.place[w], -1)] & ((np.uint64(1) << r.astype(np.uint64)) - np.uint64(1)))
        return before + np.where(all_ones, r, part)


class Wavelet:
    """Rank of symbols in a sequence, bit by bit from the highest."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for level in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.levels.append((level, Bits(bit.astype(bool)), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.start = np.zeros(symbols, np.int64)
        self.start = self.rank(np.arange(symbols), np.zeros(symbols, np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before place i."""
        at = i
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - self.start[symbol]


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``text``, whose passages end with a 0 at ``ends``; of these ends the earlier is the smaller."""
    rank = text + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    bits = int(rank.max() + 1).bit_length()
    step = max(1, 62 // bits)
    ahead = lambda r, k: np.append(r[k:], np.zeros(min(k, len(r)), np.int64))
    key = rank.copy()
    for k in range(1, step):
        key = (key << bits) | ahead(rank, k)
    while True:
        order = np.argsort(key)
        rank = np.empty_like(key)
        rank[order] = np.cumsum(_changes(key[order])) - 1
        if rank[order[-1]] == len(text) - 1:
            return order
        key = (rank << 32) | ahead(rank, step)
        step *= 2


class FMIndex:
    """Passages of words with the document of each; ``first_of`` streams passages through it."""

    def __init__(self, passages: list[np.ndarray], docs: np.ndarray, window: int):
        self.window = window
        size = np.array([len(p) for p in passages])
        self.alphabet, symbols = np.unique(np.concatenate(passages), return_inverse=True)
        ends = np.cumsum(size + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols + 1
        order = suffix_array(text, ends)
        self.length = len(text)
        self.counts = np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))
        self.counts = np.append(0, self.counts[:-1])  # symbols smaller than each
        self.wavelet = Wavelet(text[order - 1], len(self.alphabet) + 1)
        # Suffixes that begin with the same ``window`` words are one block.
        x, y = order[1:], order[:-1]
        live = np.arange(len(x))
        for k in range(window):
            a, b = x[live] + k, y[live] + k
            inside_text = (a < len(text)) & (b < len(text))
            live, a, b = live[inside_text], a[inside_text], b[inside_text]
            live = live[(text[a] == text[b]) & (text[a] > 0)]
        first = np.ones(len(text), bool)
        first[live + 1] = False
        self.block = np.cumsum(first) - 1
        self.block_start = np.flatnonzero(first)
        self.block_end = np.append(self.block_start[1:], len(text))
        owner = np.searchsorted(ends, order)
        self.least = np.minimum.reduceat(docs[owner], self.block_start)

    def first_of(self, passages: list[np.ndarray]) -> np.ndarray:
        """The smallest document that has each window of each passage, one passage after another. All words must be in the index."""
        size = np.array([len(p) for p in passages])
        text = np.searchsorted(self.alphabet, np.concatenate(passages)) + 1
        by = np.argsort(-size, kind="stable")
        windows = size - self.window + 1
        end, out_end = np.cumsum(size)[by], np.cumsum(windows)[by]
        out = np.full(int(windows.sum()), np.iinfo(np.int64).max)
        longest = size[by]
        low, high = np.zeros(len(by), np.int64), np.full(len(by), self.length)
        for step in range(int(size.max())):
            n = int(np.searchsorted(-longest, -step, "left"))  # passages longer than step
            symbol = text[end[:n] - 1 - step]
            low, high = (self.counts[symbol] + self.wavelet.rank(symbol, x[:n]) for x in (low, high))
            if step + 1 >= self.window:  # the range of just ``window`` words
                block = self.block[low]
                low, high = self.block_start[block], self.block_end[block]
                out[out_end[:n] - 1 - (step + 1 - self.window)] = self.least[block]
        return out


def _search(window: int):
    """A shard's intervals of windows that go."""

    def shard(table: pa.Table) -> pa.Table:
        key, b1, b2, doc, dig, lo, n = (np.asarray(table.column(c)) for c in ("key", "b1", "b2", "doc", "dig", "lo", "n"))
        words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        body = np.arange(len(words))
        order = np.lexsort((doc[body], b2[body], b1[body], key[body]))
        body = body[order]
        body = body[_changes(key[body], b1[body], b2[body])]  # the smallest document of each distinct passage
        passages = [words[k] for k in body]
        number = {k: i for i, k in enumerate(zip(key[body].tolist(), b1[body].tolist(), b2[body].tolist(), strict=True))}
        of = np.array([number[k] for k in zip(key.tolist(), b1.tolist(), b2.tolist(), strict=True)])
        first = FMIndex(passages, doc[body], window).first_of(passages)
        ends = np.cumsum(n[body])
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = first[(ends - n[body])[of][row] + within] < doc[row]
        owner, a, b = merged(row[gone], lo[row[gone]] + within[gone], lo[row[gone]] + within[gone] + 1)
        return pa.table({"doc": doc[owner], "dig": dig[owner], "lo": a, "hi": b})

    return shard


_SINGLE = "b1 long, b2 long, doc long, dig long, lo long, n long"
_SINGLE_NAMES = ["b1", "b2", "doc", "dig", "lo", "n"]


def _single_windows(window: int, most: int = 50_000):
    """The windows of crowded keys' runs by digest: of a lot's equal ones those of the smallest id; intervals of the others have ``n`` > 0."""

    def solved(words: np.ndarray, start, doc, dig, lo) -> Iterator[pa.RecordBatch]:
        b1, b2 = _digests(words, start, np.full(len(start), window))
        order = np.lexsort((lo, dig, doc, b2, b1))
        b1, b2, doc, dig, lo = (x[order] for x in (b1, b2, doc, dig, lo))
        once = _changes(b1, b2, doc, dig, lo)
        b1, b2, doc, dig, lo = (x[once] for x in (b1, b2, doc, dig, lo))
        first = np.maximum.accumulate(np.where(_changes(b1, b2), np.arange(len(b1)), 0))
        gone = doc > doc[first]
        owner = np.unique(np.column_stack([doc[gone], dig[gone]]), axis=0, return_inverse=True)[1].ravel()
        of, a, b = merged(owner, lo[gone], lo[gone] + 1)
        at = np.zeros(int(owner.max()) + 1 if len(owner) else 0, np.int64)
        at[owner] = np.flatnonzero(gone)
        zero = np.zeros(len(of), np.int64)
        yield from _emit([_dealt(doc[at[of]], a).view(np.int64), zero, doc[at[of]], dig[at[of]], a, b - a], _SINGLE_NAMES)
        b1, b2, doc, dig, lo = (x[~gone] for x in (b1, b2, doc, dig, lo))
        yield from _emit([b1.view(np.int64), b2.view(np.int64), doc, dig, lo, np.zeros(len(lo), np.int64)], _SINGLE_NAMES)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=TEXTS):
            words, bounds = _words_of(batch)
            own = batch.column("runs")
            text = np.repeat(np.arange(len(batch)), np.asarray(own.value_lengths()))
            flat = own.flatten()
            lo, n = (np.asarray(flat.field(c)) for c in ("lo", "n"))
            row = np.repeat(text, n)
            pos = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, dig = (np.asarray(batch.column(c)) for c in ("doc_id", "dig"))
            for k in range(0, len(row), most):
                part = slice(k, k + most)
                yield from solved(words, bounds[row[part]] + pos[part], doc[row[part]], dig[row[part]], pos[part])

    return batches


def _settle_windows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (b1, b2, doc): the intervals of windows that go."""
    last, least = None, 0
    for batch in stream:
        b1, b2, doc, dig, lo, n = (np.asarray(batch.column(c)) for c in _SINGLE_NAMES)
        yield from _emit([doc[n > 0], dig[n > 0], lo[n > 0], (lo + n)[n > 0]], ["doc", "dig", "lo", "hi"])
        b1, b2, doc, dig, lo = (x[n == 0] for x in (b1, b2, doc, dig, lo))
        if not len(b1):
            continue
        at = np.maximum.accumulate(np.where(_changes(b1, b2), np.arange(len(b1)), 0))
        first = doc[at]
        if last == (b1[0], b2[0]):
            first[at == 0] = least
        gone = doc > first
        last, least = (b1[-1], b2[-1]), int(first[-1])
        yield from _emit([doc[gone], dig[gone], lo[gone], lo[gone] + 1], ["doc", "dig", "lo", "hi"])


def removed_intervals(rows: DataFrame, window: int, shard: int = SHARD, most: int | None = None) -> DataFrame:
    """(doc, dig, lo, hi): windows lo to hi that go, of rows (doc_id, dig, text) without null ids; of equal windows in one text at least one."""
    settled = stored(
        rows.mapInArrow(lean(_run_batches(window), _forget), _RUN_SCHEMA)
        .repartition("deal")
        .sortWithinPartitions("key", "b1", "b2", "doc", "dig")
        .drop("deal")
        .mapInArrow(lean(_settle), _SETTLED),
        "settled",
    )
    gone = settled.filter(F.col("kind") == GONE).select("doc", "dig", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    left = settled.filter(F.col("kind") == RUN)
    keys = left.groupBy("key").agg(F.sum(F.col("n") + window).alias("words"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if most is None:
        most = min(MOST, max(FEW, (left.agg(F.sum(F.col("n") + window)).first()[0] or 0) // (2 * partitions)))
    crowd = stored(keys.filter(F.col("words") > most).select("key", F.lit(True).alias("crowded")), "crowded")
    if crowd.isEmpty():
        plain, crowded = left, None
    else:
        flagged = left.join(crowd, "key", "left")
        plain, crowded = flagged.filter("crowded IS NULL").drop("crowded"), flagged.filter("crowded")
    total = plain.agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(partitions, -(-total // shard))
    lists = lambda df: df.groupBy(F.col("doc").alias("of"), F.col("dig").alias("of_dig")).agg(F.collect_list(F.struct("key", "b1", "b2", "lo", "n")).alias("runs"))
    texts = lambda df: rows.join(lists(df).hint("shuffle_hash"), (F.col("doc_id") == F.col("of")) & (F.col("dig") == F.col("of_dig"))).select("doc_id", "dig", "text", "runs")
    found = [gone]
    if total:
        bodies = texts(plain).mapInArrow(lean(_passages(window, shards), _forget), _PASSAGE)
        found.append(stored(bodies.groupBy("shard").applyInArrow(_search(window), _INTERVALS), "found"))
    if crowded is not None:
        single = texts(crowded).mapInArrow(lean(_single_windows(window), _forget), _SINGLE)
        found.append(stored(single.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "doc").mapInArrow(lean(_settle_windows), _INTERVALS), "windows"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _spread(hashes: np.ndarray, gone: np.ndarray, window: int) -> None:
    """Mark windows that equal one that goes."""
    other, a, b = mixed(hashes), np.zeros(len(gone), np.uint64), np.zeros(len(gone), np.uint64)
    for k in range(window):
        a = a * _BASE + hashes[k : k + len(a)]
        b = b * _BASE + other[k : k + len(b)]
    order = np.lexsort((b, a))
    group = np.cumsum(_changes(a[order], b[order])) - 1
    any_gone = np.zeros(int(group[-1]) + 1, bool)
    any_gone[group[gone[order]]] = True
    gone[order] = any_gone[group]


def _apply(window: int):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=TEXTS):
            spans, out = batch.column("spans").to_pylist(), []
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), spans, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                words = kept = raw.split()
                if own:
                    gone = np.zeros(len(words) - window + 1, bool)
                    for s in own:
                        gone[s["lo"] : s["hi"]] = True
                    if not gone.all():
                        _spread(word_hashes(raw), gone, window)
                    at = np.flatnonzero(gone)
                    _, a, b = merged(np.zeros(len(at), np.int64), at, at + window)
                    kept = [w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[x:y]]
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return batches


def deduplicate(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, most: int | None = None) -> DataFrame:
    """RESULT for every document: what's left once windows of words that smaller ids have are gone."""
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("dig"), "text")
    spans = removed_intervals(rows.filter("doc_id IS NOT NULL"), window, shard, most)
    lists = spans.groupBy(F.col("doc").alias("of"), F.col("dig").alias("of_dig")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = rows.join(lists.hint("shuffle_hash"), (F.col("doc_id") == F.col("of")) & (F.col("dig") == F.col("of_dig")), "left")
    return out.select("doc_id", "text", "spans").mapInArrow(lean(_apply(window), _forget), RESULT)
