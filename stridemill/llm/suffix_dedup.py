"""Exact substring deduplication by a hash-compared suffix sort.

A byte goes if a string of ``width`` bytes that covers it also starts earlier (in a smaller id, or before in the same text).

1. Each window of ``width`` bytes is assigned the smallest hash of its ``GRAM``-byte strings, so equal windows agree wherever they
   stand. Consecutive windows with the same smallest hash are one run. Where a run's bytes repeat with some period, its windows
   beyond the first period go at once; its bytes are compared for that.
2. Runs meet by their smallest hash. Those whose bytes have the same SHA-256 are settled there: all but the earliest go.
   Each batch first settles its own, so a text that very many rows share is sent once a batch. Runs of a
   hash that has several different runs in one batch are known to need step 3; they are dealt out by their bytes and only
   a mark goes to the hash's task, which so gets one row from each batch, however many share that hash.
3. Where one smallest hash has different runs (the borders of common passages) their windows are suffix-sorted: a
   mergesort whose comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours with ``width`` common bytes, verified byte by byte, are one class; all but its earliest go.

A smallest hash whose runs have very many windows would be one large sort; its windows are spread by their own SHA-256
and settled by that, so no task grows with such a group. Polynomial hashes (modulo 2 ** 64) only order and propose;
nothing goes on their word.

Step 1 leaves about one row per 35 bytes of text, step 3 sees only the borders.

Defined results: null and empty texts have no bytes; texts of any length are read whole; matches never cross texts. Rows with a null id are
left out. Rows that share an id and a text each get that document's result; where rows share an id but not the text, the
text with the smallest digest stands for the id and the others are returned whole. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_rows

GRAM = 32
#: Window starts handled at once; positions then fit into 20 bits.
CHUNK = 1_000_000
_LOW = np.uint64((1 << 20) - 1)


class PrefixHash:
    """Polynomial hashes modulo 2 ** 64 of every range of ``data``; bytes stand for random values of ``seed``."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        table, power, self.inverse = _powers(seed, 1 << max(16, int(len(data)).bit_length()))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(table[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


@cache
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = rng.integers(1 << 63, dtype=np.uint64) + rng.integers(1 << 63, size=256, dtype=np.uint64)
    base = int(rng.integers(1 << 62)) * 4 + 3
    power = np.full(n, base, np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return table, np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads hash bits, so that the smallest hash favours no string."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, smallest hash, inner) of the runs in texts data[bounds[k]:bounds[k + 1]].

    ``inner``: the smallest hash stands at several places in the run, so two of its own windows may be equal; then that's
    how far apart the nearest of them are, else 0."""
    span = width - GRAM + 1
    for base in range(int(bounds[0]), int(bounds[-1]), CHUNK):
        own = data[base : min(base + CHUNK + width - 1, int(bounds[-1]))]
        if len(own) < width:
            continue
        grams = mixed(PrefixHash(own).grams(GRAM))
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        n = len(least)
        first, last = np.searchsorted(bounds, [base, base + n - 1], "right") - 1
        ends = bounds[first + 1 : last + 2]
        edges = np.clip(np.concatenate([[base], ends]) - base, 0, n)
        text = np.repeat(np.arange(first, last + 1), np.diff(edges))
        valid = np.flatnonzero(np.arange(n) + base + width <= bounds[text + 1])
        if not len(valid):
            continue
        place = (least[valid] & _LOW).astype(np.int64)
        key = grams[place]
        new = np.append(True, (np.diff(valid) != 1) | (key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(valid)))
        step = np.append(0, np.diff(place))
        step[new | (step == 0)] = np.iinfo(np.int64).max
        nearest = np.minimum.reduceat(step, starts)
        own_text = text[valid[starts]]
        yield own_text, valid[starts] + base - bounds[own_text], count, key[starts], np.where(nearest < np.iinfo(np.int64).max, nearest, 0)


def without_periods(data: np.ndarray, bounds: np.ndarray, cols: tuple[np.ndarray, ...], width: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Runs without those windows that equal the one a period before, and (text number, first byte, end) of the bytes that go with these."""
    text, first, n, key, inner = cols
    keep = np.ones(len(text), bool)
    more: list[tuple[int, int, int, int, int]] = []
    gone: list[tuple[int, int, int]] = []
    for r in np.flatnonzero((inner > 0) & (n > inner)):
        lo, count, period = int(first[r]), int(n[r]), int(inner[r])
        own = data[bounds[text[r]] + lo :][: count - 1 + width]
        differs = np.cumsum(np.append(0, own[period:] != own[:-period]))
        again = np.append(np.zeros(period, bool), differs[width:] == differs[: len(differs) - width])
        if not again.any():
            continue
        keep[r] = False
        cuts = [0, *(np.flatnonzero(np.diff(again)) + 1).tolist(), count]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if again[a]:
                gone.append((int(text[r]), lo + a, lo + b - 1 + width))
            else:
                more.append((int(text[r]), lo + a, b - a, int(key[r]), period if b - a > period else 0))
    if keep.all():
        return cols, (np.empty(0, np.int64),) * 3
    added = zip(*more, strict=True) if more else ((),) * 5
    cols = tuple(np.concatenate([c[keep], np.array(x, c.dtype)]) for c, x in zip(cols, added, strict=True))
    return cols, tuple(np.array(x, np.int64) for x in zip(*gone, strict=True))


def merged(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals per owner; ones that touch are one."""
    if not len(lo):
        return owner, lo, hi
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], hi[order]
    new = np.append(True, owner[1:] != owner[:-1])
    step = np.cumsum(new) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + step) - step
    start = np.flatnonzero(new | np.append(True, lo[1:] > reach[:-1]))
    return owner[start], lo[start], reach[np.append(start[1:], len(lo)) - 1]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values start and end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Column ``kind`` of the rows of step 2: intervals that go (the end in key), marks, runs, and runs known to need step 3.
SETTLED, MARK, RUN, BORDER = range(4)
_RUN_NAMES = ["deal", "key", "kind", "body", "doc", "lo", "n"]
_RUN_SCHEMA = "deal long, key long, kind int, body binary, doc long, lo long, n long"


def _emit(cols: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(cols[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], names)


def _same(words: np.ndarray) -> np.ndarray:
    """Which rows equal the one before."""
    return np.append(False, (words[1:] == words[:-1]).all(axis=1)) if len(words) else np.zeros(0, bool)


def _run_rows(kind: int, deal: np.ndarray, key: np.ndarray, body: list, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _emit([deal.view(np.int64), key.view(np.int64), np.full(len(key), kind, np.int32), body, doc, lo, n], _RUN_NAMES)


def _run_batches(width: int):
    """The earliest of a batch's equal runs, marks of hashes with several, and intervals that are settled already.

    Runs that may repeat within themselves have their windows negated."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=24_000_000):
            ids = np.asarray(batch.column("doc_id")).astype(np.int64)
            data, bounds = _bytes_of(batch.column("text"))
            raw, settled, parts = memoryview(data), [], []
            for cols in runs(data, bounds, width):
                cols, periods = without_periods(data, bounds, cols, width)
                parts.append(cols)
                settled.append(periods)
            if not parts:
                continue
            text, lo, n, key, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
            digest, at = hashlib.sha256, bounds[text] + lo
            body = [digest(raw[a:b]).digest() for a, b in zip(at.tolist(), (at + n - 1 + width).tolist(), strict=True)]
            words = np.frombuffer(b"".join(body), "<u8").reshape(-1, 4)
            order = np.lexsort((lo, ids[text], words[:, 0], key))
            text, lo, n, key, inner, words = (x[order] for x in (text, lo, n, key, inner, words))
            gone = _same(np.column_stack([key, words]))
            settled.append((text[gone], lo[gone], lo[gone] + n[gone] - 1 + width))
            t, a, hi = merged(*(np.concatenate(x) for x in zip(*settled, strict=True)))
            yield from _run_rows(SETTLED, mixed((ids[t] * 1_000_003 + a).view(np.uint64)), hi, [b""] * len(hi), ids[t], a, np.zeros(len(hi), np.int64))
            text, lo, n, key, inner, words = (x[~gone] for x in (text, lo, n, key, inner, words))
            body = [body[k] for k in order[~gone].tolist()]
            other = key[1:] == key[:-1]
            several = np.append(other, False) | np.append(False, other)
            first = several & ~np.append(False, other)
            marks = np.zeros(first.sum(), np.int64)
            yield from _run_rows(MARK, key[first], key[first], [b""] * len(marks), marks, marks, marks)
            n = np.where(inner > 0, -n, n)
            doc = ids[text]
            deal = np.where(several, mixed(key ^ words[:, 0]), key)
            for kind, of in ((RUN, ~several), (BORDER, several)):
                yield from _run_rows(kind, deal[of], key[of], [body[k] for k in np.flatnonzero(of).tolist()], doc[of], lo[of], n[of])

    return batches


_SETTLED_NAMES = ["key", "doc", "lo", "n"]


def _settle(width: int):
    """From rows sorted by (key, body, doc, lo): intervals to remove (n = 0, the end in key), and the runs of keys with several
    bodies and those that may repeat within themselves."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_body = None, np.zeros(4, np.uint64)
        waiting: list[int] | None = None  # the first body of the last key, while it's the only one
        for batch in stream:
            key, kind, doc, lo, n = (np.asarray(batch.column(c)) for c in ("key", "kind", "doc", "lo", "n"))
            done = kind == SETTLED
            if done.any():
                yield from _emit([key[done], doc[done], lo[done], n[done]], _SETTLED_NAMES)
                batch = batch.filter(pa.array(~done))
                key, kind, doc, lo, n = (x[~done] for x in (key, kind, doc, lo, n))
            if not len(key):
                continue
            body = np.zeros((len(key), 4), np.uint64)  # marks have zeros, no digest
            body[kind != MARK] = np.frombuffer(b"".join(batch.column("body").to_pylist()), "<u8").reshape(-1, 4)
            new_key = np.append(key[0] != last_key, key[1:] != key[:-1])
            new = new_key | ~_same(body)
            new[0] = new_key[0] or (body[0] != last_body).any()
            gone = ~new & (kind != MARK)
            yield from _emit([lo[gone] + np.abs(n[gone]) - 1 + width, doc[gone], lo[gone], np.zeros(gone.sum(), np.int64)], _SETTLED_NAMES)
            last_key, last_body = int(key[-1]), body[-1]
            key, kind, doc, lo, n, new_key = (x[new] for x in (key, kind, doc, lo, n, new_key))
            if not len(key):
                continue
            several = ~new_key | (n < 0) | (kind == BORDER)
            several[:-1] |= ~new_key[1:]
            if waiting is not None and not new_key[0]:
                yield from _emit([np.array([x]) for x in waiting], _SETTLED_NAMES)
            out = several & (kind != MARK)
            n = np.abs(n)
            yield from _emit([key[out], doc[out], lo[out], n[out]], _SETTLED_NAMES)
            waiting = [int(x[-1]) for x in (key, doc, lo, n)] if not several[-1] and kind[-1] != MARK else None

    return batches


_CONTEXT_NAMES = ["key", "doc", "lo", "single", "bytes"]
_CONTEXT_SCHEMA = "key long, doc long, lo long, single boolean, bytes binary"


def _single_windows(raws: list[bytes], docs: list[int], los: list[int], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of crowded runs, by SHA-256: of equal ones the earliest, of the others their intervals, as rows without
    bytes whose key is the interval's end."""
    digest = hashlib.sha256
    body = [digest(r[k : k + width]).digest() for r in raws for k in range(len(r) - width + 1)]
    words = np.frombuffer(b"".join(body), "<u8").reshape(-1, 4)
    n = np.array([len(r) - width + 1 for r in raws])
    doc, pos = np.repeat(docs, n), np.repeat(los, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((pos, doc, words[:, 0]))
    doc, pos, words = doc[order], pos[order], words[order]
    gone = _same(words)
    left = [body[k] for k in order[~gone].tolist()]
    yield from _emit([words[~gone, 0].view(np.int64), doc[~gone], pos[~gone], np.ones(len(left), bool), left], _CONTEXT_NAMES)
    d, lo, hi = merged(doc[gone], pos[gone], pos[gone] + width)
    yield from _emit([hi, d, lo, np.ones(len(d), bool), [b""] * len(d)], _CONTEXT_NAMES)


def _contexts(width: int, most: int = 50_000):
    """The bytes of each run in a text's list; crowded runs window by window, in lots of about ``most``."""

    def plain(cols: list[list]) -> Iterator[pa.RecordBatch]:
        yield from _emit([np.array(c, np.int64) for c in cols[:3]] + [np.zeros(len(cols[0]), bool), cols[3]], _CONTEXT_NAMES)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd: tuple[list, list, list] = ([], [], [])
        held = 0
        for batch in stream:
            cols: list[list] = [[], [], [], []]
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in own.as_py():
                    if not r["crowded"]:
                        for c, x in zip(cols, (r["key"], doc, r["lo"], raw[r["lo"] : r["lo"] + r["n"] - 1 + width]), strict=True):
                            c.append(x)
                        continue
                    for lo in range(r["lo"], r["lo"] + r["n"], most):  # a long run in several lots
                        windows = min(most, r["lo"] + r["n"] - lo)
                        for c, x in zip(crowd, (raw[lo : lo + windows - 1 + width], doc, lo), strict=True):
                            c.append(x)
                        held += windows
                        if held > most:
                            yield from _single_windows(*crowd, width)
                            crowd, held = ([], [], []), 0
                if len(cols[0]) > 20_000:
                    yield from plain(cols)
                    cols = [[], [], [], []]
            yield from plain(cols)
        if held:
            yield from _single_windows(*crowd, width)

    return batches


def common_extension(hashed: PrefixHash, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Common bytes, ``width`` at most, of the suffixes at a and at b, by binary search over their prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), width)
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = hashed(a, mid) == hashed(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(data: np.ndarray, hashed: PrefixHash, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """The order of suffixes by (group, first ``width`` bytes): a stable bottom-up mergesort over all groups at once.

    ``group`` is sorted. In a merge, each suffix finds its place in the other run by binary search; a comparison is one
    common extension and one byte.
    """
    order = np.arange(len(start))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    at = np.arange(len(group)) - np.repeat(first, size)  # place within the group
    begin, length = np.repeat(first, size), np.repeat(size, size)
    run = 1
    while run < size.max(initial=0):
        live = np.flatnonzero(length > run)
        block = at[live] // run
        other = begin[live] + (block ^ 1) * run
        low, high = np.zeros(len(live), np.int64), np.clip(begin[live] + length[live] - other, 0, run)
        left = block % 2 == 0
        own = start[order[live]]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) >> 1
            x, y = own[todo], start[order[other[todo] + mid]]
            same = common_extension(hashed, x, y, width)
            tail = np.minimum(same, width - 1)
            bx, by = data[x + tail], data[y + tail]
            before = (by < bx) | ((same == width) & ~left[todo])  # equal ones of the left run come first
            low[todo], high[todo] = np.where(before, mid + 1, low[todo]), np.where(before, high[todo], mid)
        new = order.copy()
        new[begin[live] + (block // 2) * 2 * run + (at[live] - block * run) + low] = order[live]
        order = new
        run *= 2
    return order


def words_at(data: np.ndarray, start: np.ndarray, offset: int) -> np.ndarray:
    """The 8 bytes at start + offset as one number."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return view[start + offset].copy().view("<u8").ravel()


def later_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Which windows have an equal window of lower ``rank`` in their group; ``data`` has 8 bytes more than windows need."""
    a, b = words_at(data, start, 0), words_at(data, start, 8)
    order = np.lexsort((b, a, group))
    differs = np.append(True, (group[order][1:] != group[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    tie = np.cumsum(differs)
    alone = np.append(differs[1:], True) & differs
    order, tie = order[~alone], tie[~alone]
    out = np.zeros(len(start), bool)
    if not len(order):
        return out
    seed = 1
    while True:
        hashed = PrefixHash(data, seed)
        by = order[suffix_sort(data, hashed, start[order], tie, width)]
        x, y = start[by[:-1]], start[by[1:]]
        same = (tie[1:] == tie[:-1]) & (hashed(x, width) == hashed(y, width))
        pairs = np.flatnonzero(same)
        equal = np.ones(len(pairs), bool)
        for k in [*range(0, width - 7, 8), width - 8]:
            equal &= words_at(data, x[pairs], k) == words_at(data, y[pairs], k)
        if equal.all():
            break
        seed += 1  # two different strings had one hash; sort again by another polynomial
    label = np.cumsum(np.append(True, ~same)) - 1
    least = np.full(label[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, rank[by])
    out[by] = rank[by] > least[label]
    return out


def _sort_contexts(width: int, most: int = 1_000_000):
    """Intervals to remove from the contexts of whole keys and from single windows, sorted by (key, bytes, doc, lo)."""

    def solved(keys, docs, los, contexts) -> Iterator[pa.RecordBatch]:
        size = np.array([len(c) for c in contexts])
        data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size - width + 1
        owner = np.repeat(np.arange(len(size)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = los[owner] + within
        rank = np.empty(len(pos), np.int64)
        rank[np.lexsort((pos, docs[owner]))] = np.arange(len(pos))
        group = np.cumsum(np.append(True, keys[1:] != keys[:-1]))[owner]
        gone = later_windows(data, base[owner] + within, group, rank, width)
        d, a, b = merged(docs[owner][gone], pos[gone], pos[gone] + width)
        yield from _emit([d, a, b], ["doc", "lo", "hi"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], [], []]
        held, last = 0, np.zeros(4, np.uint64)
        for batch in stream:
            empty = pc.equal(pc.binary_length(batch.column("bytes")), 0)
            done, single = batch.filter(empty), batch.filter(pc.and_(batch.column("single"), pc.invert(empty)))
            yield pa.RecordBatch.from_arrays([done.column("doc"), done.column("lo"), done.column("key")], ["doc", "lo", "hi"])
            if len(single):  # all but the first of each SHA-256
                words = np.frombuffer(b"".join(single.column("bytes").to_pylist()), "<u8").reshape(-1, 4)
                again = _same(np.concatenate([last[None], words]))[1:]
                last = words[-1]
                doc, lo = (np.asarray(single.column(c))[again] for c in ("doc", "lo"))
                yield from _emit([*merged(doc, lo, lo + width)], ["doc", "lo", "hi"])
            rest = batch.filter(pc.invert(batch.column("single")))
            for row in zip(*(rest.column(c).to_pylist() for c in ("key", "doc", "lo", "bytes")), strict=True):
                if held > most and row[0] != cols[0][-1]:
                    yield from solved(*(np.array(c, np.int64) for c in cols[:3]), cols[3])
                    cols, held = [[], [], [], []], 0
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
                held += len(row[3])
        if cols[0]:
            yield from solved(*(np.array(c, np.int64) for c in cols[:3]), cols[3])

    return batches


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        spans = batch.column("spans")
        rows = np.repeat(np.arange(len(batch)), [0 if s is None else len(s) for s in spans.to_pylist()])
        flat = spans.flatten()
        lo, hi = (np.asarray(flat.field(k)) for k in (0, 1)) if len(flat) else (np.empty(0, np.int64),) * 2
        owner, lo, hi = merged(rows, lo, hi)
        at = np.searchsorted(owner, np.arange(len(batch) + 1))
        out = []
        for k, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            raw = text.encode("utf-8", "surrogatepass")
            a, b = lo[at[k] : at[k + 1]].tolist(), hi[at[k] : at[k + 1]].tolist()
            kept = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True))
            out.append((doc, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_intervals(rows: DataFrame, width: int, most: int = 50_000) -> DataFrame:
    """(doc, lo, hi): intervals of bytes that go, of rows (doc_id, text) with distinct ids.

    A key whose runs have more than ``most`` windows isn't sorted in one task: these spread by digests of their own.
    """
    long = rows.filter(F.octet_length("text") >= width)
    settled = stored(
        long.mapInArrow(_run_batches(width), _RUN_SCHEMA)
        .repartition("deal")
        .sortWithinPartitions("key", "body", "doc", "lo")
        .select("key", "kind", "body", "doc", "lo", "n")
        .mapInArrow(_settle(width), "key long, doc long, lo long, n long"),
        "runs",
    )
    border = settled.filter("n > 0")
    crowded = stored(border.groupBy("key").agg(F.sum("n").alias("windows")).filter(F.col("windows") > most).select("key", F.lit(True).alias("crowded")), "crowded")
    flagged = border.withColumn("crowded", F.lit(False)) if crowded.isEmpty() else border.join(crowded, "key", "left").fillna({"crowded": False})
    lists = flagged.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("key", "lo", "n", "crowded")).alias("runs"))
    texts = long.join(lists.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("doc_id", "text", "runs")
    contexts = texts.mapInArrow(_contexts(width), _CONTEXT_SCHEMA)
    sorted_out = stored(
        contexts.repartition("key").sortWithinPartitions("key", "bytes", "doc", "lo").mapInArrow(_sort_contexts(width), "doc long, lo long, hi long"), "borders"
    )
    return settled.filter("n = 0").select("doc", "lo", F.col("key").alias("hi")).unionAll(sorted_out)


def deduplicate(docs: DataFrame, width: int = 100, most: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT_SCHEMA for every document: what's left of it once later occurrences of ``width``-byte strings have gone."""
    rows = text_rows(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    lists = lambda single: removed_intervals(single, width, most).groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = rows.join(lists(rows).hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left")
    else:
        rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        single = rows.groupBy("doc_id").agg(F.min(F.struct("digest", "text")).alias("least")).select("doc_id", "least.text", F.col("least.digest").alias("of"))
        spans = lists(single).join(single.select(F.col("doc_id").alias("own"), "of"), F.col("id") == F.col("own"))
        out = rows.join(spans, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("of")), "left")
    return out.select("doc_id", "text", "spans").mapInArrow(_apply, RESULT_SCHEMA)
