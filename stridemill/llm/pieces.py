"""Encoding by distinct pieces: what a tokenizer's library gives for whole texts, at the cost of its distinct words.

Both byte-level and word-end BPE split a text before any merge, so the ids of a text are those of its pieces one after
another, wherever the cuts fall between two pieces that the tokenizer would have parted anyway. Texts where that
isn't plain go to the library whole. Each worker keeps the ids of pieces that it has seen, up to ``kept`` of them; beyond
that, those stay which the texts at hand have again. A word-end tokenizer's words are parted further, Latin letters in lower
case from the ASCII punctuation after them: a word is then learned once, whatever follows it and however it's capitalised.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

KEPT = 500_000
#: For so many pieces a letter run's ids are kept besides: they serve pieces of the same batch above all.
CORE_SHARE = 5
#: Letters of Latin-1 and ASCII punctuation, whose classes, case and composition no Unicode version changes.
_LETTERS, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", r"[!-/:-@\[-`{-~]*"
_SIMPLE = re.compile(f"({_LETTERS})({_MARKS})")
#: Texts with other white space than single blanks and line ends between other characters.
_ODD_SPACE = re.compile(r"\A\s|\s\Z|\s\s|[^\S \n]")

#: Bytes to the characters that stand for them in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BLANK = chr(_BYTE_CHARS[0x20])


@cache
def tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _strings(pieces: pa.Array) -> list[str]:
    return pieces.to_numpy(zero_copy_only=False).tolist()


def _taken(sizes: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each of the pieces ``own`` has, and all of them one after another."""
    size, first = sizes[own], (np.cumsum(sizes) - sizes)[own]
    return size, ids[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]


class Pieces:
    """Ids of texts. ``blanks``: whether a blank belongs to the word after it (byte-level BPE) or is dropped (word-end BPE)."""

    def __init__(self, path: str, blanks: bool, kept: int = KEPT):
        self.lib, self.blanks, self.kept = tokenizer(path), blanks, kept
        self._line = self.lib.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.cores: dict[str, list[int]] = {}
        self.sizes: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def _merged(self, word: str) -> list[int]:
        """Ids of one letter run, with its blank if it has one, or of punctuation, from the tokenizer's own merges."""
        if word.isascii():
            mapped = _BLANK + word[1:] if word[0] == " " else word
        else:
            mapped = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.lib.model.tokenize(mapped)]

    def _core(self, word: str) -> list[int]:
        got = self.cores.get(word)
        if got is None:
            got = self.cores[word] = self._merged(word)
        return got

    def _learn(self, words: list[str]) -> None:
        """Encode pieces that have no ids yet: Latin letters with ASCII punctuation after them by the merges alone, the others by the library."""
        sizes, ids = [], []
        if len(self.cores) > self.kept // CORE_SHARE:
            self.cores.clear()
        for w in words:
            line = self.blanks and w[:1] == "\n"
            m = _SIMPLE.fullmatch(w, 1 if line else 0)
            if m and not self.blanks:  # parted, so letters alone
                own = self._merged(w)
            elif m:
                core, rest = m.groups()
                own = [*self._line, *self._core(core)] if line else self._core(" " + core)
                if rest:
                    own = own + self._core(rest)
            else:
                own = self.lib.encode(w if line or not self.blanks else " " + w, add_special_tokens=False).ids
            self.index[w] = len(self.index)
            sizes.append(len(own))
            ids += own
        self.sizes.append(np.array(sizes, np.int64))
        self.ids.append(np.array(ids, np.uint32))

    def encode(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of ids of each text and, if wanted, all ids one after another. ``texts`` has no nulls."""
        strings = texts.to_pylist()
        odd = np.fromiter(("<|" in t or (self.blanks and (not t or _ODD_SPACE.search(t) is not None)) for t in strings), bool, len(strings))
        n = np.zeros(len(strings), np.int64)
        plain = np.flatnonzero(~odd)
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(strings) if want_ids else []
        for k in np.flatnonzero(odd):
            got = self.lib.encode(strings[k], add_special_tokens=False).ids
            n[k] = len(got)
            if want_ids:
                parts[k] = np.array(got, np.uint32)
        del strings
        if len(plain):
            own = texts if len(plain) == len(texts) else texts.take(pa.array(plain))
            sizes, ids, starts = self._plain(own, want_ids)
            n[plain] = sizes
            if want_ids:
                for k, a, b in zip(plain, starts, starts + sizes, strict=True):
                    parts[k] = ids[a:b]
        return n, np.concatenate(parts) if want_ids and parts else (np.empty(0, np.uint32) if want_ids else None)

    def _keep(self, words: list[str]) -> None:
        """Forget all pieces but these."""
        own = np.fromiter((self.index[w] for w in words), np.int64, len(words))
        sizes, ids = _taken(self.sizes[0], self.ids[0], own)
        self.index, self.sizes, self.ids = {w: k for k, w in enumerate(words)}, [sizes], [ids]

    def _rows(self, distinct: list[str]) -> np.ndarray:
        """Where ``sizes`` has each of these pieces; what isn't known is learned."""
        new = [w for w in distinct if w not in self.index]
        if self.index and len(self.index) + len(new) > self.kept:
            self._keep([w for w in distinct if w in self.index])
        self._learn(new)
        if len(self.sizes) > 1:
            self.sizes, self.ids = [np.concatenate(self.sizes)], [np.concatenate(self.ids)]
        return np.fromiter((self.index[w] for w in distinct), np.int64, len(distinct))

    def _parted(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them, from those of its letters and its punctuation; words of another kind aren't parted."""
        got = pc.extract_regex(words, f"^(?P<letters>{_LETTERS})(?P<marks>{_MARKS})$")
        simple = got.is_valid()
        letters = pc.if_else(simple, pc.utf8_lower(got.field("letters")), words)
        parts = pa.concat_arrays([letters, pc.if_else(simple, got.field("marks"), "")]).dictionary_encode()
        rows = self._rows(_strings(parts.dictionary))[np.asarray(parts.indices)].reshape(2, -1)
        sizes, ids = _taken(self.sizes[0], self.ids[0], rows.T.ravel())
        return sizes.reshape(-1, 2).sum(axis=1), ids

    def _plain(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.blanks:  # a piece is a word with the blank or line end before it; the first gets a line end that's taken off again
            split = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(split.offsets)
        words = split.flatten().dictionary_encode()
        own = np.asarray(words.indices)
        if self.blanks:
            own = self._rows(_strings(words.dictionary))[own]
            all_sizes, all_ids = self.sizes[0], self.ids[0]
        else:
            all_sizes, all_ids = self._parted(words.dictionary)
        size = all_sizes[own]
        ends = np.concatenate([[0], np.cumsum(size)])
        starts, stops = ends[bounds[:-1] - bounds[0]], ends[bounds[1:] - bounds[0]]
        drop = int(self.blanks)
        if not want_ids:
            return stops - starts - drop, np.empty(0, np.uint32), starts + drop
        first = np.concatenate([[0], np.cumsum(all_sizes)])[:-1]
        at = np.arange(ends[-1]) + np.repeat(first[own] - ends[:-1], size)
        return stops - starts - drop, all_ids[at], starts + drop
