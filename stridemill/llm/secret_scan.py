"""Secret scan: a keyword automaton first, anchored expressions only at its hits, then embedded checksums.

1. One Aho-Corasick pass over the ASCII-lower-cased text finds the keywords of all rules.
2. At each hit, and nowhere else, the rule's anchored expression is tried on the original text.
   Runs of hexadecimal digits have no keyword; their prefilter is the run itself.
3. Rules with an embedded checksum keep a match only if the checksum agrees.

Defined results: a null or empty text has no spans; texts are scanned whole whatever their length; repeated
rows are scanned each; an empty table gives an empty table; columns other than the id and the text are ignored.
Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices, text_rows

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int, width: int) -> str:
    digits = ""
    while n:
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits.rjust(width, "0")


def crc_checked(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of what stands between the prefix and them."""
    body = token[token.index("_") + 1 :]
    return _base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


@dataclass(frozen=True)
class Rule:
    """``keywords``: lower case, where a match starts. ``keep``: whether a match counts."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    keep: Callable[[re.Match], bool]


RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        lambda m: m.end(2) - m.start(2) >= 8,
    ),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16),
    Rule("hex", (), re.compile(r"[0-9a-f]{32,}"), lambda m: True),
    Rule(
        "checked",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
        re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        lambda m: crc_checked(m.group()),
    ),
)
KINDS = tuple(r.kind for r in RULES)
BASE = KINDS[:3]


@cache
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for n, rule in enumerate(RULES):
        for word in rule.keywords:
            auto.add_word(word, (n, len(word)))
    auto.make_automaton()
    return auto


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every secret, sorted. Matches of one kind never overlap; the leftmost wins."""
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, free = [], [0] * len(RULES)
    hits = sorted((end - size + 1, n) for end, (n, size) in _automaton().iter(lower))
    for start, n in hits:
        if start >= free[n] and (m := RULES[n].pattern.match(text, start)):
            free[n] = m.end()
            if RULES[n].keep(m):
                found.append((start, n, m.end()))
    n = KINDS.index("hex")
    found += [(m.start(), n, m.end()) for m in RULES[n].pattern.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[n]}:{start}:{end}" for start, n, end in spans)


def redact(text: str, mark: str = "[secret]") -> str:
    """``text`` with each maximal run of secret characters replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            spans = scan(text.as_py())
            base = [s for s in spans if s[1] < len(BASE)]
            counts = [sum(s[1] == n for s in spans) for n in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the number of spans of each kind and the spans themselves. One pass, no shuffle."""
    return text_rows(docs, id_col, text_col).mapInArrow(_scan_batches, SCHEMA)


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; every row and every other column stays."""
    return docs.mapInArrow(lean(_redact_batches), docs.schema)
