"""WARC derivatives: a metadata and a conversion record for every response record.

Both name the response in WARC-Refers-To and keep its target, date, payload and block digest and HTTP headers, as columns and
in written files. The metadata record's block has fields found in the page (title, language, links out), the conversion
record's block is its plain text. Record ids are name-based, so the same response gives the same records, run after run.

All of it is one narrow pass without a shuffle, in column expressions but for the character references, whose table has
2231 names: those are decoded in Arrow batches, where a text has any.

Raw pages come without date and HTTP headers; ``responses`` then assumes them, and the metadata record says so.

Response records read from WARC files keep their own ids, dates, headers and digests (``stored_responses``).

Defined results: a null payload is an empty one and has an empty conversion; a null address is empty; a null page id stays null, and such pages of one address and others'
repeated rows give records with one id; pages are read whole; repeated rows give repeated records; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

# Expressions that Java and RE2 read alike.
TITLE = "(?is)<title[^>]*>(.*?)</title"
LANGUAGE = '(?i)<html[^>]* lang="([^"]*)"'
#: The address of a link with its quotes, double, single or none.
LINK = "(?i)<a[ \\t\\r\\n/](?:[^>]*?[ \\t\\r\\n/])?href[ \\t\\r\\n]*=[ \\t\\r\\n]*(\"[^\"]*\"|'[^']*'|[^ \\t\\r\\n\"'>]+)"
#: What a reader doesn't see. A head ends at its end tag or where the body begins; the other elements end at theirs, or with the page.
HIDDEN = (
    "(?is)<!--.*?-->|<head(?=[ \\t\\r\\n/>]).*?(?:</head(?=[ \\t\\r\\n/>])[^>]*>|(?=<body[ \\t\\r\\n/>]))"
    "|<(script|style|noscript|template|title)(?=[ \\t\\r\\n/>]).*?(?:</\\1(?=[ \\t\\r\\n/>])[^>]*>|\\z)"
)
#: White space that isn't just one blank; single blanks, which are most, are passed over.
SPACES = "[ \\t\\r\\n\\f]{2,}|[\\t\\r\\n\\f]"
BREAKS = (
    "(?i)</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|article|section|nav|header|footer|aside|main|blockquote|pre|form|figure|figcaption)"
    "(?:[ \\t\\r\\n/][^>]*)?>"
)
#: A character reference, decimal, hexadecimal or named; the semicolon may lack where HTML lets it.
REFERENCE = re.compile("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{0,31};?)")


def decoded(text: str) -> str:
    """``text`` with each character reference decoded once, as HTML has it; no-break spaces among them are blanks."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), text)


def _decoded_batches(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else decoded(t) for t in texts.to_pylist()], pa.string())


def plain_text(page: Column) -> Column:
    """What a reader sees: no markup, scripts, comments or character references; one line per block."""
    text = F.regexp_replace(page, HIDDEN, " ")
    text = F.regexp_replace(text, SPACES, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, "(?s)<[/!?a-zA-Z][^>]*>", "")
    text = F.arrow_udf(_decoded_batches, "string")(text)
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "  +", " "), "\n[ \n]+| \n[ \n]*", "\n"), F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A record id from what names the record."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if k else ()) + (F.substring(h, a, n),)), F.lit(">")
    )


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of raw pages: source_id, record_id, target_uri, date, http_headers, assumed (which of these the pages don't say), payload."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("source_id"),
        record_id(F.lit("response"), url, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(HTTP_HEADERS).alias("http_headers"),
        F.lit("date, http-headers").alias("assumed"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    )


_CHARSET = re.compile(r"(?im)^content-type:.*?charset=[\"']?([\w.:-]+)")
RESPONSE_SCHEMA = "source_id long, record_id string, target_uri string, date string, http_headers string, assumed string, payload string, source_payload_digest string, source_block_digest string"


def stored_responses(records: DataFrame) -> DataFrame:
    """The response records among what ``read`` gives, as ``derivatives`` takes them: with their own id, date, HTTP headers and digests of their bytes.

    The payload is decoded by the charset in its headers, UTF-8 where there's none or an unknown one; bytes that it hasn't become U+FFFD. A record without id gets one
    from its address and block; ``assumed`` says what lacks. ``source_id`` is null, as files have no number for a record."""

    def parsed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for pairs, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist(), strict=True):
                h = dict(pairs)
                head, gap, payload = block.partition(b"\r\n\r\n")
                if not gap:
                    head, payload = b"", block
                http = (head + gap).decode("latin-1")
                charset = _CHARSET.search(http)
                try:
                    text = payload.decode(charset[1] if charset else "utf-8", "replace")
                except LookupError:
                    text = payload.decode("utf-8", "replace")
                own = h.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, h.get('warc-target-uri', '') + hashlib.sha256(block).hexdigest())}>"
                lacks = ", ".join(name for name, there in (("date", h.get("warc-date")), ("http-headers", http), ("record-id", h.get("warc-record-id"))) if not there)
                rows.append((None, own, h.get("warc-target-uri", ""), h.get("warc-date", ""), http, lacks, text, f"sha256:{hashlib.sha256(payload).hexdigest()}", f"sha256:{hashlib.sha256(block).hexdigest()}"))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], _RESPONSE_NAMES)

    found = records.filter(F.lower(F.try_element_at("headers", F.lit("warc-type"))) == "response")
    return found.select("headers", F.coalesce("block", F.lit(b"")).alias("block")).mapInArrow(parsed, RESPONSE_SCHEMA)


_RESPONSE_NAMES = [x.split()[0] for x in RESPONSE_SCHEMA.split(", ")]


def derivatives(records: DataFrame) -> DataFrame:
    """The two derived records of each response record (columns as ``responses`` or ``stored_responses`` gives them)."""
    payload, crlf = F.col("payload"), F.lit("\r\n")
    told = {"source_payload_digest": digest(payload), "source_block_digest": digest(F.concat("http_headers", payload))}
    sourced = records.select(
        "*",
        *(c.alias(name) for name, c in told.items() if name not in records.columns),
        plain_text(payload).alias("plain"),
        F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(1)), lambda u: F.regexp_replace(u, "^[\"']|[\"']$", "")).alias("links"),
    )
    one_line = lambda c: F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))
    fields = F.concat(
        F.lit("title: "), one_line(F.regexp_extract(payload, TITLE, 1)), crlf,
        F.lit("language: "), F.regexp_extract(payload, LANGUAGE, 1), crlf,
        F.lit("source-payload-digest: "), F.col("source_payload_digest"), crlf,
        F.lit("source-block-digest: "), F.col("source_block_digest"), crlf,
        F.lit("source-headers: "), one_line(F.col("http_headers")), crlf,
        F.when(F.col("assumed") == "", "").otherwise(F.concat(F.lit("assumed: "), F.col("assumed"), crlf)),
        F.array_join(F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, crlf)), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")),
    )
    return sourced.withColumn("r", F.explode(kinds)).select(
        "source_id",
        "r.warc_type",
        record_id(F.col("r.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        "source_payload_digest",
        "source_block_digest",
        F.col("http_headers").alias("source_headers"),
        F.size("links").cast("long").alias("n_links"),
        "r.block",
    )


def record(row: DataFrame) -> DataFrame:
    """One column ``record``: WARC headers, blank line and block."""
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
            ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-HTTP-Headers", "source_line"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [x for name, col in head for x in (F.lit(f"{name}: "), F.col(col).cast("string"), F.lit("\r\n"))]
    row = row.select("*", F.trim(F.regexp_replace("source_headers", "[ \\t\\r\\n]+", " ")).alias("source_line"))
    return row.select(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block")).alias("record"))


def write(derived: DataFrame, path: str) -> None:
    """Write records as WARC files, one for each partition, each record a gzip member of its own, so that readers can go to any of them by its offset.

    Files are listed in ``path`` only once all of them are whole; what a failed write leaves is in a folder that no reader looks into."""
    derived.sparkSession.dataSource.register(WarcFiles)
    record(derived).write.format("warc_files").mode("append").save(path)


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


class WarcFiles(DataSource):
    """Spark's side of ``write``: places are paths or URIs that pyarrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _WarcWriter(self.options["path"])


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, place: str):
        self.place, self.waiting = place, f"_waiting-{uuid.uuid4().hex}"

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.place) if "://" in self.place or self.place.startswith("file:") else (fs.LocalFileSystem(), self.place)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = self._opened()
        name, stream = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for text in batch.column("record").to_pylist():
                if stream is None:
                    files.create_dir(f"{root}/{self.waiting}", recursive=True)
                    stream = files.open_output_stream(f"{root}/{self.waiting}/{name}", compression=None)
                stream.write(gzip.compress(text.encode() + b"\r\n\r\n", mtime=0))
        if stream is not None:
            stream.close()
        return _Part(name if stream is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._opened()
        files.create_dir(root, recursive=True)
        for name in (m.name for m in messages if m is not None and m.name):
            files.move(f"{root}/{self.waiting}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._opened()
        if files.get_file_info(f"{root}/{self.waiting}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.waiting}")


READ_SCHEMA = "headers map<string,string>, block binary"


def unzipped(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in parts of about ``size``, whether plain or gzip of one or more members."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[k : k + size] for k in range(0, len(raw), size))
        return
    while raw:
        member = zlib.decompressobj(31)
        while not member.eof and (raw or member.unconsumed_tail):
            yield member.decompress(raw, size)
            raw = member.unconsumed_tail
        raw = member.unused_data


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file given in parts; header names in lower case. It holds one record at a time."""
    held, at = bytearray(), 0
    parts = iter(parts)

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        del held[:at]
        at = 0
        held.extend(part or b"")
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n", re.compile(rb"\s*").match(held, at).end())) < 0:
            if not more():
                return
        head = re.compile(rb"\s*WARC/1\.\d\r\n").match(held, at)
        if head is None:
            return
        pairs = (line.partition(":") for line in bytes(held[head.end() : end]).decode("utf-8", "replace").split("\r\n") if line)
        headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
        size, at = int(headers.get("content-length", 0)), end + 4
        while len(held) - at < size and more():
            pass
        yield headers, bytes(held[at : at + size])
        at += size


def read(spark: SparkSession, path: str, most: int = 8_000_000) -> DataFrame:
    """(headers, block) of the records of WARC files, plain or gzip, in batches of about ``most`` bytes; a larger record is a batch of its own."""

    def batch_of(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        headers = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([headers, pa.array([b for _, b in rows], pa.binary())], ["headers", "block"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in parse(unzipped(content.as_py())):
                    rows.append(row)
                    held += len(row[1])
                    if held > most:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, READ_SCHEMA)
