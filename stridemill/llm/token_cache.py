"""Token counts through a digest cache.

Every text is keyed by the SHA-256 of its normalised content together with a digest of the tokenizer file. Digests that
the cache already has are joined to their stored counts; of the others each distinct one is encoded once, by
the document with the smallest id that carries it, and appended to the cache as one row.

Normalisation here is null to empty and UTF-8, nothing more: anything stronger would give unequal texts one count.
The cache is a Parquet folder of (digest, tokenizer, n_tokens), written in append mode; a failed append leaves no
half-read files, and a row that two runs have both appended is read once.

Rows get their counts by a join on the digest, in which digests that very many rows carry are dealt with apart.

Defined results: null or empty texts count 0; whole texts are encoded whatever their length; repeated rows and rows with a null or
repeated id each get their count, and their text is encoded once; an empty table gives an empty table; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread_join, stored, text_rows
from .pieces import Pieces

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def file_digest(path: str) -> str:
    """What names a tokenizer version: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


_encoders: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """The byte-level encoder of this worker process; what it has learned serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Pieces(path, blanks=True)
    return _encoders[path]


def _count(path: str):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows of one id and one text come to one task
        for batch in slices(stream):
            new = []
            for digest in batch.column("digest").to_pylist():
                new.append(digest not in seen)
                seen.add(digest)
            batch = batch.filter(pa.array(new, pa.bool_()))
            if len(batch):
                n, _ = encoder(path).encode(batch.column("text").cast(pa.string()), False)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n)], ["digest", "n_tokens"])

    return batches


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Counts by digest for one tokenizer version; empty where there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digest) of every row."""
    return text_rows(docs, id_col, text_col).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    )


def update_cache(docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> None:
    """Encode the distinct misses and append them. ``known``: what ``digests`` gives for ``docs``, if that's stored already.

    The digests are aggregated first, so a text that a third of the rows share is one row from then on; the texts of the
    chosen rows are then found by a join on (digest, id), which spreads evenly whatever is repeated.
    """
    spark, version, none = docs.sparkSession, file_digest(tokenizer_path), F.lit(-(2**63))
    misses = (
        (digests(docs, id_col, text_col) if known is None else known)
        .groupBy("digest")
        .agg(F.min(F.coalesce("doc_id", none)).alias("chosen"))
        .join(read_cache(spark, cache, version), "digest", "left_anti")
        .select(F.col("digest").alias("miss"), "chosen")
    )
    rows = text_rows(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = rows.join(misses.hint("shuffle_hash"), (F.col("digest") == F.col("miss")) & (F.coalesce("doc_id", none) == F.col("chosen")), "left_semi")
    (
        texts.select("digest", "text")
        .mapInArrow(_count(tokenizer_path), "digest binary, n_tokens long")
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
        .select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
        .write.mode("append")
        .parquet(cache)
    )


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document, after bringing the cache up to date."""
    spark = docs.sparkSession
    rows = stored(digests(docs, id_col, text_col), "digests")
    update_cache(docs, tokenizer_path, cache, id_col, text_col, rows)
    counts = read_cache(spark, cache, file_digest(tokenizer_path))
    return spread_join(rows, counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
