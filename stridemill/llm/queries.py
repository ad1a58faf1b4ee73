"""The queries of the corpus operators, by contract, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fm_dedup, mixing, packing, quality_forest, secret_scan, simhash, suffix_dedup, threshold_topk, token_cache, toxicity, warc_derivatives, whitening
from .common import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page."""
    records = warc_derivatives.responses(_table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z")
    return warc_derivatives.derivatives(records).withColumnRenamed("source_id", "page_id")


#: Languages get fixed shares, with one in a hundred for all that aren't named; sources and topics are flattened. A third of the tokens is kept.
MIX_TARGETS = {"lang": {"en": 0.39, "de": 0.22, "fr": 0.22, "es": 0.16}, "source": 0.5, "topic": 0.7}
MIX_BUDGET = 1 / 3


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability and whether it's sampled."""
    return mixing.probabilities(_table(spark, sf_dir, "documents"), mixing.word_topic(F.col("text")), MIX_TARGETS, MIX_BUDGET)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth."""
    vectors = threshold_topk.quantised(_table(spark, sf_dir, "embeddings"))
    return threshold_topk.top_k(vectors, vectors.filter("id % 50 = 0"), 5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 4096."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op6_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from a cache that starts empty."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_cache.count_tokens(_table(spark, sf_dir, "documents"), path, new_folder(spark, "token-cache"), limit=512)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels outside the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op9_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the forest's verdict on every document."""
    docs = _table(spark, sf_dir, "documents")
    verdicts = quality_forest.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_forest.judge(docs, verdicts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once later occurrences of 100-byte strings have gone."""
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op11_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once windows of 50 words that earlier documents have are gone."""
    return fm_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's two tokenisations."""
    a = (alignment.ByteLevel, public_tokenizers.path("byte_bpe_50k.json"))
    b = (alignment.Sentence, public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(_table(spark, sf_dir, "documents"), a, b)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's deviation and its whitened values by the first four components."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_threshold_topk": op4_threshold_topk,
    "op5_packing": op5_packing,
    "op6_token_cache": op6_token_cache,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_quality_forest": op9_quality_forest,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fm_dedup": op11_fm_dedup,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}



def _warc_sql() -> str:
    """Written apart from the operator, with expressions of its own. Of the character references it knows those that the tables' pages hold."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    uuid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    replaced = lambda x, pattern, by: f"regexp_replace({x}, {quoted(pattern)}, {by}, 'g')"
    unseen = "|".join(rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\b[^>]*>" for tag in ("head", "script", "style", "noscript", "template"))
    block = "article|aside|blockquote|br|div|dl|dt|dd|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"
    text = replaced("payload", f"(?is)<!--.*?-->|{unseen}", "' '")
    text = replaced(text, r"\s+", "' '")
    text = replaced(text, rf"(?i)</?(?:{block})(?:[\s/][^>]*)?>", "chr(10)")
    text = replaced(text, r"(?s)<[/!?[:alpha:]][^>]*>", "''")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    text = replaced(text, "&amp;?", "'&'")
    text = f"trim({replaced(replaced(text, ' +', quoted(' ')), ' ?\n[ \n]*', 'chr(10)')}, ' ' || chr(10))"
    one_line = lambda x: f"trim({replaced(x, r'\s+', quoted(' '))})"
    headers = f"'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || {crlf}"
    link = r"""(?i)<a[\s/](?:[^>]*?[\s/])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, {headers} AS http_headers,
    md5('response|' || coalesce(url, '') || '|' || coalesce(CAST(page_id AS VARCHAR), '')) AS h FROM pages
), s AS (
  SELECT *, {uuid("h")} AS refers_to, 'sha256:' || sha256(payload) AS source_payload_digest, 'sha256:' || sha256(http_headers || payload) AS source_block_digest,
    list_transform(regexp_extract_all(payload, {quoted(link)}, 1), lambda u: regexp_replace(u, '^["'']|["'']$', '', 'g')) AS links FROM r
), b AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || {one_line("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)")} || {crlf}
    || 'language: ' || regexp_extract(payload, '(?i)<html[^>]* lang="([^"]*)"', 1) || {crlf}
    || 'source-payload-digest: ' || source_payload_digest || {crlf} || 'source-block-digest: ' || source_block_digest || {crlf}
    || 'source-headers: ' || {one_line("http_headers")} || {crlf} || 'assumed: date, http-headers' || {crlf}
    || coalesce(array_to_string(list_transform(links, lambda u: 'outlink: ' || u || {crlf}), ''), '') AS block FROM s
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM s
), i AS (SELECT *, md5(warc_type || '|' || refers_to) AS g FROM b)
SELECT page_id, warc_type, {uuid("g")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest, source_block_digest,
  http_headers AS source_headers, CAST(len(links) AS BIGINT) AS n_links, block FROM i
"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc_derivatives": _warc_sql(),
    "op4_threshold_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_fm_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (h) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
o AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (SELECT doc_id, list(ws[i] ORDER BY i) AS kept FROM o ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
""",
}
