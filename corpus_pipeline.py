"""A pipeline of corpus operators over the documents; see STAGES.

Each stage gets what its predecessor has kept, all of it. All but the last return the columns of the documents.

Defined results: null and empty texts are empty to every stage, and near duplicates of each other; texts are read whole. Rows with a
null id are scored, redacted, sampled and packed like others, and no near duplicates. Texts that share an id are documents of their own to
the near-duplicate stage; rows that share both are one. Null languages and sources are values of their own. Stages keep further columns, whatever
their names, up to packing. An empty table gives an empty table, and without labels no document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.llm import mixing, packing, secret_scan, simhash, toxicity
from stridemill.llm.common import discard, new_folder
from stridemill.llm.queries import MIX_BUDGET, MIX_TARGETS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, doesn't reject."""
    return toxicity.filtered(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles, similarity 0.8."""
    return simhash.without_duplicates(docs, shingle=5, exact=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and the characters counted anew."""
    out = secret_scan.redact_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    return mixing.sample(docs, mixing.word_topic(F.col("text")), MIX_TARGETS, MIX_BUDGET)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: No stage's decisions can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all STAGES, each written and read again; what a stage has written on its way goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made, place = stage(spark, docs, sf_dir), new_folder(spark, name)
        made.write.parquet(place)
        docs = spark.read.schema(made.schema).parquet(place)
        discard(spark, keep=(place,))
    return docs
