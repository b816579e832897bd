"""From documents to token ids in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagelake.llm import bpe, minhash, mixing, pii, rules
from vintagelake.llm.common import shared_dir, table

#: No stage but the PII one could be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A row goes through the rules as one value, so no column clashes with theirs.

    Null, empty and short texts fail the base rules; repeated rows are judged alike; an empty table gives an empty one.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    out = rules.quality_rules(rows, table(spark, sf_dir, "labels"), keep=["row"])
    return out.where("kept").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: that of the smallest doc_id.

    Repeated rows are copies. Rows without words are copies only of those with the same doc_id; an empty table gives an empty one.
    """
    return minhash.first_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as pseudonyms; n_chars follows the text and is null with it. Rows stay, repeated ones alike."""
    return pii.pseudonymize(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("bigint"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: a rate below 1 keeps it or not by a hash of its doc_id, so repeated rows go together.

    A null or empty text has the rate 1. An empty table gives an empty one; columns stay, whatever their names.
    """
    return mixing.drawn(docs, table(spark, sf_dir, "labels"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, token_ids and n_tokens. A null text has none; repeated rows stay."""
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", quality_stage), ("near-duplicates", dedup_stage), ("personal data", pii_stage), ("mixing", mixing_stage), ("token ids", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows lie in the shared folder, so a lost executor costs one stage's tasks at most."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
