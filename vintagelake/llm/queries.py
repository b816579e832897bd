"""The operators as registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagelake.llm import audit, bpe, classifier, html, langid, media, minhash, mixing, periodic, pii, rules, sharding
from vintagelake.llm.common import hash_part, table

TOKEN_LIMIT = 2048


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rates of all documents, for the default targets."""
    out = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *(F.round(F.col("mix_posteriors")[i], 6).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)), F.col("mix_rate").alias("rate"), F.col("mix_miss").alias("target_miss"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and their texts again, as digests."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by their prefix counts."""
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of all texts as stored images, read back through the data source."""
    return media.media_features(media.media_column(spark, table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", (hash_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = classifier.predict(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (hash_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal data."""
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymize(docs.select("doc_id", "text"), pii.session_key(spark))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdicts of all documents."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together; a null text is an empty one, a repeated row takes a slot of its own."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents as digests, those of every tenth by its hash made periodic first. A null doc_id is left as it is; a null text has no words."""
    docs = table(spark, sf_dir, "documents")
    return periodic.run_digests(periodic.periodic_runs(docs, plant=periodic.plant_number()), ["doc_id"])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose in each of their 120 orders, by language; null and empty languages are one part."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OPERATORS = [op1_minhash_near_dedup, op2_mixing, op3_bpe_round_trip, op4_token_counts, op5_media_columns, op6_html_extraction, op7_language_id, op8_quality_classifier, op9_pii_pseudonyms, op10_quality_rules, op11_sharding, op12_periodic_runs, op13_filter_audit]


def queries() -> dict:
    own = {f.__name__: f for f in OPERATORS}
    import corpus_pipeline

    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The shards and the audit as SQL. The others' results can't be stated in SQL alone; their tests hold them against brute force."""
    return {"op11_sharding": sharding.SQL, "op13_filter_audit": audit.SQL}
