"""The registered queries of this subpackage and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontam, jaccard, katz, licenses, oracle, quality, repetition, sentpiece, suffixes, toxicity
from loomgraph.llm.common import crc_mod, table

MODEL = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat.render(table(spark, sf_dir, "conversations"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def _scored(scored: DataFrame, mod: int, rest: int) -> DataFrame:
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), mod) == rest).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=crc_mod(F.col("doc_id"), 4) != 2)
    return _scored(quality.score(docs, model), 4, 2)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentpiece.digests(table(spark, sf_dir, "documents"), tokenizer(MODEL))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=crc_mod(F.col("doc_id"), 3) != 1)
    return _scored(toxicity.score(docs, model), 3, 1)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id", "class_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline  # noqa: F401  # it lies beside the package, and goes with this subpackage

    ops = (
        op1_decontamination, op2_chat_formatting, op3_quality_classifier, op4_sentencepiece, op5_toxicity,
        op6_jaccard_join, op7_lm_scoring, op8_suffix_dedup, op9_license_scan, op10_quality_rules, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()
