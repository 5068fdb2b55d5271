"""A corpus pipeline: quality rules, near duplicates, repeated strings, benchmark contamination, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives the next one's docs, which
are written and read again between stages. All but the last return the columns of documents, whatever else these
are and however they are called. An empty table stays empty in every stage; texts of any length are looked at whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, jaccard, repetition, sentpiece, suffixes
from loomgraph.llm.common import table, written
from loomgraph.llm.queries import MODEL, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null and empty texts have too few words and go; repeated rows are kept or go together."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of least id of each group that Jaccard links connect.

    Rows with that id stay together, also repeated ones. Null and empty texts are linked with nothing and stay, as do rows with a null id.
    """
    return jaccard.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a string of 100 bytes with an earlier start covers; a text may become empty.

    Null texts stay null; rows with a null id aren't compared and stay whole; rows with equal ids and texts are one text and are
    cut alike. n_chars follows the text.
    """
    return suffixes.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts stay; null items have no windows, ones with a null id do."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text and the decoded text, how many ids, and digests of ids and decoded text; null texts count as empty."""
    made = sentpiece.encode(docs, tokenizer(MODEL))
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", "ids", "decoded", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SQL can't express the fifth stage's tokenizer; the tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
