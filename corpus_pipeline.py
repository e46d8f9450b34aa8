"""The corpus pipeline: documents through five operators of sparkloom.llm, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes what a stage returns to the shared folder and reads it again, so
a lost executor costs the tasks of one stage only.

Every stage takes null and empty texts, null and repeated ids, empty tables and further columns: texts that are null or
empty are judged as empty ones by the first stage, and stay in the second, third and fourth as they are; rows that repeat
id and text are judged alike, except that the second stage keeps one of them if they have words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, common, decontam, jaccard, quality, secrets

#: No stage's model or hash can be written in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labels on the rows of docs that have one."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the smallest doc_id stays."""
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), width=10)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars is that of the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of the text that they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_documents(docs, path, pattern, with_tokens=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("byte-level bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name.replace(" ", "-"))
    return docs
