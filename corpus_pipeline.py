"""From raw documents to token ids, in five stages, each an operator of condensa.llm.

run() applies them to the documents of sf_dir. A stage's result is written as Parquet in
the shared folder and read again as the next one's docs, so that no stage depends on what
executors hold. All but the last keep the columns of documents. Only the last result stays.

Every stage keeps rows whose text is null or empty, takes texts of any length whole, and
gives an empty table for an empty one. Of rows that repeat near_dedup keeps one; ids that are
null come last in that. Columns beside doc_id and text may have any name and content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from condensa.llm.bpe import encode_decode
from condensa.llm.decontaminate import reject_leaks
from condensa.llm.pii import job_key, pseudonymise
from condensa.llm.simhash import deduplicate
from condensa.llm.toxicity import reject, train
from condensa.storage import delete, new_dir, scratch, spread, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't toxic, by a model of the labelled documents."""
    return reject(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return reject_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, personal values replaced by pseudonyms of their format."""
    return pseudonymise(docs, key=job_key(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, decoded) of every row."""
    return encode_decode(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", tokens)]

#: Learned weights, sketches and byte pairs are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage puts down between its steps goes when its result is there
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(spark, before)
        before = path
    return docs
