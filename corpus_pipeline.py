"""A training-data pipeline over documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import decontam, packing, secrets, simhash, toxicity
from mapweave.sources.shared import shared_folder

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Rows of an Arrow batch. With Spark's 10,000 a batch of whole texts is tens of MB, several times over in Java and in Python.
BATCH = 1_000


def thin(stage):
    """stage with Arrow batches of BATCH rows at most. A stage runs when its result is read, so the setting stays with the session."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, BATCH)
        return stage(spark, docs, sf_dir)
    return run_stage


@thin
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labelled ones, does not reject."""
    labels, labelled = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return toxicity.detoxified(docs, labels, labelled)


@thin
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by word shingles of five and a similarity of 0.8 or more."""
    return simhash.similar_removed(docs, shingle=5, similarity=0.8)


@thin
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a share of benchmark passages."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@thin
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redacted(docs)


@thin
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), LIMIT)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("secret_scan", redact_secrets), ("best_fit_packing", pack)]
#: No SQL: the first stage is a learned model. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, df, sf_dir).write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
    return df
