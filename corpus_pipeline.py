"""A corpus pipeline over the table ``documents``: quality, near duplicates, repeated passages, benchmark leaks, then the mixture.

Each stage is one operator of ``decafix.llm`` over all that the stage before it kept, written and read again in between. Parameters are the operators' defaults: quality
0.3 and up stays; texts whose five-word shingles are 0.8 alike are one group, of which the least doc_id stays; 100 bytes that occurred before are removed, and a document
of which nothing is left goes; a document with 11 of 13 consecutive words of a benchmark item goes; sources are flattened to 0.95 of the greatest
entropy, with at most 4 passes over any.

Results by case. Null, empty and blank texts pass the first four stages (scored by the share of good labels, no one's copies, nothing to remove, no leak) and are no part of the mixture.
Very long texts are read whole by every stage. Rows without an id are kept by the near-duplicate stage and told apart by their text; rows that repeat an id are judged each by its own
text; equal rows stay or go together. A null source is a source of its own. A score of exactly 0.3 and a similarity of exactly 0.8 count. An empty table gives no rows. Extra columns are kept, whatever their
names, but ``epoch`` and ``block_rank``, which the mixture replaces; ``n_chars`` is counted anew where text was removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from decafix.llm import decontaminate, mixing, quality, simhash, suffix
from decafix.plans.lineage import ensure_checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def unrepeat(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", dedup), ("suffix-array dedup", unrepeat), ("benchmark decontamination", decontaminated), ("mixing sources", mixture)]

#: Compression and shingle hashes are beyond SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared folder and read as the next one's input, so that a lost executor costs
    no more than a part of one stage."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{shared}/pipeline-{uuid.uuid4()}"
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
