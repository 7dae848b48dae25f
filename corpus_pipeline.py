"""A corpus through five stages: language, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each is written as
Parquet and read again before the next. All stages take rows as they come: ids may be null or repeat (with
the same text or another), and columns beside those of documents pass through all but the last stage.
An empty table passes all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, language_id, packing, secrets, simhash
from weftline.session import prepare, remove, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learnt language; null texts, texts without letters and those like none of them go. Repeated rows fare alike."""
    prototypes = language_id.trained(docs)
    return language_id.accepted(docs, prototypes, language_id.norms(language_id.to_learn(docs), prototypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the least id (null ids last; ties by a hash of the row; of rows alike in all columns, one).

    Rows that share only their id all stay. Null and empty texts are near-duplicates of each other.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none and stay; repeated rows fare alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; the documents stay, null texts as null and repeated rows each."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids. Null texts are empty ones: the end token alone; repeated rows are packed each."""
    return packing.packed(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", pack)]

#: None: SQL can't express fingerprints, profiles, edit distances or retrieval here; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again; a stage's table is deleted when the next is written."""
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
