"""The training-data pipeline: quality, near duplicates, decontamination, mixing, token store.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written before the next one
reads it. All but the last return the columns of documents.

Defined cases, for all stages: a null text counts as an empty one; it is scored like any other, is near to nothing, contains nothing, is taken 0 times by the mix, and would be an end id alone in
the store. Very long texts go through whole. Rows of one doc_id are judged alike by quality (each by its text) and stay or go together as near duplicates; equal rows are taken equally often. A null
doc_id has no near duplicate. Of equal choices the smallest doc_id counts. Columns of any names travel along. Empty tables give empty results; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, jaccard, mixing, quality, tokenstore
from foliant.llm.common import new_path, table, written
from foliant.llm.queries import held_out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. It learns from the labels that are not held out."""
    model = quality.fit(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    return quality.score(docs, model).filter(F.col("_score") >= quality.REJECT_BELOW).drop("_score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents with similar shingle sets, the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of all documents, and for each one what is read back from it."""
    import public_tokenizers

    tokenstore.write_store(docs, path := new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenstore.document_sums(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: No SQL can express the classifier, the draws and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
