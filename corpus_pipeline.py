"""A corpus from documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's
docs. What a stage drops is gone for those after it; all but the last return the columns of documents.

Null texts are empty ones: the classifier scores them, the quality rules drop them as they have no words. Very long
texts are read whole. Of equal and near copies the least doc_id stays (of equal ones the longest first), null doc_ids
losing to others and the row read first winning ties; repeated rows are copies. Columns of documents beyond the known
ones are kept, whatever their names, until packing, which returns pieces. An empty table gives no rows in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainloom.llm import exact_dedup, ngram_join, packing, quality_model, quality_rules
from trainloom.llm.common import Scratch
from trainloom.llm.queries import table, tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it predicts to be of quality stay."""
    return quality_model.keep(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that pass stay."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts one document stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies one document stays."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all that is left, with their ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("packing", pack)]

#: Neither the classifier nor the components of the join can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
