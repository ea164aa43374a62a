"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact, mixing, neardup, packing, quality
from corpusmill.llm.common import documents, remove, remove_at_exit, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts have under 50 words and go; very long texts are measured whole. Each row is judged on its own,
    whatever its doc_id: repeated rows stay or go together. An empty table stays empty; all columns are kept, also ones
    named like measures.
    """
    return quality.quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id.

    Null counts as the empty text. A null doc_id is kept only where no other row has the text; rows that repeat both
    doc_id and text stay or go together. Very long texts are compared as lists of chunks. An empty table stays empty;
    all columns are kept.
    """
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id.

    Null texts and texts without words are linked with nothing and stay. One doc_id with two texts is two documents; a
    null doc_id comes last in its group. Rows that repeat both stay or go together. Very long texts count with all
    their shingles. An empty table stays empty; all columns are kept.
    """
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of lighter sources as often as the mixture reads them.

    A null source counts as the source ''; texts without words are read as often as others. A document longer than a
    block is read whole. Repeated rows are documents of their own. An empty table stays empty; all columns are kept.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all readings in sequences of 2048 tokens.

    Null and empty texts are one end id; only texts longer than a sequence are cut. Repeated rows and null doc_ids are
    packed each on their own. An empty table gives no places; of the columns only doc_id is kept.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization, similarity links and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the session's shared folder and read again.

    What a stage wrote is removed as soon as the next one has read it; the last one's rows are removed when the session
    ends.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_at_exit(spark, path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
