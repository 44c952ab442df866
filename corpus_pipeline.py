"""A training-data pipeline over `documents`: five stages, each with one operator of gridloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.queries import table, tokenizer_path
from gridloom.llm.shared import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic."""
    from gridloom.llm.toxicity import drop_toxic

    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score is below 0.3."""
    from gridloom.llm.quality_cnn import keep_quality

    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of documents linked at Jaccard 0.8 over 5-word shingles the one of smallest id."""
    from gridloom.llm.jaccard_join import keep_one

    return keep_one(docs, width=5, threshold=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into the order of a mix of all sources with equal weights."""
    from gridloom.llm.mixing import mixed_order

    return mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 4096: of equal lengths in the order of the mix, if the documents come from files."""
    from gridloom.llm.packing import has_places, pack

    return pack(docs, tokenizer_path(), in_order=has_places(docs))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: The classifiers cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
