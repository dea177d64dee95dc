"""A training-data pipeline: toxic texts and near copies go, personal data is taken out,
sources are mixed to their weights and what is taken is packed into sequences.

Each stage works on all that the one before it kept, and all but the last return the columns of their
input.  Null or empty texts score as no words, are near copies of nothing, hold no personal data, have
no words to mix (so none of their copies is drawn, but certain whole copies stay) and are packed as an
end id; null ids and sources are kept; of repeated rows one is kept; very long texts are read whole;
columns of any other name pass through; an empty table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import mixing, neardup, packing, pii, toxicity
from cairnspark.llm.shared import drop, free, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; learned from the labelled rows among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free(docs, "toxic")
    return toxicity.score(docs, model, docs.columns, name).filter(f"{name} < 0.5").select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.representatives(docs)


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sanitised."""
    return pii.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_copies_out),
    ("personal_data", personal_data_out),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop(before)  # written by the stage before, and read by this one only
    return docs
