"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before wrote; ``run`` writes every stage's rows as
Parquet in the folder all executors share and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import mixing, near_dedup, packing, pii, quality
from tidegraph.llm.common import staged, table
from tidegraph.plans.rounds import forget

#: The least similarity, of five-word shingles, at which a document is a copy.
SIMILAR = (80, 100)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return near_dedup.keep_one(docs, similar=SIMILAR).select(COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced."""
    return pii.sanitise(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights, in a shuffled order."""
    return mixing.poisson_mix(docs).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
            forget(before)  # what this stage kept is written; nothing reads the one before again
    return docs
