"""A training corpus from ``documents``: toxicity, near duplicates, benchmark passages, source mixture, shards.

Each stage takes what the one before it kept. All but the last return the columns of ``docs`` as they are, extra ones of any
name with them, and an empty table gives an empty one. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarflow.llm import common, decontamination, mixing, near_dedup, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learnt lexicon rejects go, and so do all rows of a rejected id.

    Null and empty texts are clean. Rows without an id are scored by no label and stay. Repeated rows stay or go together.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id, and of rows of one id all.

    A pair of Jaccard 0.8 on 5-word shingles is linked, missed with a chance of about 1.2 in a million. Null and empty texts, texts
    without words and rows without an id are linked with nothing and stay.
    """
    return near_dedup.drop_near_duplicates(docs, percent=80, at_least=14)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go: ten successive words, or a whole shorter item.

    Null and empty texts hold none. Rows are told apart by id, null among them, and text, so repeated rows go together.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once, those of small sources up to 1.5 times; the stage's rows have no pass or order, as they keep the columns of documents.

    A null source is a source. Rows without an id are placed by their text; sources without words are read once; repeated rows are
    drawn together.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot; copies of a text, those of the mixture among them, share a shard unless they exceed its share.

    Null texts count and group as empty ones; rows without an id and repeated rows are rows like any other.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: MinHash candidates, a learnt lexicon and hash orders are beyond SQL. Tests hold near duplicates and contamination against brute force,
#: toxicity against its operator and held-out labels, mixture and shards against what must hold of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
