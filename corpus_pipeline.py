"""Corpus pipeline: drop toxic documents, keep one of each near-duplicate group, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``, others that the table has included.  Null, empty and very long texts, null and repeated ids,
null sources and empty tables pass through every stage; see the docstrings for what each makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucidform.llm import minhash, mixing, packing, toxicity
from lucidform.llm.common import cut


#: Least similarity (percent of five-word shingles) of copies; op10 has a threshold of its own.
COPIES_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go.  Texts without words are scored like any other and stay unless rejected."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays; null or blank texts and rows without doc_id are never copies."""
    return minhash.one_of_each(docs, percent=COPIES_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times.  A null source is a source of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents; a document that the mix took twice has its pieces twice."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_copies), ("mixing", mix_sources), ("best_fit_packing", pack)]

#: The trained classifier and the set similarities have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; returns the pieces with their places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
