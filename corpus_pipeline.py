"""Corpus pipeline: quality, near duplicates, benchmark contamination, domain weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the rows are
written as Parquet (in the folder of ``spark.checkpoint.dir``) and read again. All stages but the last return
the columns of ``documents``; the last returns the shard manifest of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waitwise.llm import decontaminate, mixing, ngramjoin, quality, sharding
from waitwise.llm.common import stored, table

#: Junk is gone by now, so the mix is of clean and toxic text.
MIX_DOMAINS = {"clean": "toxic = 0", "toxic": "toxic = 1"}
MIX_TARGETS = {"clean": 0.98, "toxic": 0.02}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier does not reject."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near copies."""
    return ngramjoin.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their fitted rates: a domain above its target weight is thinned out, one below is repeated."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"), MIX_TARGETS, MIX_DOMAINS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left."""
    return sharding.shard_documents(docs, 8, carry=["lang", "source", "n_chars"])


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: The classifiers and the components have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
