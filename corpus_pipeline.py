"""From raw documents to training shards. Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written and read again as the next stage's docs. All stages but the last return the columns of documents; the last
adds the shard and the slot of each row.

A rejected document leaves at the stage that rejects it. A document that the mix takes several times is that many
rows from there on.

Defined results, stage by stage: null and empty texts fail the quality rules, as do texts of fewer than 20 words; ties of the
posterior stay. Of rows equal in doc_id and text one stays at the near-duplicate stage, rows of one doc_id with different texts
stay or go together, a null doc_id is no one's copy. Without benchmark items nothing is contaminated. A null source is a source
of its own in the mix. An empty table passes through all stages and gives no rows. Further columns are kept, whatever their
names, but for shard and slot. Very long texts are worked on whole, each by one task at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontam, mixing, near_dedup, quality, sharding
from sievework.llm._common import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a posterior probability of quality of at least one half."""
    return quality.filter_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, size=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of uniformly shuffled rows."""
    return sharding.shard(docs, n_shards=40)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: Expectation-maximisation, banded sketches and seeded shuffles are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
