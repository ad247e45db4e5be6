"""From raw documents to shards of training data, in stages that are each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table. All but the last keep the columns of the
documents: texts without a language go, one document of each group of near duplicates stays, documents
with a passage of the benchmark go, sources are drawn in whole documents to their target weights, and
the last stage adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streampace.llm import decontaminate, language_id, mixing, near_copies, sharding
from streampace.llm.common import table
from streampace.plans.durable import durable, released

WIDTH = 5        # words of a run
SIMILAR = 0.8    # Jaccard similarity of the runs from which two documents are near copies


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found. The model is learned from the documents themselves."""
    return language_id.drop_undetermined(docs, language_id.learn(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return near_copies.drop_near_copies(docs, WIDTH, SIMILAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for, half as many words again in all."""
    return mixing.mixed_documents(docs)


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``shard`` and ``slot``."""
    return sharding.sharded(docs)


STAGES = [("language_id", identified), ("simhash", deduplicated), ("decontaminate", decontaminated),
          ("mixing", mixed), ("sharding", placed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``. What a stage stored besides its result goes when the result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released() as kept:
            docs = durable(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
