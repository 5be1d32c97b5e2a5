"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark passages' documents go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import copies, decontaminate, pieces, toxicity
from parley.llm.common import forget, written
from parley.llm.queries import model_bytes


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't call them toxic. Null and empty texts stay unless such examples are mostly toxic; repeated rows are judged alike; without labels all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose sets of five-word shingles are alike by 0.8 or more, the document of the least id.

    Texts without words are alike, null ones too; rows that repeat an id and its text count as one; a null id gives way to any other.
    """
    return copies.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts stay; repeated rows are judged alike; an empty benchmark takes none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, held against its decoding. A null text has no tokens; other columns go."""
    return pieces.encode(docs.select("doc_id", "text"), model_bytes())


STAGES = [("toxicity", not_toxic), ("near_duplicates", no_near_copies), ("decontamination", decontaminated), ("encoding", encoded)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder, from which the next reads.

    All but the last give the columns of documents, whatever these are named; an empty table gives an empty result. Null
    and empty texts, very long ones, repeated rows and null ids pass as each stage's own docstring says.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs
