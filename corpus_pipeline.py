"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

Filtering stages keep all columns of ``documents``; the last returns the mixture: doc_id, domain,
language, source, n_tokens and the epochs that each document is taken for. SQL has no form for
the inferred secret formats, so the pipeline is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewell.llm import decontaminate, jaccard, mixing, repetition, secrets
from notewell.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return repetition.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.redact(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The epochs of each document in the target mix."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("target_mix", target_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Nulls in any column are values like others: a null or empty text has no words, so the quality rules
    reject it; a null lang or source is ``unknown`` to the mix; a null doc_id is an id of its own. Repeated rows
    are near duplicates of each other, and one stays. Extra columns pass through the filtering stages. An
    empty table gives an empty mixture.
    """
    space = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
