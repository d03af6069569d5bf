"""The training-data pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of its input; the last one
may return others, and returns the same.  ``run`` writes what each stage kept as Parquet to the shared
folder and gives it to the next.  A stage that needs statistics takes them from its own input.

Null texts are rejected by the first stage (no language).  The other stages take any rows, as their
operators' docstrings say.  Columns beyond those of documents are carried through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relweave.llm import decontamination, language, mixing, near_duplicates, pii
from relweave.llm.tables import keep, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told; learn from the labelled ones among them."""
    return language.accept(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class."""
    return near_duplicates.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put marks in place of personal data."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics get their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Language models and signatures cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
