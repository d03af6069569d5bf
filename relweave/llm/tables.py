"""Reading the tables by Spark, and frames kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relweave.session import materialize

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several jobs read to the folder in spark.checkpoint.dir, and read it back."""
    return materialize(df, f"llm-{name}")
