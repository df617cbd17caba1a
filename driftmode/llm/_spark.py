"""Small Spark helpers: shared folder, written tables, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, shared_dir  # noqa: F401


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under names that no operator uses, and the new name of each."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that ``set_aside`` renamed, as they were."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def without(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` without columns named like those that an operator adds; these take their place."""
    taken = {c.lower() for c in added}
    return docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in taken))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
