"""Base-table and fixture loading.

Base tables are parquet; registering them as views keeps scans lazy, so
Catalyst prunes columns and pushes filters into each scan on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gauntlet.sources.fixtures import FIXTURE_SQL, FIXTURE_TABLES

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, read whole and as it is split."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input table; the plan binds to the views at call time."""
    register_tables(spark, sf_dir, FIXTURE_TABLES[name])
    return spark.sql(FIXTURE_SQL[name])
