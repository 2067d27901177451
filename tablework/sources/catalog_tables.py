"""Access to the driver's parquet tables (``<dir>/<name>.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views named like the tables, so SQL text can refer to them."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
