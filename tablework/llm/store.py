"""Shared-folder intermediates and small input helpers for the operators.

``materialise`` cuts lineage by writing a Parquet table below the folder the
cluster names in ``spark.checkpoint.dir`` (replicated storage, so a lost
executor costs nothing); ``discard`` removes one that has been read for the
last time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.session import apply_runtime_conf, shared_dir


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Session settings the Arrow steps rely on: small batches bound a Python
    worker's memory (texts may be long)."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = shared_dir(spark, "llm", name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_llm_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aside(docs: DataFrame) -> tuple[list, dict[str, str]]:
    """All columns of ``docs`` under names of our own (``__c0`` ...), as
    expressions, and their names by ours: whatever a document's columns are
    called, they cannot meet the columns a step adds."""
    names = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    return [F.col(f"`{c}`").alias(n) for n, c in names.items()], names


def bounded_sample(df: DataFrame, by: list[str], size: int, total: int | None = None) -> DataFrame:
    """At most ``size`` rows, those with the smallest hash of ``by`` (ties by
    their values): the same rows whatever the partitions.  A share of the
    hash range that holds them is cut out first, so that what tasks send to
    the final ordering is about ``size`` rows in all, not from each."""
    total = df.count() if total is None else total
    hashed = df.withColumn("_hash", F.xxhash64(*by))
    if total > 4 * size:
        share = int(2.0 ** 64 * min(1.0, 2.0 * size / total))
        hashed = hashed.where(F.col("_hash") < F.lit(-(2 ** 63) + share))
    return hashed.orderBy("_hash", *by).limit(size).drop("_hash")
