"""The reference's synthetic sales tables (FIXTURES A1/A2), seeded.

``spark.range`` split over ``partitions`` tasks; every value is a built-in
expression of the row id and a seeded ``rand``, so generation is fully
parallel and reproducible.  Used by tests and local experiments only; the
registered queries read the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: value domains of the reference's generator ---------------
STATUSES = ("Completed", "Pending", "Cancelled")
N_CUSTOMERS = 100_000
N_PRODUCTS = 1_000
N_REGIONS = 50
N_REPS = 6
# ---------------------------------------------------------------------------


def make_sales(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None,
               wide: bool = True, days: int = 1460) -> DataFrame:
    """``large_sales_data`` (wide=True, 10 columns) or ``small_sales_data``
    (wide=False, 7 columns, ``days=365``)."""
    parts = partitions or max(1, spark.sparkContext.defaultParallelism)
    r = lambda k: F.rand(seed + k)
    # the reference draws random() twice for the status: 70 / 27 / 3 %
    first, second = r(6), r(7)
    status = (F.when(first < 0.7, F.lit(STATUSES[0]))
              .when(second < 0.9, F.lit(STATUSES[1])).otherwise(F.lit(STATUSES[2])))
    df = spark.range(1, n + 1, numPartitions=parts).select(
        F.col("id"),
        F.concat(F.lit("Customer_"), F.floor(r(1) * N_CUSTOMERS).cast("string")).alias("customer_name"),
        F.concat(F.lit("Product_"), F.floor(r(2) * N_PRODUCTS).cast("string")).alias("product_name"),
        (F.lit(10) + r(3) * 1000).cast("decimal(10,2)").alias("price"),
        (F.lit(1) + F.floor(r(4) * 100)).cast("int").alias("quantity"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(r(5) * days).cast("int")).alias("order_date"),
        status.alias("status"),
    )
    if wide:
        df = df.select(
            "*",
            F.concat(F.lit("Region_"), F.floor(r(8) * N_REGIONS).cast("string")).alias("region"),
            (F.lit(1) + F.floor(r(9) * N_REPS)).cast("int").alias("sales_rep_id"),
            F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("customer_name"))).alias("order_hash"),
        )
    return df
