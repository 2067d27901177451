"""Buckets of consecutive rows for keys that are too large for one task.

A window or an as-of join needs a key's rows in order, but not in one task:
a hot key is cut at sampled quantiles of its order, each bucket is worked on
by itself, and one row per bucket carries what the next ones need to know.
Which bucket a row is in follows from the row and a small stored table of
cuts alone, so nothing has to be staged and every task can be repeated.

Keys and orders are compared as structs: NULLs are equal to each other and
come first, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.session import shared_dir

HOT_ROWS = 1_000_000  # rows of a key that one task takes; a larger one is cut
SAMPLES = 20          # sampled rows for each bucket of a hot key

KEY, ORDER, BUCKET = "__key", "__order", "__bucket"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small table to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_struct(keys: list[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))


def hot_cuts(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """rows(__key, __order) -> (__key, __n, __cuts: ascending orders at which
    the key is cut) of the keys with more than ``hot_rows`` rows; None if
    there is none.  There are at most rows / hot_rows of them, and about as
    many cuts in all.  An order that many rows share is cut at repeatedly."""
    counts = stored(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows), "hot_keys")
    if counts.isEmpty():
        return None
    n_buckets = F.ceil(F.col("__n") / hot_rows)
    sample = rows.join(counts, KEY).where(F.rand(11) < n_buckets * SAMPLES / F.col("__n")) \
        .groupBy(KEY).agg(F.sort_array(F.collect_list(ORDER)).alias("s"))
    cut = "transform(sequence(1, cast(ceil(__n / {0}) as int) - 1), i -> s[cast(floor(i * size(s) / ceil(__n / {0})) as int)])".format(int(hot_rows))
    return stored(sample.join(counts, KEY).select(KEY, "__n", F.expr(cut).alias("__cuts")), "hot_cuts")


def position(cuts: Column, x: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` are not above ``x`` (binary search;
    ``most`` bounds their number)."""
    steps = [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(
        (lo + s <= F.size(cuts)) & (F.try_element_at(cuts, lo + s) <= x), lo + s).otherwise(lo))


def most_cuts(cuts: DataFrame) -> int:
    return cuts.agg(F.max(F.size("__cuts"))).first()[0] or 0


def with_bucket(rows: DataFrame, cuts: DataFrame | None, descending: bool = False) -> DataFrame:
    """rows(__key, __order, ...) + __bucket, ascending in the window's order
    (0 for all rows of a key that is not hot)."""
    if cuts is None:
        return rows.withColumn(BUCKET, F.lit(0))
    at = position(F.col("__cuts"), F.col(ORDER), most_cuts(cuts))
    return rows.join(cuts.select(KEY, F.array_distinct("__cuts").alias("__cuts")), KEY, "left") \
        .withColumn(BUCKET, F.when(F.col("__cuts").isNull(), 0).otherwise(-at if descending else at)).drop("__cuts")
