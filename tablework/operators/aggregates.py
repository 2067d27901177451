"""Grouped aggregates that keep their input from being multiplied: grouping
sets from the finest groups (Q18), several exact distinct counts (A12, Q19),
and sketches that are kept and merged (A14)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators.buckets import KEY, key_struct

# function -> its partial states; a state's own combination is its name's function
_STATES = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}
_PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_COMBINED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def grouping_sets(df: DataFrame, keys: list[str], functions: dict[str, tuple[str, str]], sets: str | list[list[str]] = "cube",
                  grouping_id: str | None = None) -> DataFrame:
    """``GROUP BY CUBE / ROLLUP / GROUPING SETS`` with sum, count, min, max or
    avg for each name: (function, column); column ``*`` counts rows.

    Spark's own plan copies every input row for each grouping set.  Here the
    rows are grouped once by all keys, and only these groups' partial states
    are copied and put together."""
    states = {}
    for f, c in functions.values():
        for s in _STATES[f]:
            states[f"__{s}_{c}"] = (s, F.lit(1) if c == "*" else F.col(f"`{c}`"))
    finest = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[_PARTIAL[s](c).alias(n) for n, (s, c) in states.items()])
    cols = [F.col(f"`{k}`") for k in keys]
    if sets == "cube":
        grouped = finest.cube(*cols)
    elif sets == "rollup":
        grouped = finest.rollup(*cols)
    else:
        grouped = finest.groupingSets([[F.col(f"`{k}`") for k in s] for s in sets], *cols)
    out = grouped.agg(F.grouping_id().alias("__id"), *[_COMBINED[s](F.col(f"`{n}`")).cast(finest.schema[n].dataType).alias(n) for n, (s, _) in states.items()])

    def value(f: str, c: str) -> Column:
        if f == "avg":
            return F.try_divide(F.col(f"`__sum_{c}`"), F.col(f"`__count_{c}`"))
        return F.coalesce(F.col(f"`__count_{c}`"), F.lit(0).cast("bigint")) if f == "count" else F.col(f"`__{f}_{c}`")

    return out.select(*cols, *([F.col("__id").cast("bigint").alias(grouping_id)] if grouping_id else []),
                      *[value(f, c).alias(name) for name, (f, c) in functions.items()])


DENSE = 64  # a bitmap is used where the values' range is at most so many times the number of rows


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n_<column> for each column): exact distinct counts, NULLs not
    counted; keys are NULL-safe.

    Spark copies every row for each of several ``count(DISTINCT)``.  Here each
    column is counted by itself over the keys and that column alone, and the
    counts of a key are joined.  Dense integers become bitmaps of 32,768
    values on the map side (one row of 4 KB in place of up to 32,768); other
    values are made distinct by (key, value), so a hot key is many groups."""
    rows = df.select(key_struct(keys).alias(KEY), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    whole = [i for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.IntegralType)]
    dense: set[int] = set()
    if whole:
        facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.min(f"c{i}").alias(f"lo{i}") for i in whole], *[F.max(f"c{i}").alias(f"hi{i}") for i in whole]).first()
        dense = {i for i in whole if facts[f"lo{i}"] is not None and facts[f"hi{i}"] - facts[f"lo{i}"] <= DENSE * facts["n"]}
    parts = []
    for i in range(len(columns)):
        one = rows.select(KEY, F.col(f"c{i}").alias("v"))
        if i in dense:
            v = F.col("v").cast("bigint")
            bits = one.where("v is not null").groupBy(KEY, F.bitmap_bucket_number(v).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("m"))
            n = bits.groupBy(KEY).agg(F.sum(F.bitmap_count("m")).alias(f"n{i}"))
        else:
            n = one.where("v is not null").groupBy(KEY, "v").agg(F.lit(1).alias("x")).groupBy(KEY).agg(F.count("x").alias(f"n{i}"))
        parts.append(n)
    out = functools.reduce(lambda a, b: a.join(b, KEY, "left"), parts, rows.select(KEY).distinct())
    return out.select(*[F.col(f"{KEY}.k{i}").alias(k) for i, k in enumerate(keys)],
                      *[F.coalesce(f"n{i}", F.lit(0).cast("bigint")).alias(f"n_{c}") for i, c in enumerate(columns)])


# ------------------------------------------------------------------- sketches
LG_K = 14  # HLL: 2^14 registers, about 0.8 % standard error
KLL_K = 200  # KLL: about 1.3 % rank error


def sketches(df: DataFrame, keys: list[str], distinct: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """(keys, hll_<column>, kll_<column>): mergeable sketches of each group."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.hll_sketch_agg(F.col(f"`{c}`"), LG_K).alias(f"hll_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), KLL_K).alias(f"kll_{c}") for c in quantiles])


def keep_sketches(df: DataFrame, table: str, batch_id: int, keys: list[str], distinct: list[str] = (), quantiles: list[str] = ()) -> None:
    """Add a batch's sketches to ``table`` (beside the data, a few KB for each
    group); a batch that is repeated replaces what it wrote before."""
    from tablework.streaming.ingest import write_batch

    write_batch(sketches(df, keys, distinct, quantiles), table, batch_id, "sketch")


def from_sketches(kept: DataFrame, keys: list[str], distinct: list[str] = (), quantiles: dict[str, list[float]] | None = None) -> DataFrame:
    """(keys, n_rows, distinct_<column>, <column>_q<percent>) of kept
    sketches, merged over batches and whatever keys are not asked for."""
    quantiles = quantiles or {}
    merged = kept.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.sum("n_rows").alias("n_rows"), *[F.hll_union_agg(f"hll_{c}").alias(f"hll_{c}") for c in distinct],
        *[F.kll_merge_agg_double(f"kll_{c}", KLL_K).alias(f"kll_{c}") for c in quantiles])
    return merged.select(*[F.col(f"`{k}`") for k in keys], "n_rows",
                         *[F.hll_sketch_estimate(f"hll_{c}").alias(f"distinct_{c}") for c in distinct],
                         *[F.kll_sketch_get_quantile_double(f"kll_{c}", F.lit(float(q))).alias(f"{c}_q{round(q * 100)}")
                           for c, qs in quantiles.items() for q in qs])
