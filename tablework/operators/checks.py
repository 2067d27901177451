"""Data-quality checks for the constraints the reference's SQL advertises
but a parquet table cannot enforce (Q34: PRIMARY KEY, FOREIGN KEY, UNIQUE,
CHECK, NOT NULL).

Each check returns the violating rows as a DataFrame (lazy); ``summary``
turns several checks into one (check, n_violations) table with a single
aggregation per check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def not_null_violations(df: DataFrame, columns) -> DataFrame:
    """NOT NULL: rows with a NULL in any of ``columns``."""
    cond = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in _cols(columns)])
    return df.where(cond)


def unique_violations(df: DataFrame, columns) -> DataFrame:
    """UNIQUE / PRIMARY KEY: rows whose key occurs more than once (NULL keys
    are not compared, as in SQL UNIQUE).  An aggregation finds the duplicate
    keys (partial aggregation first, so a hot key is pre-counted per map
    task); a join brings back their rows."""
    cols = _cols(columns)
    notnull = df.dropna(subset=cols)
    dup_keys = notnull.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return notnull.join(dup_keys, cols, "left_semi")


def primary_key_violations(df: DataFrame, columns) -> DataFrame:
    """PRIMARY KEY = NOT NULL + UNIQUE."""
    return not_null_violations(df, columns).unionByName(unique_violations(df, columns))


def foreign_key_violations(child: DataFrame, child_cols, parent: DataFrame, parent_cols) -> DataFrame:
    """FOREIGN KEY: child rows (non-NULL key) without a parent - an anti join."""
    cc, pc = _cols(child_cols), _cols(parent_cols)
    keys = parent.select(*[F.col(f"`{p}`").alias(f"__k{i}") for i, p in enumerate(pc)]).distinct()
    cond = reduce(lambda a, b: a & b, [child[f"`{c}`"] == keys[f"__k{i}"] for i, c in enumerate(cc)])
    return child.dropna(subset=cc).join(keys, cond, "left_anti")


def check_violations(df: DataFrame, condition: str | Column) -> DataFrame:
    """CHECK: rows where the condition is FALSE (NULL passes, as in SQL)."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(cond, F.lit(True)))


def domain_violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """CHECK (col IN (...)): rows with a non-NULL value outside ``allowed``."""
    return check_violations(df, F.col(f"`{column}`").isin(*allowed))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n_violations) for several violation DataFrames."""
    parts = [v.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(k).alias("check"), "n_violations")
             for k, v in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def row_summary(df: DataFrame, violated: dict[str, Column]) -> DataFrame:
    """(check, n_violations) of conditions on single rows (NOT NULL, domains,
    CHECK), all counted in one pass over ``df``.  A condition says when a row
    violates the check; NULL means it does not."""
    names = list(violated)
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(violated.values())])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"n{i}").alias("n_violations")) for i, n in enumerate(names)])))
