"""Table sinks and table maintenance.

Tables are parquet tables in the session catalog.  A database created by
:func:`ensure_database` lives in the shared folder (``spark.checkpoint.dir``)
so every executor can reach it.  Rewrites of a table that is also the input
(replace from itself, UPDATE / DELETE / DROP COLUMN on parquet, which Spark
rejects) go through a staging table that is then renamed into place; this
is two catalog operations, not one atomic swap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tablework.operators.schema import align, widen_type
from tablework.session import shared_dir

MODES = ("create", "replace", "append", "append_evolve", "append_positional")


def _q(name: str) -> str:
    return ".".join(f"`{p.strip('`')}`" for p in name.split("."))


def ensure_database(spark: SparkSession, name: str) -> str:
    """Create ``name`` in the shared folder when it does not exist yet."""
    if not spark.catalog.databaseExists(name):
        loc = shared_dir(spark, "warehouse", f"{name}.db")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{loc}'")
    return name


def table_exists(spark: SparkSession, name: str) -> bool:
    """R14."""
    return spark.catalog.tableExists(name)


def table_schema(spark: SparkSession, name: str) -> dict[str, str]:
    """Column name -> type (DDL spelling), no job."""
    return {f.name: f.dataType.simpleString() for f in spark.table(name).schema.fields}


def _is_self_overwrite(err: Exception) -> bool:
    msg = str(err)
    return ("UNSUPPORTED_OVERWRITE" in msg or "also being read from" in msg
            or "overwrite" in msg.lower() and "read" in msg.lower())


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _bucket_spec(spark: SparkSession, name: str) -> tuple[int, list[str]] | None:
    buckets = [c.name for c in spark.catalog.listColumns(name) if c.isBucket]
    if not buckets:
        return None
    info = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_q(name)}").collect()}
    n = info.get("Num Buckets")
    return (int(n), buckets) if n else None


def _staged_replace(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """H5: write to a staging table, drop the target, rename staging into place.
    The table's partitioning and bucketing are kept."""
    spark = df.sparkSession
    db, _, tbl = name.rpartition(".")
    staging = f"{db + '.' if db else ''}{tbl}__staging_{uuid.uuid4().hex[:8]}"
    writer = df.write.format(fmt).mode("errorifexists")
    if spark.catalog.tableExists(name):
        parts = partition_columns(spark, name)
        if parts:
            writer = writer.partitionBy(*parts)
        spec = _bucket_spec(spark, name)
        if spec:
            writer = writer.bucketBy(spec[0], *spec[1]).sortBy(*spec[1])
    writer.saveAsTable(staging)
    spark.sql(f"DROP TABLE IF EXISTS {_q(name)}")
    spark.sql(f"ALTER TABLE {_q(staging)} RENAME TO {_q(name)}")


def write_table(df: DataFrame, name: str, mode: str = "replace", fmt: str = "parquet",
                partition_by: list[str] | None = None, on_type_conflict: str = "widen",
                bucket_by: tuple[int, list[str]] | None = None) -> str:
    """Write ``df`` as table ``name``.

    ``partition_by`` lays the table out in directories (filters on those
    columns prune whole directories); ``bucket_by=(n, columns)`` hash-buckets
    it so later joins / aggregations on those columns with tables bucketed
    the same way need no shuffle.

    * ``create`` (K1): fails if the table exists.
    * ``replace`` (K2, K16): drop + create; staged when ``df`` reads ``name``.
    * ``append`` / ``append_evolve`` (K3-K5): by name; a missing table is
      created; new columns are added with ``ALTER TABLE ADD COLUMNS``; absent
      columns are NULL; the table's columns keep their order.
    * ``append_positional`` (K3 as the reference's native path did): by position.
    """
    spark = df.sparkSession
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        writer = writer.bucketBy(int(n), *cols).sortBy(*cols)
    exists = spark.catalog.tableExists(name)
    if mode == "create":
        if exists:
            raise ValueError(f"table {name} already exists")
        writer.mode("errorifexists").saveAsTable(name)
    elif mode == "replace":
        if not exists:
            writer.mode("errorifexists").saveAsTable(name)
        else:
            try:
                writer.mode("overwrite").saveAsTable(name)
            except AnalysisException as e:
                if not _is_self_overwrite(e):
                    raise
                _staged_replace(df, name, fmt)
    elif mode == "append_positional":
        if not exists:
            writer.mode("errorifexists").saveAsTable(name)
        else:
            df.write.insertInto(name)
    else:
        append_evolve(df, name, fmt=fmt, on_type_conflict=on_type_conflict)
    return name


def add_missing_columns(spark: SparkSession, name: str, fields: list[T.StructField]) -> list[str]:
    """K4: ``ALTER TABLE ADD COLUMNS`` for fields the table lacks."""
    have = {c.lower() for c in spark.table(name).columns}
    new = [f for f in fields if f.name.lower() not in have]
    if new:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {_q(name)} ADD COLUMNS ({cols})")
        spark.catalog.refreshTable(name)
    return [f.name for f in new]


def append_evolve(df: DataFrame, name: str, fmt: str = "parquet",
                  on_type_conflict: str = "widen") -> list[str]:
    """K4/K5: append by name with schema evolution; returns added columns.

    A column whose incoming type is wider than the table's is an error under
    ``on_type_conflict="error"``; under ``"widen"`` the table is rewritten
    once (staged) with the widened type before appending.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.format(fmt).mode("errorifexists").saveAsTable(name)
        return list(df.columns)
    current = spark.table(name).schema
    cur = {f.name.lower(): f for f in current.fields}
    widen = {}
    for f in df.schema.fields:
        t = cur.get(f.name.lower())
        if t is not None and widen_type(t.dataType, f.dataType) != t.dataType:
            widen[t.name] = widen_type(t.dataType, f.dataType)
    if widen:
        if on_type_conflict == "error":
            raise ValueError(f"incoming types are wider than the table's: {widen}")
        old = spark.table(name)
        _staged_replace(old.select(*[F.col(f"`{c}`").cast(widen[c]).alias(c) if c in widen
                                     else F.col(f"`{c}`") for c in old.columns]), name, fmt)
    added = add_missing_columns(spark, name, [f for f in df.schema.fields])
    target = spark.table(name).schema
    align(df, target).write.insertInto(name)
    return added


def drop_table(spark: SparkSession, name: str) -> None:
    """R10."""
    spark.sql(f"DROP TABLE IF EXISTS {_q(name)}")


def drop_view(spark: SparkSession, name: str) -> None:
    """Temp view first, then a catalog view of that name."""
    if not spark.catalog.dropTempView(name):
        spark.sql(f"DROP VIEW IF EXISTS {_q(name)}")


def create_view(spark: SparkSession, name: str, sql: str) -> None:
    """Q29 views: a temp view over a query (the catalog has no persisted views of temp data)."""
    spark.sql(sql).createOrReplaceTempView(name)


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {_q(name)}")


def drop_column(spark: SparkSession, name: str, column: str) -> None:
    """Parquet tables do not support DROP COLUMN -> staged rewrite.
    Refuses to drop the last column."""
    df = spark.table(name)
    if len(df.columns) <= 1:
        raise ValueError("cannot drop the only column of a table")
    if column.lower() not in [c.lower() for c in df.columns]:
        raise ValueError(f"no column {column!r} in {name}")
    _staged_replace(df.drop(column), name)


def _cond(condition: str | Column) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


def updated_frame(df: DataFrame, assignments: dict, condition: str | Column | None = None) -> DataFrame:
    """The rows of ``df`` after ``UPDATE SET k = v WHERE condition`` (NULL condition = no match)."""
    cond = F.lit(True) if condition is None else _cond(condition)
    lowered = {k.lower(): (F.expr(v) if isinstance(v, str) else v) for k, v in assignments.items()}
    cols = []
    for f in df.schema.fields:
        v = lowered.get(f.name.lower())
        if v is None:
            cols.append(F.col(f"`{f.name}`"))
        else:
            cols.append(F.when(cond, v.cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name))
    return df.select(*cols)


def deleted_frame(df: DataFrame, condition: str | Column) -> DataFrame:
    """The rows of ``df`` after ``DELETE WHERE condition`` (NULL condition keeps the row)."""
    return df.where(~F.coalesce(_cond(condition), F.lit(False)))


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"'{v}'" if not isinstance(v, (int, float)) else repr(v)


def _rewrite_touched_partitions(spark: SparkSession, name: str, condition, change) -> bool:
    """For a partitioned table, rewrite only the partitions holding rows that
    match ``condition``: their rows after ``change`` are checkpointed (which
    also cuts the read of the target) and written with dynamic partition
    overwrite; partitions left empty are dropped.  Returns False when the
    table is not partitioned."""
    parts = partition_columns(spark, name)
    if not parts:
        return False
    t = spark.table(name)
    cond = F.lit(True) if condition is None else _cond(condition)
    # one row per touched partition (bounded by the partition count)
    touched = [tuple(r) for r in t.where(F.coalesce(cond, F.lit(False))).select(*parts).distinct().collect()]
    if not touched:
        return True
    keys = spark.createDataFrame(touched, t.select(*parts).schema).toDF(*[f"__k{i}" for i in range(len(parts))])
    same = F.lit(True)
    for i, c in enumerate(parts):  # null-safe: the NULL partition is one like any other
        same = same & t[c].eqNullSafe(keys[f"__k{i}"])
    subset = t.join(keys, same, "left_semi")
    from tablework.session import checkpoint_root

    checkpoint_root(spark)
    new = change(subset).checkpoint()
    remaining = {tuple(r) for r in new.select(*parts).distinct().collect()}
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        align(new, t.schema).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(key, before)
    for values in touched:
        if values not in remaining:
            spec = ", ".join(f"`{c}` = " + ("null" if v is None else _sql_value(v)) for c, v in zip(parts, values))
            spark.sql(f"ALTER TABLE {_q(name)} DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(name)
    return True


def update_where(spark: SparkSession, name: str, assignments: dict,
                 condition: str | Column | None = None) -> None:
    """Q31 UPDATE on a parquet table.  Partitioned tables rewrite only the
    partitions that hold matching rows (updating a partition column is a full
    rewrite); others are one staged rewrite."""
    parts = {c.lower() for c in partition_columns(spark, name)}
    if not parts & {k.lower() for k in assignments} and _rewrite_touched_partitions(
            spark, name, condition, lambda d: updated_frame(d, assignments, condition)):
        return
    _staged_replace(updated_frame(spark.table(name), assignments, condition), name)


def delete_where(spark: SparkSession, name: str, condition: str | Column) -> None:
    """Q31 DELETE on a parquet table (only the touched partitions of a
    partitioned table are rewritten)."""
    if _rewrite_touched_partitions(spark, name, condition, lambda d: deleted_frame(d, condition)):
        return
    _staged_replace(deleted_frame(spark.table(name), condition), name)


def insert_values(spark: SparkSession, name: str, rows: list[tuple], columns: list[str] | None = None) -> None:
    """Q30 ``INSERT INTO t [(cols)] VALUES ...`` (by name when columns are given)."""
    target = spark.table(name).schema
    cols = columns or target.fieldNames()
    schema = T.StructType([target[c] for c in cols])
    incoming = spark.createDataFrame(rows, schema)
    align(incoming, target).write.insertInto(name)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views with their columns, as a DataFrame (catalog metadata)."""
    rows = []
    for t in spark.catalog.listTables(database):
        qual = f"{t.namespace[0]}.{t.name}" if t.namespace and not t.isTemporary else t.name
        try:
            for c in spark.catalog.listColumns(qual):
                rows.append((t.name, t.tableType, c.name, c.dataType, bool(c.nullable)))
        except AnalysisException:
            rows.append((t.name, t.tableType, None, None, None))
    return spark.createDataFrame(
        rows, "table_name string, table_type string, column_name string, data_type string, nullable boolean")


def schema_digest(listing: DataFrame) -> DataFrame:
    """md5 over the sorted ``table.column:type`` entries of a listing
    (changes when a table, a column or a type changes)."""
    entry = F.concat_ws(":", F.concat_ws(".", "table_name", "column_name"), F.col("data_type"))
    return listing.agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_list(entry)))).alias("digest"))
