"""Import workflows built from the readers and sinks.

* ``import_folder_as_tables`` (S15 + C5): one table per file, names planned
  for the whole listing in one Spark job.
* ``bulk_import`` (K6): every file of a folder into one table in a single
  union and a single write - "replace" replaces once (the reference
  replaced per file and kept only the last, defect 3).
* ``merge_folder_to_csv`` (K7): a folder of CSV files into one CSV output
  folder, with create / replace / append (append re-reads the output and
  unions by name before a staged rewrite).
* ``typed_with_rejects`` (B7): cast text columns to a target schema; rows
  whose non-NULL values do not convert go to a rejects DataFrame instead of
  failing the load.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators.names import plan_table_names
from tablework.operators.schema import union_by_name
from tablework.session import shared_dir
from tablework.sinks import tables
from tablework.sources.probe import list_files
from tablework.sources.readers import read_files


def import_folder_as_tables(spark: SparkSession, folder: str, database: str, file_type: str = "csv",
                            pattern: str = "*.csv", prefix: str = "", **read_options) -> DataFrame:
    """Every file becomes its own table ``<database>.<unique cleaned name>``.

    One read of the whole folder (probe, one scan per header group) and one
    write partitioned by target table; each table is then registered on its
    partition directory with only its own columns (parquet resolves columns by
    name).  So N files cost one scan and one write job plus N catalog
    statements, not N jobs.  Returns the plan (path, file_name, table_name).
    """
    from tablework.operators.names import clean_names

    listing = list_files(spark, folder, pattern)
    existing = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables(database) if not t.isTemporary], "name string")
    plan = plan_table_names(listing, existing, "file_name", prefix).select("path", "file_name", "table_name")
    # one row per file: the table names are needed on the driver for the catalog
    targets = {r["path"]: r["table_name"] for r in plan.collect()}
    policy = read_options.pop("policy", "keep_case")
    df, res = read_files(spark, folder, file_type, pattern=pattern, lineage="path", policy=policy,
                         **read_options)
    columns = {r["path"]: clean_names(list(r["header"]), policy)
               for r in res.probes.where("status = 'ok'").select("path", "header").collect()}
    mapping = spark.createDataFrame(list(targets.items()), "_source_file string, _table string")
    types = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    base = _database_location(spark, database) + f"/__import_{uuid.uuid4().hex[:8]}"
    (df.join(mapping, "_source_file").drop("_source_file")
       .write.partitionBy("_table").parquet(base))
    for path, table in sorted(targets.items()):
        cols = columns.get(path)
        if not cols:
            continue          # rejected file (reported by the probe)
        ddl = ", ".join(f"`{c}` {types.get(c.lower(), 'string')}" for c in cols)
        spark.sql(f"CREATE TABLE {database}.`{table}` ({ddl}) USING parquet "
                  f"LOCATION '{base}/_table={table}'")
    return plan


def _database_location(spark: SparkSession, database: str) -> str:
    rows = spark.sql(f"DESCRIBE DATABASE `{database}`").collect()
    info = {r[0].lower(): r[1] for r in rows}
    return info.get("location", "").rstrip("/")


def bulk_import(spark: SparkSession, folder: str, table: str, mode: str = "replace",
                file_type: str = "csv", **read_options) -> DataFrame:
    """K6: a folder into one table with a single union and one write."""
    df, result = read_files(spark, folder, file_type, **read_options)
    tables.write_table(df, table, mode="replace" if mode == "replace" else
                       ("create" if mode == "create" else "append"))
    return result.report(spark.table(table))


def merge_folder_to_csv(spark: SparkSession, folder: str, output: str, mode: str = "create_new",
                        pattern: str = "*.csv", fill_missing=None, **read_options) -> str:
    """K7: merge a folder of CSV files into the CSV folder ``output``.

    ``create_new`` fails if the output exists, ``replace`` overwrites it,
    ``append`` adds part files when the new files bring no new column, and
    otherwise unions the existing output by name with the new files and
    rewrites it through a staging folder in the shared scratch area."""
    from tablework.operators.clean import fill_missing as fill
    from tablework.sinks.export import export_csv

    new, _ = read_files(spark, folder, "csv", pattern=pattern, **read_options)
    if fill_missing is not None:
        new = fill(new, fill_missing)
    if mode == "create_new":
        return export_csv(new, output, mode="errorifexists")
    if mode == "replace":
        return export_csv(new, output, mode="overwrite")
    if mode != "append":
        raise ValueError("mode must be create_new, replace or append")
    if not path_exists(spark, output):
        return export_csv(new, output, mode="errorifexists")
    old, _ = read_files(spark, output, "csv", lineage=False)
    incoming = new.drop("_source_file") if "_source_file" not in old.columns else new
    if {c.lower() for c in incoming.columns} <= {c.lower() for c in old.columns}:
        # same or fewer columns: new part files with the output's own header
        # order are appended; nothing already written is read back or rewritten
        from tablework.operators.schema import align

        aligned = align(incoming, old.columns)
        if fill_missing is not None:
            aligned = fill(aligned, fill_missing)
        return export_csv(aligned, output, mode="append")
    merged = union_by_name([old, incoming])
    if fill_missing is not None:
        merged = fill(merged, fill_missing)
    staging = shared_dir(spark, "merge_staging")
    merged.write.parquet(staging)  # the output is read to its end before it is overwritten
    export_csv(spark.read.schema(merged.schema).parquet(staging), output, mode="overwrite")
    return output


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def typed_with_rejects(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that convert to ``schema``, rejected rows with the failing
    column names).  One projection computes the casts; both outputs are
    filters of it."""
    casts, bad = [], []
    for f in schema.fields:
        src = F.col(f"`{f.name}`")
        c = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
        casts.append(c.alias(f.name))
        bad.append(F.when(src.isNotNull() & c.isNull(), F.lit(f.name)))
    staged = df.select(*[F.col(f"`{c}`").alias(f"__src_{i}") for i, c in enumerate(df.columns)],
                       *casts, F.array_compact(F.array(*bad)).alias("__failed"))
    ok = staged.where(F.size("__failed") == 0).select(*[F.col(f"`{f.name}`") for f in schema.fields])
    rejects = staged.where(F.size("__failed") > 0).select(
        *[F.col(f"__src_{i}").alias(c) for i, c in enumerate(df.columns)],
        F.array_join("__failed", ",").alias("failed_columns"))
    return ok, rejects

