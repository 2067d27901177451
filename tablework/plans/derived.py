"""Registered queries over files and tables that Spark derives from the given
ones, for the paths a plain table scan does not take: very wide headers, long
JSON records, deep line breaks, malformed rows, NULL keys and partitions,
restarted streams, repeated file names.  Importing this module registers them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.plans.showcase import _scratch, _scratch_table, _t, query

WIDE = 600


@query("csv_wide_header", f"""
SELECT s_suppkey::VARCHAR AS first_cell, (s_suppkey + {WIDE - 1})::VARCHAR AS last_cell, {WIDE}::BIGINT AS n_columns
FROM supplier
""")
def csv_wide_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header line of 600 names (over 20 KB) gives 600 columns."""
    from tablework.sources.readers import read_csv

    names = [f"quite_a_long_column_name_with_number_{i}" for i in range(WIDE)]
    rows = _t(spark, sf_dir, "supplier").select(
        *[(F.col("s_suppkey") + i).cast("string").alias(n) for i, n in enumerate(names)])
    path = _scratch(spark, "wide")
    rows.write.option("header", "true").csv(path)  # the header line is in every file
    got = read_csv(spark, path, lineage=False)
    return got.select(F.col(names[0]).alias("first_cell"), F.col(names[-1]).alias("last_cell"),
                      F.lit(len(got.columns)).cast("bigint").alias("n_columns"))


@query("json_long_first_record", """
SELECT doc_id, length(text)::BIGINT AS n FROM documents
""")
def json_long_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in ``.json.gz`` files whose records are far longer than a
    head.  The files are compressed, as their records hold mostly filling, and
    have a bounded number of records, as such files are not split."""
    from tablework.sources.readers import read_json

    path = _scratch(spark, "longjson")
    _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("x"), 20_000), "text").alias("text")) \
        .write.option("compression", "gzip").option("maxRecordsPerFile", 5_000).json(path)
    return read_json(spark, path, lineage=False).select("doc_id", (F.length("text") - 20_000).cast("bigint").alias("n"))


@query("csv_deep_line_break", """
SELECT doc_id::VARCHAR AS doc_id, regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g') AS text FROM documents
""")
def csv_deep_line_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: quoted line breaks anywhere in the files, the first ones far beyond the
    head; the files are read split by split all the same."""
    from tablework.sinks.export import export_csv
    from tablework.sources.readers import read_csv

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    path = _scratch(spark, "deep")
    # texts without breaks come first in every file
    ordered = docs.sortWithinPartitions(F.instr("text", "\n") > 0, "doc_id")
    export_csv(ordered, path)
    return read_csv(spark, path, lineage=False)


def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablework.sources.readers import read_csv

    path = _scratch(spark, "malformed")
    o = _t(spark, sf_dir, "orders")
    cells = (F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(",", "o_orderkey", "o_custkey"))
             .when(F.col("o_orderkey") % 11 == 0, F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderkey"))
             .otherwise(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus")))
    # a column named like the header line, without quoting: every part file begins with that line
    o.select(cells.alias("key,cust,status")).write.option("header", "true").option("sep", "\u0001").option("quote", "\u0000").csv(path)
    return read_csv(spark, path, delimiter=",", lineage=False, bad_rows="drop_malformed")


_MALFORMED_SQL = "SELECT * FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"


@query("csv_malformed_rows", f"""
SELECT o_orderkey::VARCHAR AS key, o_custkey::VARCHAR AS cust, o_orderstatus AS status FROM ({_MALFORMED_SQL})
""")
def csv_malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: rows of another width than the header are dropped."""
    return _malformed(spark, sf_dir)


@query("csv_malformed_projection", f"""
SELECT o_orderkey::VARCHAR AS key, (SELECT count(*) FROM ({_MALFORMED_SQL}))::BIGINT AS n FROM ({_MALFORMED_SQL})
""")
def csv_malformed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the same rows whatever columns are used, and the same count."""
    df = _malformed(spark, sf_dir)
    return df.select("key").withColumn("n", F.lit(df.count()).cast("bigint"))


@query("csv_many_headers", """
SELECT o_orderkey::VARCHAR AS k, (o_custkey % 300)::VARCHAR AS g, o_orderstatus AS v FROM orders
""")
def csv_many_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: 300 different headers of one width: one read, mapped by name."""
    from tablework.sources.readers import read_csv

    path = _scratch(spark, "headers")
    o = _t(spark, sf_dir, "orders").withColumn("g", F.col("o_custkey") % 300)
    head = o.select("g").distinct().select("g", F.lit(0).alias("n"), F.concat(F.lit("k,g,v"), F.col("g")).alias("value"))
    body = o.select("g", F.lit(1).alias("n"), F.concat_ws(",", "o_orderkey", "g", "o_orderstatus").alias("value"))
    head.unionByName(body).repartition("g").sortWithinPartitions("g", "n") \
        .select("value", F.col("g").alias("part")).write.partitionBy("part").text(path)
    df = read_csv(spark, path, pattern="*.txt", delimiter=",", recursive=True, lineage=False)
    values = [c for c in df.columns if c not in ("k", "g")]
    # the first value there is; a coalesce of 300 columns becomes one method, too long for the JVM to compile
    found = F.filter(F.array(*[F.col(f"`{c}`") for c in values]), lambda v: v.isNotNull())
    return df.select("k", "g", F.get(found, F.lit(0)).alias("v"))


def _null_partition_table(spark: SparkSession, sf_dir: str, name: str) -> str:
    from tablework.sinks.tables import write_table

    t = _scratch_table(spark, name, sf_dir)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    write_table(o, t, mode="replace", partition_by=["status"])
    return t


@query("table_update_null_partition", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice, nullif(o_orderstatus, 'P') AS status
FROM orders
""")
def table_update_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31: UPDATE reaches the rows of a NULL partition and keeps the others."""
    from tablework.sinks.tables import update_where

    t = _null_partition_table(spark, sf_dir, "orders_null_update")
    update_where(spark, t, {"o_totalprice": "0"}, "o_orderkey % 2 = 0")
    return spark.table(t)


@query("table_delete_null_partition", """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
WHERE NOT (o_orderkey % 3 = 0) AND NOT (o_orderstatus = 'O' AND o_orderkey > 0)
""")
def table_delete_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31: DELETE in a NULL partition; a partition left empty goes."""
    from tablework.sinks.tables import delete_where

    t = _null_partition_table(spark, sf_dir, "orders_null_delete")
    delete_where(spark, t, "o_orderkey % 3 = 0")
    delete_where(spark, t, "status = 'O'")
    return spark.table(t).select("o_orderkey", "status")


@query("row_number_null_keys", """
SELECT o_orderkey, row_number() OVER (PARTITION BY nullif(o_orderstatus, 'P') ORDER BY o_orderkey) AS row_number FROM orders
""")
def row_number_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key are numbered as one group."""
    from tablework.operators.windows import row_number_by_range

    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return row_number_by_range(o, ["status"], ["o_orderkey"]).select("o_orderkey", "row_number")


@query("merge_csv_new_column", """
SELECT doc_id::VARCHAR AS doc_id, '"' || lang || '", ' || chr(10) || source AS note, NULL::VARCHAR AS chars FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id::VARCHAR, '"' || lang || '", ' || chr(10) || source, n_chars::VARCHAR FROM documents WHERE doc_id % 2 = 1
""")
def merge_csv_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: appending files with a new column rewrites the output; quotes, commas
    and line breaks in its texts survive."""
    from tablework.plans.imports import merge_folder_to_csv
    from tablework.sinks.export import export_csv
    from tablework.sources.readers import read_csv

    d = _t(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit('"'), "lang", F.lit('", \n'), "source").alias("note"), F.col("n_chars").alias("chars"))
    base = _scratch(spark, "merge")
    export_csv(d.where("doc_id % 2 = 0").drop("chars"), f"{base}/one")
    export_csv(d.where("doc_id % 2 = 1"), f"{base}/two")
    merge_folder_to_csv(spark, f"{base}/one", f"{base}/out", lineage=False)
    merge_folder_to_csv(spark, f"{base}/two", f"{base}/out", mode="append", lineage=False)
    return read_csv(spark, f"{base}/out", lineage=False).select("doc_id", "note", "chars")


@query("stream_restart", """
SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders
""")
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run, as after a restart, loads only the files that are new,
    and keeps what the first one loaded."""
    from tablework.sinks.tables import drop_table
    from tablework.streaming.ingest import ingest_new_files

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    folder = _scratch(spark, "restart")
    table = _scratch_table(spark, "orders_restart", sf_dir)
    drop_table(spark, table)
    for status in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == status).write.option("header", "true").csv(f"{folder}/{status}")
        # each time another session finds the checkpoint that lies beside the table
        out = ingest_new_files(spark.newSession(), folder, table, pattern="*.csv")
        spark.catalog.refreshTable(table)
        assert out.count() == o.where(F.col("o_orderstatus") <= status).count()
    return spark.table(table).select("o_orderkey", "o_orderstatus")


@query("import_report_same_names", """
SELECT 'F' AS folder, count(*)::BIGINT AS rows FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'O', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'P', count(*) FROM orders WHERE o_orderstatus = 'P'
""")
def import_report_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are counted per path."""
    from tablework.sources.readers import read_files

    folder = _scratch(spark, "report")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    for status in ("F", "O", "P"):
        o.where(F.col("s") == status).write.option("header", "true").csv(f"{folder}/{status}")
    df, res = read_files(spark, folder, "csv", recursive=True)
    return res.counted.groupBy(F.regexp_extract("_path", "/([FOP])/[^/]*$", 1).alias("folder")).agg(
        F.count("*").alias("rows"))


@query("narrowed_values", """
SELECT lpad(p_partkey::VARCHAR, 8, '0') AS code, p_size::INTEGER AS size,
       '12345678901234567890' || p_partkey::VARCHAR AS long_id, p_partkey::VARCHAR || 'd' AS suffixed FROM part
""")
def narrowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with leading zeros, long ids and suffixed numbers stay text."""
    from tablework.operators.clean import narrow_types

    p = _t(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.col("p_size").cast("string").alias("size"),
        F.concat(F.lit("12345678901234567890"), F.col("p_partkey").cast("string")).alias("long_id"),
        F.concat(F.col("p_partkey").cast("string"), F.lit("d")).alias("suffixed"))
    return narrow_types(p)[0].withColumn("size", F.col("size").cast("int"))


@query("fn_truncate_replace", """
SELECT l_orderkey, l_linenumber, trunc(l_discount * 10) / 10 AS one_digit,
       regexp_replace(l_returnflag || 'xRAx' || l_returnflag, '(R|A)(x|A)', '_') AS first_only FROM lineitem
""")
def fn_truncate_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM7 with digits and FS12 (first match only, pattern with groups)."""
    from tablework.functions import compat as X

    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.trunc_number("l_discount", 1).alias("one_digit"),
                     X.regexp_replace_first(
                         F.concat("l_returnflag", F.lit("xRAx"), "l_returnflag"), "(R|A)(x|A)", "_").alias("first_only"))


@query("fn_dates_of_rows", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(8 - isodow(CAST(o_orderdate AS DATE)) AS INTEGER) AS next_monday,
       (CAST(o_orderdate AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS new_york,
       0::BIGINT AS today_gap, -1::BIGINT AS yesterday_gap, 1::BIGINT AS tomorrow_gap
FROM orders
""")
def fn_dates_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FD2-FD7, FD31, FD33 on each order's date."""
    o = _t(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    today = F.current_date()
    gap = lambda d: F.datediff(d, F.expr("curdate()")).cast("bigint")
    return o.select(
        "o_orderkey", F.next_day(day, "MON").alias("next_monday"),
        F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), day.cast("timestamp_ntz")).alias("new_york"),
        gap(today).alias("today_gap"), gap(F.date_sub(today, 1)).alias("yesterday_gap"),
        gap(F.date_add(today, 1)).alias("tomorrow_gap"))


@query("quoted_identifiers", """
SELECT "o_orderkey" AS "order key", "o_totalprice" FROM orders WHERE "o_orderstatus" = 'F'
""")
def quoted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in double quotes are identifiers."""
    from tablework.plans.showcase import run_surface_sql

    return run_surface_sql(spark, sf_dir, 'SELECT "o_orderkey" AS "order key", "o_totalprice" FROM orders WHERE "o_orderstatus" = \'F\'')


@query("xlsx_nullable_types", """
SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 <> 0 THEN (9007199254740000 + o_orderkey)::VARCHAR END AS big,
       CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END END AS flag
FROM orders
""")
def xlsx_nullable_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nullable integers beyond 2^53 and booleans through a workbook."""
    from tablework.sinks.export import dealt, export_excel
    from tablework.sources.xlsx import read_excel

    path = _scratch(spark, "xlsx_types")
    o = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 9007199254740000).alias("big"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "F").alias("flag"))
    export_excel(dealt(o), path).collect()
    return read_excel(spark, path, lineage=False)[0].select("id", "big", "flag")


@query("xlsx_broken_isolated", """
SELECT s_suppkey::VARCHAR AS id, s_name AS name, 1::BIGINT AS n_rejected FROM supplier
""")
def xlsx_broken_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is no workbook is reported; the others are read."""
    from tablework.sinks.export import dealt, export_excel
    from tablework.sources.xlsx import read_excel

    path = _scratch(spark, "xlsx_broken")
    supplier = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    export_excel(dealt(supplier, 4), f"{path}/good").collect()
    supplier.select(F.col("name").alias("value")).write.text(f"{path}/junk")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = fs.globStatus(jvm.Path(f"{path}/junk/part-*"))[0].getPath()
    fs.rename(part, jvm.Path(f"{path}/good/zz_broken.xlsx"))
    df, res = read_excel(spark, f"{path}/good", lineage=False)
    return df.select("id", "name").withColumn("n_rejected", F.lit(len(res.rejected_files)).cast("bigint"))


@query("xlsx_all_sheets", """
SELECT c_custkey::VARCHAR AS key, c_name AS name, 'Query Results' AS sheet FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, 'Query Results' FROM supplier
""")
def xlsx_all_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets of a folder's workbooks with the sheet's name."""
    from tablework.sinks.export import dealt, export_excel
    from tablework.sources.xlsx import read_excel

    path = _scratch(spark, "xlsx_sheets")
    customer = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    export_excel(dealt(customer, 4), f"{path}/a").collect()
    export_excel(dealt(_t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))), f"{path}/b").collect()
    df, _ = read_excel(spark, path, recursive=True, sheet="*")
    return df.select("key", "name", F.col("_source_sheet").alias("sheet"))


@query("folder_lineage_paths", """
SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS folder FROM orders
""")
def folder_lineage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: each row carries the path of its file."""
    from tablework.sources.readers import read_files

    base = _scratch(spark, "lineage")
    o = _t(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("key")) \
            .write.option("header", "true").csv(f"{base}/{status}")
    df, _ = read_files(spark, base, "csv", recursive=True, lineage="path")
    return df.select("key", F.regexp_extract("_source_file", "/([FOP])/[^/]*$", 1).alias("folder"))


@query("csv_cp1252", """
SELECT doc_id::VARCHAR AS doc_id, replace(lang || ' été ' || source, chr(13), '') AS note FROM documents
""")
def csv_cp1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not UTF-8 are read as cp1252, wherever the first such byte is."""
    from tablework.sources.readers import read_csv

    path = _scratch(spark, "cp1252")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", F.lit("été"), "source").alias("note"))
    d.write.option("header", "true").option("encoding", "windows-1252").csv(path)
    return read_csv(spark, path, lineage=False)


@query("csv_sniffed_no_header", """
SELECT o_orderkey::VARCHAR AS column0, o_orderstatus AS column1, o_custkey::VARCHAR AS column2 FROM orders
""")
def csv_sniffed_no_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sniffed delimiter, and generated names without a header."""
    from tablework.sources.readers import read_csv

    path = _scratch(spark, "sniff")
    _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").repartition(4, "o_orderkey") \
        .write.option("sep", ";").csv(path)
    return read_csv(spark, path, lineage=False, strategy="sniff", header=False)


@query("append_positional", """
SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
""")
def append_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: appended by position, whatever the names."""
    from tablework.sinks.tables import write_table

    t = _scratch_table(spark, "positional", sf_dir)
    write_table(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t, mode="replace")
    write_table(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("id")), t,
                mode="append_positional")
    return spark.table(t)


@query("folder_as_tables", """
SELECT o_orderstatus AS folder, o_orderkey::VARCHAR AS key FROM orders
""")
def folder_as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a folder becomes a table with a unique clean name."""
    from tablework.plans.imports import import_folder_as_tables
    from tablework.sinks.tables import drop_table, ensure_database

    db = ensure_database(spark, "tablework_folder_tables")
    for t in spark.catalog.listTables(db):
        if not t.isTemporary:
            drop_table(spark, f"{db}.{t.name}")
    base = _scratch(spark, "as_tables")
    o = _t(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("key"), F.lit(status).alias("folder")) \
            .write.mode("append").option("header", "true").csv(base)
    plan = import_folder_as_tables(spark, base, db).collect()
    assert len({r.table_name for r in plan}) == len(plan) >= 3
    out = [spark.table(f"{db}.{r.table_name}").select("folder", "key") for r in plan]
    return functools.reduce(DataFrame.unionByName, out)


@query("pipeline_skips_failed_source", """
SELECT o_orderkey::VARCHAR AS id, 1::BIGINT AS n_errors FROM orders
""")
def pipeline_skips_failed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that cannot be read is recorded and the rest goes on."""
    from tablework.plans.pipeline import parse_pipeline, run_pipeline
    from tablework.sinks.tables import ensure_database

    base = _scratch(spark, "skip")
    _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).write.option("header", "true").csv(f"{base}/ok")
    doc = {"on_error": "skip", "output_table": "skip_out", "sql_query": "SELECT id FROM ok_rows",
           "sources": [{"mode": "folder", "folder_path": f"{base}/missing", "table_name": "gone", "file_pattern": "*.csv"},
                       {"mode": "folder", "folder_path": f"{base}/ok", "table_name": "ok_rows", "file_pattern": "*.csv"}]}
    res = run_pipeline(spark, parse_pipeline(doc), database=ensure_database(spark, "tablework_scratch"))
    return spark.table(res["output_table"]).withColumn("n_errors", F.lit(len(res["errors"])).cast("bigint"))


@query("result_facts", """
SELECT count(*)::BIGINT AS n, count(*) > 500 AS paged, 2::BIGINT AS n_columns FROM orders WHERE o_orderkey > 10
""")
def result_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's result, its size, whether it is paged, its columns."""
    from tablework.operators.results import columns_of, count_rows, run_sql, should_page

    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    df = run_sql(spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 10;")[0].df
    return count_rows(df).withColumn("paged", F.lit(should_page(df, 500))) \
        .withColumn("n_columns", F.lit(len(columns_of(df))).cast("bigint"))


@query("table_facts", """
SELECT 'id' AS column_name, 'bigint' AS data_type, count(*)::BIGINT AS n FROM customer
UNION ALL SELECT 'name', 'string', count(*) FROM customer
""")
def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table's listing, schema and row count."""
    from tablework.sinks.tables import list_tables, table_exists, table_schema, write_table

    t = _scratch_table(spark, "facts", sf_dir)
    write_table(_t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name")),
                t, mode="replace")
    assert table_exists(spark, t) and list(table_schema(spark, t)) == ["id", "name"]
    db, _, name = t.rpartition(".")
    listing = list_tables(spark, db).where(F.col("table_name") == name).select("column_name", "data_type")
    return listing.withColumn("n", F.lit(spark.table(t).count()).cast("bigint"))
