from conftest import rows, write
from tablework.operators.results import observed_write, run_sql
from tablework.operators.schema import host_type_to_sql, spark_type_for_sql, widen_type
from tablework.plans.imports import import_folder_as_tables, merge_folder_to_csv, typed_with_rejects
from tablework.sinks.tables import (create_view, drop_view, ensure_database, insert_values, truncate_table,
                                    write_table)
from tablework.sources.probe import describe_workbooks
from test_xlsx import build
from pyspark.sql import types as T


def test_type_maps_and_widening():
    assert host_type_to_sql("int8") == "TINYINT" and host_type_to_sql("int8", "sqlite") == "INTEGER"
    assert host_type_to_sql("weird") == "VARCHAR"
    assert spark_type_for_sql("DECIMAL(10,2)") == "decimal(10,2)" and spark_type_for_sql("money") == "decimal(19,4)"
    assert widen_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert widen_type(T.IntegerType(), T.DoubleType()) == T.DoubleType()
    assert widen_type(T.IntegerType(), T.StringType()) == T.StringType()
    assert widen_type(T.DecimalType(10, 2), T.IntegerType()) == T.DecimalType(22, 2)
    assert widen_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()


def test_folder_as_tables_and_merge(spark, tmp):
    write(tmp / "in", "2024 Sales.csv", "a,b\n1,2\n")
    write(tmp / "in", "select.csv", "a\n3\n")
    write(tmp / "in", "2024-sales.csv", "c\n4\n")
    db = ensure_database(spark, "tw_test_s15")
    plan = {r["file_name"]: r["table_name"] for r in import_folder_as_tables(spark, str(tmp / "in"), db).collect()}
    assert plan == {"2024 Sales.csv": "table_2024_sales", "2024-sales.csv": "table_2024_sales_1",
                    "select.csv": "tbl_select"}
    assert rows(spark.table(f"{db}.tbl_select"), ["a"]) == [("3",)]
    out = str(tmp / "merged")
    merge_folder_to_csv(spark, str(tmp / "in"), out, "create_new", lineage=False)
    merge_folder_to_csv(spark, str(tmp / "in"), out, "append", lineage=False, fill_missing="-")
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == 6 and sorted(back.columns) == ["a", "b", "c"]


def test_workbook_listing(spark, tmp):
    build(tmp)
    got = sorted((r["path"].rsplit("/", 1)[-1], r["sheet_index"], r["sheet_name"])
                 for r in describe_workbooks(spark, str(tmp)).collect())
    assert got == [("book1.xlsx", 0, "Sales"), ("book1.xlsx", 1, "Empty"), ("book1.xlsx", 2, "Extra"),
                   ("book2.xlsx", 0, "Sales")]


def test_run_sql_views_insert_truncate_metrics(spark, tmp):
    db = ensure_database(spark, "tw_test_sql")
    res = run_sql(spark, [f"CREATE TABLE IF NOT EXISTS {db}.k (a INT, b STRING) USING parquet;",
                          f"SELECT count(*) AS n FROM {db}.k"])
    assert [r.kind for r in res] == ["command", "query"] and res[1].df.first()["n"] == 0
    insert_values(spark, f"{db}.k", [("x", 1), ("y", 2)], columns=["b", "a"])
    assert rows(spark.table(f"{db}.k")) == [(1, "x"), (2, "y")]
    create_view(spark, "k_view", f"SELECT a * 10 AS a10 FROM {db}.k")
    assert rows(spark.table("k_view")) == [(10,), (20,)]
    drop_view(spark, "k_view")
    assert not spark.catalog.tableExists("k_view")
    truncate_table(spark, f"{db}.k")
    assert spark.table(f"{db}.k").count() == 0
    m = observed_write(spark.range(1000), lambda d: write_table(d, f"{db}.obs", "replace"))
    assert m["rows"] == 1000


def test_typed_with_rejects(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "2024-01-02"), (None, "nope")], "a string, d string")
    ok, rej = typed_with_rejects(df, T.StructType.fromDDL("a int, d date"))
    assert rows(ok.selectExpr("a", "CAST(d AS STRING) d")) == [(1, "2024-01-01")]
    assert rows(rej, ["a", "failed_columns"]) == [("x", "a"), (None, "d")]


def test_pipeline_validation_and_failure_policy(spark, tmp):
    import pytest
    from tablework.plans.pipeline import parse_pipeline, run_pipeline

    with pytest.raises(ValueError):
        parse_pipeline({"sources": [{"path": "/a", "table_name": "t"}, {"path": "/b", "table_name": "T"}]})
    write(tmp / "ok", "x.csv", "a\n1\n")
    doc = {"sources": [{"mode": "folder", "path": str(tmp / "missing"), "table_name": "gone"},
                       {"mode": "folder", "path": str(tmp / "ok"), "table_name": "fine"}],
           "on_error": "skip"}
    res = run_pipeline(spark, parse_pipeline(doc), database=ensure_database(spark, "tw_test_p6"))
    assert res["sources_processed"] == 1 and [e["source"] for e in res["errors"]] == ["gone"]
    doc["on_error"] = "stop"
    with pytest.raises(Exception):
        run_pipeline(spark, parse_pipeline(doc), database=ensure_database(spark, "tw_test_p6"))


def test_metadata_helpers(spark):
    from tablework.operators.results import columns_of
    from tablework.sinks.tables import table_exists, table_schema

    db = ensure_database(spark, "tw_test_meta")
    write_table(spark.createDataFrame([(1, "a")], "id int, s string"), f"{db}.m", "replace")
    assert table_exists(spark, f"{db}.m") and not table_exists(spark, f"{db}.nope")
    assert table_schema(spark, f"{db}.m") == {"id": "int", "s": "string"}
    assert columns_of(spark.table(f"{db}.m")) == [("id", "int"), ("s", "string")]


def test_merge_append_with_new_columns_rewrites(spark, tmp):
    write(tmp / "one", "a.csv", "k,v\n1,x\n")
    write(tmp / "two", "b.csv", "k,w\n2,y\n")
    out = str(tmp / "merged2")
    merge_folder_to_csv(spark, str(tmp / "one"), out, "create_new", lineage=False)
    merge_folder_to_csv(spark, str(tmp / "two"), out, "append", lineage=False)
    back = spark.read.option("header", "true").csv(out)
    assert sorted(back.columns) == ["k", "v", "w"]
    assert rows(back, ["k", "v", "w"]) == [("1", "x", None), ("2", None, "y")]
