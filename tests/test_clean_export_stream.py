import json
import os

from pyspark.sql import functions as F

from conftest import rows, write
from tablework.operators.clean import (narrow_types, quick_clean, sanitize, truncate_expr, validate)
from tablework.plans.pipeline import parse_pipeline, run_pipeline
from tablework.sinks.export import export_html, export_json, export_xml
from tablework.sinks.tables import ensure_database
from tablework.sources.synth import make_sales
from tablework.streaming.ingest import ingest_new_files


def test_sanitize_values_and_rows(spark):
    df = spark.createDataFrame(
        [("nan", "a\r\nb\rc", "x\u0000y"), ("Infinity", "-inf", None), (None, "", "NULL"),
         ("ok", "t" * 10_005, "z")], "c1 string, c2 string, c3 string")
    out = sanitize(df.toDF(" c1 ", "c1", "c3"))
    assert out.columns == ["c1", "c1_1", "c3"]
    got = rows(out)
    assert (None, "a\nb\nc", "xy") in got
    assert ("infinity", "-infinity", None) in got
    assert len(got) == 3                                  # the all-NULL row is gone
    long = [r for r in got if r[0] == "ok"][0][1]
    assert len(long) == 10_014 and long.endswith("...[truncated]")
    again = out.select(truncate_expr(F.col("c1_1")).alias("t")).where(F.col("c1") == "ok").first()["t"]
    assert again == long                                  # idempotent


def test_narrow_and_quick_clean(spark):
    df = spark.createDataFrame([("1", "1.5", "x", 300, 0.5), ("2", "2", "y", 7, 0.25)],
                               "a string, b string, c string, d int, e double")
    out, rep = narrow_types(df)
    assert dict(out.dtypes) == {"a": "tinyint", "b": "float", "c": "string", "d": "smallint", "e": "float"}
    q = quick_clean(spark.createDataFrame([(None, None), (1, None)], "` a` int, ` a ` int"))
    assert q.columns == ["a", "a_1"] and q.count() == 1


def test_validate_messages(spark):
    df = spark.createDataFrame([(1, 2)], "`1st` int, `x` int").toDF("1st", "X")
    codes = {r["code"] for r in validate(df.toDF("1st", "1st"), "t", "append", table_exists=False).collect()}
    assert {"duplicate_columns", "problem_column_names", "append_target_missing"} <= codes


def test_html_and_json_array_and_xml_exports(spark, tmp):
    df = spark.createDataFrame([(1, "<b>&'\""), (2, None)], "id int, s string")
    h = export_html(df.repartition(2), str(tmp / "h"), title="T & T")
    doc = "".join(open(os.path.join(h, f)).read() for f in sorted(os.listdir(h)) if f.endswith((".html", ".txt")))
    assert "2 rows, 2 columns" in doc
    assert doc.startswith("<!DOCTYPE html>") and doc.endswith("</html>\n")
    assert "<td>&lt;b&gt;&amp;&#39;&quot;</td>" in doc and "<td></td>" in doc
    j = export_json(df.repartition(3), str(tmp / "j"), as_array=True)
    total = []
    for f in sorted(os.listdir(j)):
        if f.startswith("part-"):
            total += json.loads(open(os.path.join(j, f)).read())
    assert sorted(r["id"] for r in total) == [1, 2] and {"id": 2, "s": None} in total
    x = export_xml(df.toDF("my id", "s-x"), str(tmp / "x"))
    back = spark.read.format("xml").option("rowTag", "row").load(x)
    assert sorted(back.columns) == ["my_id", "s_x"]
    assert spark.read.json(x + "_metadata.json").first()["n_rows"] == 2


def test_stream_ingest_only_new_files_and_drift(spark, tmp):
    db = ensure_database(spark, "tw_test_stream")
    table = f"{db}.incr"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    ck = str(tmp / "ckpt")
    write(tmp / "in", "f1.csv", "a,b\n1,x\n")
    write(tmp / "in", "f2.csv", "a,b\n2,y\n")
    assert ingest_new_files(spark, str(tmp / "in"), table, checkpoint=ck).count() == 2
    write(tmp / "in", "f3.csv", "b,c,a\nz,new,3\n")           # reordered header + new column
    out = ingest_new_files(spark, str(tmp / "in"), table, checkpoint=ck)
    assert rows(out, ["a", "b", "c"]) == [("1", "x", None), ("2", "y", None), ("3", "z", "new")]
    again = ingest_new_files(spark, str(tmp / "in"), table, checkpoint=ck)   # nothing new
    assert again.count() == 3


def test_pipeline_dialects(spark, tmp):
    write(tmp / "meters", "north.csv", "meter,day,kwh\nm1,2031-05-01,7.25\nm2,2031-05-01,1.5\n")
    write(tmp / "meters", "south.csv", "kwh,meter,day\n9.0,m1,2031-05-02\n")
    write(tmp, "places.csv", "meter_id,street\nm1,Harbour Way\n")
    doc = {"sources": [{"mode": "folder", "folder_path": str(tmp / "meters"), "table_name": "readings", "file_pattern": "*.csv"},
                       {"mode": "file", "file_path": str(tmp / "places.csv"), "table_name": "places"}],
           "sql_query": "SELECT street, count(*) AS n, max(kwh) AS top FROM readings JOIN places ON meter = meter_id GROUP BY street",
           "output_table": "usage_by_street"}
    spec = parse_pipeline(doc)
    assert [s.mode for s in spec.sources] == ["folder", "file"]
    res = run_pipeline(spark, spec, database=ensure_database(spark, "tw_test_pipe"))
    assert (res["output_rows"], res["sources_processed"]) == (1, 2)
    assert tuple(spark.table(res["output_table"]).first()) == ("Harbour Way", 2, "9.0")
    for sql, name in (("CREATE TABLE meter_copy AS SELECT * FROM m", "meter_copy"),
                      ("create table if not exists \"kept\" as select * from m", "kept"),
                      ("CREATE OR REPLACE TABLE db.t AS SELECT 1", "db.t")):
        old = parse_pipeline({"sources": [{"table_name": "m", "mode": "csv_folder", "file_type": "csv", "folder_path": "/x",
                                           "file_pattern": "*.csv"}], "sql_query": sql})
        assert old.output_table == name and old.sources[0].mode == "folder"


def test_make_sales_shape(spark):
    df = make_sales(spark, 2000, seed=1)
    assert df.count() == 2000 and len(df.columns) == 10
    shares = {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    assert shares["Completed"] > shares["Pending"] > shares["Cancelled"]
    assert len(make_sales(spark, 10, wide=False, days=365).columns) == 7
