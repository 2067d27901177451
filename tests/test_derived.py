"""The queries over derived files take whole tables through their path."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, write
from tablework.sinks import export
from tablework.sources.xlsx import read_excel


def by_sql(sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{SF_SMALL}/orders.parquet')")
    return sorted(con.execute(sql).fetchall(), key=str)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_orders_go_through_the_workbook(spark, monkeypatch):
    paths, write = [], export.export_excel
    monkeypatch.setattr(export, "export_excel", lambda df, path, *a: (paths.append(path), write(df, path, *a))[1])
    sql = E.oracle_sql()["xlsx_nullable_types"]
    assert held(E.queries()["xlsx_nullable_types"](spark, SF_SMALL)) == by_sql(sql)
    written = read_excel(spark, paths[0], lineage=False)[0].select("id", "big", "flag")
    assert held(written) == by_sql(sql)


def test_every_status_becomes_a_table(spark):
    out = E.queries()["folder_as_tables"](spark, SF_SMALL)
    assert held(out) == by_sql(E.oracle_sql()["folder_as_tables"])
    db = "tablework_folder_tables"
    rows = [held(spark.table(f"{db}.{t.name}").select("key", "folder")) for t in spark.catalog.listTables(db) if not t.isTemporary]
    assert sorted((r for t in rows for r in t), key=str) == by_sql("SELECT o_orderkey::VARCHAR, o_orderstatus FROM orders")


def test_a_pipeline_leaves_no_view(spark, tmp):
    from tablework.plans.pipeline import run_pipeline
    from tablework.sinks.tables import ensure_database

    write(tmp / "in", "a.csv", "id\n1\n")
    db = ensure_database(spark, "tw_test_views")
    source = {"mode": "folder", "folder_path": str(tmp / "in"), "file_pattern": "*.csv"}
    doc = {"sources": [{**source, "table_name": "kept_view"}, {**source, "table_name": "other_rows", "load": "view"}],
           "sql_query": "SELECT k.id FROM kept_view k JOIN other_rows o ON k.id = o.id", "output_table": "views_out"}
    spark.range(3).createOrReplaceTempView("kept_view")
    try:
        assert run_pipeline(spark, doc, database=db)["output_rows"] == 1
        assert spark.table("kept_view").count() == 3  # the caller's own view is back
    finally:
        spark.catalog.dropTempView("kept_view")
    before = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    run_pipeline(spark, doc, database=db)
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} == before
    with pytest.raises(Exception):
        run_pipeline(spark, {**doc, "sql_query": "SELECT nothing FROM kept_view"}, database=db)
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} == before


def test_tables_of_files_with_any_name(spark, tmp):
    from tablework.plans.imports import import_folder_as_tables
    from tablework.sinks.tables import drop_table, ensure_database

    db = ensure_database(spark, "tw_test_any_names")
    for t in spark.catalog.listTables(db):
        if not t.isTemporary:
            drop_table(spark, f"{db}.{t.name}")
    names = ["é.csv", "É.csv", "Größe 1.csv", "数据.csv", "ключ.csv", "1é.csv", "séléct.csv", "plain.csv"]
    for i, n in enumerate(names):
        write(tmp, n, f"k\n{i}\n")
    plan = {r.file_name: r.table_name for r in import_folder_as_tables(spark, str(tmp), db).collect()}
    assert set(plan) == set(names) and len(set(plan.values())) == len(names)
    assert all(re.fullmatch("[a-z][a-z0-9_]*", t) for t in plan.values())
    assert plan["plain.csv"] == "plain" and plan["séléct.csv"] == "tbl_select" and plan["1é.csv"] == "table_1e"
    for i, n in enumerate(names):
        assert [r.k for r in spark.table(f"{db}.{plan[n]}").collect()] == [str(i)]


def test_long_json_records_are_kept_compressed(spark, tmp, monkeypatch):
    """the filling of the records does not reach the disk; all of them are read."""
    from tablework.plans import derived

    monkeypatch.setattr(derived, "_scratch", lambda spark, name: str(tmp / name))
    got = {r.doc_id: r.n for r in derived.json_long_first_record(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert got == {r.doc_id: len(r.text) for r in docs.collect()}
    assert sum(f.stat().st_size for f in (tmp / "longjson").iterdir()) < 2_000 * len(got)


def test_many_headers_take_positions(spark, tmp):
    """rows of files with different headers get no map of names for each column."""
    from tablework.sources.readers import read_csv

    for i in range(40):
        write(tmp / "in", f"f{i}.csv", f"v{i},k\n{i},a{i}\n,b{i}\n")
    df = read_csv(spark, str(tmp / "in"), lineage=False)
    assert len(df.columns) == 41
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "map_from_arrays" not in plan and "BroadcastHashJoin" in plan
    got = sorted((r.k, *[(c, v) for c, v in r.asDict().items() if c != "k" and v is not None]) for r in df.collect())
    assert got == sorted([(f"a{i}", (f"v{i}", str(i))) for i in range(40)] + [(f"b{i}",) for i in range(40)])
    padded = read_csv(spark, str(tmp / "in"), lineage=False, pad_value="-", nulls="keep_empty")
    assert sorted({v for r in padded.where("k = 'b7'").collect() for v in r}) == ["", "-", "b7"]
