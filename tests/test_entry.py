import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["o_orderkey", "o_orderdate", "o_totalprice", "c_name", "c_mktsegment"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["sql_group_having", "sanitize_documents", "drop_header_and_empty_rows",
                                  "clean_names_upper", "union_drift", "narrow_types"])
def test_plans_stay_in_the_jvm(spark, name):
    """No Python UDF evaluation in the cleaning / unification / SQL paths."""
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["sql_window_ranking", "join_asof", "qualify_top2"])
def test_no_single_partition_window(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_scan_prunes_columns(spark):
    df = E.queries()["sql_group_having"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double," in plan
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan


@pytest.mark.parametrize("name", ["fn_date", "fn_time", "join_asof", "join_range"])
def test_results_do_not_depend_on_session_time_zone(spark, name):
    """timestamp_ntz data: the same rows under UTC and under a zone whose
    daylight-saving switch happens at midnight."""
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "UTC")
        a = sorted(map(tuple, E.queries()[name](spark, SF_SMALL).collect()), key=repr)
        spark.conf.set(key, "America/Sao_Paulo")
        b = sorted(map(tuple, E.queries()[name](spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set(key, before)
    assert a == b


def test_folder_is_scanned_once_per_width(spark):
    df = E.queries()["folder_ingest"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 4          # five headers of four kinds, each kind read once
