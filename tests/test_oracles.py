"""A slice of the driver's correctness gate inside pytest: registered
queries against their DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tablework.sources.catalog_tables import TABLES
from tools.oracle_check import digest

SAMPLE = ["automation_enrich", "sql_group_having", "sql_window_offsets", "sql_rollup", "union_drift",
          "sanitize_documents", "narrow_types", "join_asof", "join_range", "page_by_row", "folder_ingest",
          "bad_rows_skip_long", "fn_date", "fn_string", "constraint_checks", "row_number_hot_keys"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
