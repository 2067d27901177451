import pytest

from conftest import rows
from tablework.sinks.tables import (append_evolve, delete_where, drop_column, ensure_database,
                                    list_tables, schema_digest, update_where, write_table)


@pytest.fixture(scope="module")
def db(spark):
    return ensure_database(spark, "tw_test")


def test_create_replace_append(spark, db):
    t = f"{db}.t1"
    spark.sql(f"DROP TABLE IF EXISTS {t}")
    a = spark.createDataFrame([(1, "a")], "id int, s string")
    write_table(a, t, "create")
    with pytest.raises(ValueError):
        write_table(a, t, "create")
    write_table(spark.createDataFrame([(2, "b")], "id int, s string"), t, "replace")
    assert rows(spark.table(t)) == [(2, "b")]
    # replace from itself goes through staging
    write_table(spark.table(t).selectExpr("id + 1 AS id", "s"), t, "replace")
    assert rows(spark.table(t)) == [(3, "b")]


def test_append_evolve_by_name(spark, db):
    t = f"{db}.t2"
    spark.sql(f"DROP TABLE IF EXISTS {t}")
    write_table(spark.createDataFrame([(1, "a")], "id int, s string"), t, "append")
    added = append_evolve(spark.createDataFrame([("z", 2, 9.5)], "extra string, ID int, v double"), t)
    assert sorted(added) == ["extra", "v"]
    assert spark.table(t).columns == ["id", "s", "extra", "v"]
    assert rows(spark.table(t)) == [(1, "a", None, None), (2, None, "z", 9.5)]
    # wider incoming type widens the table once
    append_evolve(spark.createDataFrame([(3000000000,)], "id long"), t)
    assert dict(spark.table(t).dtypes)["id"] == "bigint"


def test_update_delete_drop_column(spark, db):
    t = f"{db}.t3"
    spark.sql(f"DROP TABLE IF EXISTS {t}")
    write_table(spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0)],
                                      "id int, s string, v double"), t)
    update_where(spark, t, {"s": "upper(s)", "v": "v * 10"}, "id >= 2")
    assert rows(spark.table(t)) == [(1, "a", 1.0), (2, "B", None), (3, None, 30.0)]
    delete_where(spark, t, "s = 'B'")                  # NULL condition keeps row 3
    assert [r[0] for r in rows(spark.table(t))] == [1, 3]
    drop_column(spark, t, "v")
    assert spark.table(t).columns == ["id", "s"]
    with pytest.raises(ValueError):
        drop_column(spark, t, "nope")


def test_listing_and_digest(spark, db):
    listing = list_tables(spark, db)
    d1 = schema_digest(listing).first()["digest"]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.t9 (a int) USING parquet")
    d2 = schema_digest(list_tables(spark, db)).first()["digest"]
    assert d1 != d2


def test_bucketed_tables_join_without_shuffle(spark, db):
    from pyspark.sql import functions as F

    a = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    b = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    write_table(a, f"{db}.ba", "replace", bucket_by=(8, ["k"]))
    write_table(b, f"{db}.bb", "replace", bucket_by=(8, ["k"]))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        j = spark.table(f"{db}.ba").join(spark.table(f"{db}.bb"), "k")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 2000
    finally:
        spark.conf.set(key, before)


def test_partitioned_update_delete_touch_only_their_partitions(spark, db):
    import os

    t = f"{db}.parted"
    spark.sql(f"DROP TABLE IF EXISTS {t}")
    df = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(12)], "id int, v string, p int")
    write_table(df, t, "replace", partition_by=["p"])
    loc = [r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {t}").collect() if r[0] == "Location"][0]
    local = loc.replace("file:", "")
    untouched = sorted(os.listdir(os.path.join(local, "p=2")))
    update_where(spark, t, {"v": "upper(v)"}, "id IN (0, 1)")          # partitions p=0 and p=1
    assert sorted(os.listdir(os.path.join(local, "p=2"))) == untouched   # p=2 files not rewritten
    got = {r["id"]: r["v"] for r in spark.table(t).collect()}
    assert got[0] == "V0" and got[1] == "V1" and got[2] == "v2" and len(got) == 12
    delete_where(spark, t, "p = 0")                                     # empties partition p=0
    assert sorted(r["p"] for r in spark.table(t).select("p").distinct().collect()) == [1, 2]
    assert spark.table(t).count() == 8
    assert [c.name for c in spark.catalog.listColumns(t) if c.isPartition] == ["p"]
    drop_column(spark, t, "v")                                          # staged rewrite keeps partitioning
    assert [c.name for c in spark.catalog.listColumns(t) if c.isPartition] == ["p"]
