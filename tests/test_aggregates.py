import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablework.operators import aggregates as A
from tablework.operators import results
from tablework.sinks.tables import drop_table, ensure_database


def table(spark, n=500):
    r = random.Random(1)
    data = [(r.choice([None, "a", "b"]), r.choice([None, 1, 2, 3]), r.choice(["x", "y"]), r.choice([None, -5, 0, 7, 100_000]), r.choice([None, 10 ** 15, 3]),
             r.choice([None, "p", "q"])) for _ in range(n)]
    return spark.createDataFrame(data, "k string, g int, h string, v int, big long, s string").repartition(4)


@pytest.mark.parametrize("sets", ["cube", "rollup", [["k"], ["g", "h"], []]])
def test_grouping_sets(spark, sets):
    df = table(spark)
    fns = {"total": ("sum", "v"), "n": ("count", "*"), "nv": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v")}
    cols = [F.col(c) for c in "kgh"]
    plain = df.cube(*cols) if sets == "cube" else df.rollup(*cols) if sets == "rollup" else df.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    want = plain.agg(F.grouping_id().alias("id"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"), F.min("v").alias("lo"),
                     F.max("v").alias("hi"), F.avg("v").alias("mean"))
    got = A.grouping_sets(df, ["k", "g", "h"], fns, sets, "id")
    assert got.columns == want.columns and rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.rindex("HashAggregate")  # a plan is printed from its end: there is an aggregate below


def test_distinct_counts(spark):
    df = table(spark)
    cols = ["v", "big", "s", "g"]
    want = df.groupBy("k").agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])
    got = A.distinct_counts(df, ["k"], cols)
    assert rows(got) == rows(want)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(A.distinct_counts(df, [], cols)) == rows(df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols]))
    wide = spark.range(200_000).select((F.col("id") % 2).alias("k"), (F.col("id") - 70_000).alias("v"))
    assert rows(A.distinct_counts(wide, ["k"], ["v"])) == [(0, 100_000), (1, 100_000)]
    assert A.distinct_counts(df.limit(0), ["k"], cols).count() == 0


def test_sketches_of_batches(spark):
    t = f"{ensure_database(spark, 'tw_test_sketch')}.kept"
    drop_table(spark, t)
    parts = [spark.range(0, 6000), spark.range(3000, 9000), spark.range(8000, 20_000)]
    for i, p in enumerate(parts):
        for _ in range(2 if i == 1 else 1):  # a batch that is run again counts once
            A.keep_sketches(p.select((F.col("id") % 2).alias("k"), "id"), t, i, ["k"], ["id"], ["id"])
    whole = A.from_sketches(spark.table(t), [], ["id"], {"id": [0.5]}).first()
    assert whole["n_rows"] == 24_000 and abs(whole["distinct_id"] / 20_000 - 1) < 0.04
    exact = sorted(x for lo, hi in ((0, 6000), (3000, 9000), (8000, 20_000)) for x in range(lo, hi))
    assert abs(sum(x <= whole["id_q50"] for x in exact) / 24_000 - 0.5) < 0.03
    by_key = A.from_sketches(spark.table(t), ["k"], ["id"]).collect()
    assert len(by_key) == 2 and all(abs(r["distinct_id"] / 10_000 - 1) < 0.04 for r in by_key)


@pytest.mark.parametrize("descending", [False, True])
def test_reordered_pages(spark, descending):
    df = spark.range(1500).select("id", (F.col("id") * 7919 % 101).alias("v"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    snap = results.snapshot(df, ["id"], partitions=4)
    other = results.reorder(snap, ["v"], descending)
    assert other.total == 1500
    want = sorted(((r.v, r.id) for r in df.collect()), key=lambda x: (-x[0] if descending else x[0], x[1]))
    got = []
    for n in range(4):
        page = other.page(n, 400)
        assert "_mid" not in page.columns
        got += [(r.v, r.id, r._row) for r in page.orderBy("_row").collect()]
    assert [(v, i) for v, i, _ in got] == want and [r for *_, r in got] == list(range(1, 1501))
    assert other.page(9, 400).count() == 0
    plan = other.page(1, 20)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_mid" in plan  # the places reach the scan


def test_parquet_folder_reads_once_per_schema(spark, tmp):
    from tablework.sources.readers import parquet_schemas, read_files
    from tablework.sources.probe import list_files

    for i in range(6):
        df = spark.range(2).select((F.col("id") + i * 2).alias("id"), (F.lit(f"x{i}") if i % 2 else F.lit(i)).alias("v"))
        df.coalesce(1).write.parquet(str(tmp / f"p{i}"))
    got, _ = read_files(spark, str(tmp), "parquet", recursive=True, lineage=False)
    assert rows(got) == sorted([(i * 2 + j, f"x{i}" if i % 2 else str(i)) for i in range(6) for j in range(2)], key=lambda t: str(t[0]))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert parquet_schemas(list_files(spark, str(tmp), "*.parquet", True)).select("schema").distinct().count() == 2
