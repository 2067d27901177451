"""Registered queries for the paths that skew, size and odd values need: hot
keys in windows and joins, broken and splittable files, exact round trips.
Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.plans.showcase import _scratch, _t, query

HOT_ROWS = 2_000  # a key with more rows is cut, so that the test tables take that path
_HOT = "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END"


def _hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key 0 holds a third of the rows."""
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(_HOT).alias("k"), F.col("o_orderdate").cast("date").alias("day"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


_ORDERS_SQL = f"""(SELECT o_orderkey, {_HOT} AS k, CAST(o_orderdate AS DATE) AS day,
       CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


# ------------------------------------------------------------------- windows
@query("win_ranks_hot", f"""
SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c
FROM {_ORDERS_SQL} WINDOW w AS (PARTITION BY k ORDER BY day)
""")
def win_ranks_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2-W5 where one key holds a third of the rows."""
    from tablework.operators.windows import ranked

    out = ranked(_hot_orders(spark, sf_dir), ["k"], ["day"], "r", "d", "p", "c", hot_rows=HOT_ROWS)
    return out.select("o_orderkey", F.col("r").cast("bigint").alias("r"), F.col("d").cast("bigint").alias("d"),
                      F.round("p", 9).alias("p"), F.round("c", 9).alias("c"))


@query("win_ntile_hot", f"""
SELECT o_orderkey, row_number() OVER w AS n, ntile(10) OVER w AS tile
FROM {_ORDERS_SQL} WINDOW w AS (PARTITION BY k ORDER BY cents DESC, o_orderkey DESC)
""")
def win_ntile_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W6 on a hot key, descending."""
    from tablework.operators.windows import numbered

    out = numbered(_hot_orders(spark, sf_dir), ["k"], ["-cents", "-o_orderkey"], "n", {"tile": 10}, hot_rows=HOT_ROWS)
    return out.select("o_orderkey", "n", F.col("tile").cast("bigint").alias("tile"))


@query("win_lag_lead_hot", f"""
SELECT o_orderkey, lag(o_orderkey, 2) OVER w AS two_back, lead(cents) OVER w AS next_cents
FROM {_ORDERS_SQL} WINDOW w AS (PARTITION BY k ORDER BY day, o_orderkey)
""")
def win_lag_lead_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, W8 on a hot key."""
    from tablework.operators.windows import framed

    return framed(_hot_orders(spark, sf_dir), ["k"], ["day", "o_orderkey"], {
        "two_back": lambda w: F.lag("o_orderkey", 2).over(w), "next_cents": lambda w: F.lead("cents").over(w)},
        before=2, after=1, hot_rows=HOT_ROWS).select("o_orderkey", "two_back", "next_cents")


@query("win_running_hot", f"""
SELECT o_orderkey, CAST(sum(cents) OVER w AS BIGINT) AS total, count(*) OVER w AS n, min(cents) OVER w AS low, max(cents) OVER w AS high
FROM {_ORDERS_SQL} WINDOW w AS (PARTITION BY k ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def win_running_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12 running aggregates on a hot key."""
    from tablework.operators.windows import running

    return running(_hot_orders(spark, sf_dir), ["k"], ["day", "o_orderkey"], {
        "total": ("sum", "cents"), "n": ("count", "cents"), "low": ("min", "cents"), "high": ("max", "cents")},
        hot_rows=HOT_ROWS).select("o_orderkey", "total", "n", "low", "high")


@query("win_sliding_hot", f"""
SELECT o_orderkey, CAST(sum(cents) OVER w AS BIGINT) AS around, count(*) OVER w AS n
FROM {_ORDERS_SQL} WINDOW w AS (PARTITION BY k ORDER BY day, o_orderkey ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING)
""")
def win_sliding_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12 sliding frame on a hot key."""
    from tablework.operators.windows import framed

    return framed(_hot_orders(spark, sf_dir), ["k"], ["day", "o_orderkey"], {
        "around": lambda w: F.sum("cents").over(w.rowsBetween(-5, 2)), "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-5, 2))},
        before=5, after=2, hot_rows=HOT_ROWS).select("o_orderkey", "around", "n")


@query("win_range_hot", f"""
SELECT o_orderkey, CAST(sum(cents) OVER w AS BIGINT) AS around, count(cents) OVER w AS n
FROM (SELECT *, datediff('day', DATE '1970-01-01', day) AS d FROM {_ORDERS_SQL})
WINDOW w AS (PARTITION BY k ORDER BY d RANGE BETWEEN 30 PRECEDING AND 7 FOLLOWING)
""")
def win_range_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13 on a hot key."""
    from tablework.operators.windows import ranged

    o = _hot_orders(spark, sf_dir).withColumn("d", F.unix_date("day"))
    return ranged(o, ["k"], "d", {"around": ("sum", "cents"), "n": ("count", "cents")}, 30, 7, hot_rows=HOT_ROWS) \
        .select("o_orderkey", "around", "n")


# --------------------------------------------------------------------- joins
_LATE = "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 1999 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE ts END"


@query("join_asof_nulls", f"""
WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k, event_type, {_LATE} AS tm FROM events)
SELECT p.event_id, p.k, c.tm AS r_tm
FROM (SELECT * FROM e WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click' AND tm IS NOT NULL) c ON p.k = c.k AND p.tm >= c.tm
""")
def join_asof_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: NULL times match nothing, a hot key is cut, stray early rows do not matter."""
    from tablework.operators.joins import asof_join

    e = _t(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("k"), "event_type",
        F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 1999 == 0, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("ts").cast("timestamp_ntz")).alias("tm"))
    buys, clicks = (e.where(F.col("event_type") == t).drop("event_type") for t in ("purchase", "click"))
    return asof_join(buys, clicks, ["k"], "tm", "tm", how="left", hot_rows=HOT_ROWS).select("event_id", "k", "r_tm")


_SPAN = "CASE WHEN o_orderkey % 1000 = 0 THEN 100000 WHEN o_orderkey % 7 = 0 THEN 40 ELSE o_orderkey % 3 END"


@query("join_range_lengths", f"""
SELECT o.o_orderkey, count(s.s_suppkey) AS n
FROM orders o LEFT JOIN supplier s ON s.s_suppkey BETWEEN o.o_custkey AND o.o_custkey + {_SPAN}
GROUP BY o.o_orderkey
""")
def join_range_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15 with intervals of very different lengths."""
    from tablework.operators.joins import range_join

    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.expr(_SPAN)).alias("hi"))
    hits = range_join(_t(spark, sf_dir, "supplier").select("s_suppkey"), o, "s_suppkey", "lo", "hi")
    counts = hits.groupBy("o_orderkey").agg(F.count("s_suppkey").alias("n"))
    return o.select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


# --------------------------------------------------------------------- files
@query("json_broken_isolated", """
SELECT o_orderkey, o_orderstatus, TRUE AS reported FROM orders
""")
def json_broken_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files that are cut off are left out and reported; the others are read."""
    from tablework.sinks.export import export_json
    from tablework.sources.readers import read_files

    base = _scratch(spark, "json_broken")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    export_json(o.repartition(4, "o_orderkey"), f"{base}/good", as_array=True)
    cut = o.select(F.concat(F.lit("{"), F.to_json(F.struct("o_orderkey")), F.lit(",")).alias("value"))
    cut.write.text(f"{base}/cut")
    df, res = read_files(spark, base, "json", pattern="*.{json,txt}", recursive=True, lineage=False)
    bad = [f for f in res.rejected_files if "/cut/" in f["path"]]
    return df.select("o_orderkey", "o_orderstatus").withColumn("reported", F.lit(0 < len(bad) == len(res.rejected_files)))


@query("json_array_splits", """
SELECT doc_id, text, lang FROM documents
""")
def json_array_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: arrays of objects are read by their elements, whatever the texts hold."""
    from tablework.sinks.export import export_json
    from tablework.sources.readers import read_json

    path = _scratch(spark, "json_splits")
    export_json(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, as_array=True)
    return read_json(spark, path, pattern="*.txt", lineage=False).select("doc_id", "text", "lang")


@query("folder_names_unicode", """
SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status FROM orders
""")
def folder_names_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files of any name become tables."""
    import functools

    from tablework.plans.imports import import_folder_as_tables
    from tablework.sinks.tables import drop_table, ensure_database

    db = ensure_database(spark, "tablework_unicode_tables")
    for t in spark.catalog.listTables(db):
        if not t.isTemporary:
            drop_table(spark, f"{db}.{t.name}")
    base = _scratch(spark, "unicode")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(f"{base}/all"))
    for status, name in (("F", "é"), ("O", "Größe"), ("P", "数据")):
        _t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status) \
            .select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).write.option("header", "true").csv(f"{base}/{status}")
        for i, f in enumerate(fs.globStatus(jvm.Path(f"{base}/{status}/part-*"))):
            fs.rename(f.getPath(), jvm.Path(f"{base}/all/{name} {i}.csv"))
    plan = import_folder_as_tables(spark, f"{base}/all", db).collect()
    return functools.reduce(DataFrame.unionByName, [spark.table(f"{db}.{r.table_name}").select("key", "status") for r in plan])


@query("xlsx_null_times", """
SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS at,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'Infinity' WHEN o_orderkey % 11 = 0 THEN '-Infinity'
            ELSE (o_orderkey % 100 / 4.0)::DOUBLE::VARCHAR END AS x
FROM orders
""")
def xlsx_null_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL times are empty cells, infinities are text cells."""
    from tablework.sinks.export import dealt, export_excel
    from tablework.sources.xlsx import read_excel

    path = _scratch(spark, "xlsx_times")
    k = F.col("o_orderkey")
    x = F.when(k % 5 == 0, None).when(k % 7 == 0, float("inf")).when(k % 11 == 0, float("-inf")).otherwise((k % 100) / 4.0)
    o = _t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("at"), x.alias("x"))
    export_excel(dealt(o), path).collect()
    return read_excel(spark, path, lineage=False)[0].select("id", "at", "x")


# -------------------------------------------------------------------- values
@query("fn_truncate_extremes", """
SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN 'inf' WHEN abs(v) >= 1e15 THEN 'big ' || (v = w)
       ELSE CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR) END AS whole
FROM (SELECT *, v AS w FROM (SELECT l_orderkey, l_linenumber,
      CASE l_linenumber WHEN 1 THEN l_orderkey * 1e19::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN -l_extendedprice::DOUBLE
      WHEN 5 THEN NULL ELSE l_extendedprice::DOUBLE END AS v FROM lineitem))
""")
def fn_truncate_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FM6/FM7: numbers beyond 2^53, NaN and infinities stay as they are."""
    from tablework.functions import compat as X

    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("double")
    v = F.when(n == 1, F.col("l_orderkey") * 1e19).when(n == 2, float("nan")).when(n == 3, float("inf")).when(n == 4, -price).when(n == 5, None).otherwise(price)
    t, same = X.trunc_number("v"), X.trunc_number("v", 1)

    def text(x: Column) -> Column:
        return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf") \
            .when(F.abs(x) >= 1e15, F.concat(F.lit("big "), ((x == F.col("v")) & (same == F.col("v"))).cast("string"))) \
            .otherwise(x.try_cast("bigint").cast("string"))

    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")) \
        .select("l_orderkey", "l_linenumber", text(t).alias("whole"))


_UNITS = ("millennium", "century", "decade", "year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")


@query("fn_date_trunc_units", f"""
SELECT event_id, {', '.join(f"strftime(date_trunc('{u}', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS to_{u}" for u in _UNITS)},
       strftime(ts, '%H:%M:%S.%f') AS clock
FROM (SELECT event_id, ts + to_microseconds(event_id * 1234567) AS ts FROM events)
""")
def fn_date_trunc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FD13 for every unit, FD9 as a TIME value (both shown as text)."""
    from tablework.functions import compat as X

    ts = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id").cast("decimal(20,0)") * 1234567 / 1000000).cast("decimal(18,6)"))

    def text(c: Column) -> Column:  # six places of a second, whatever the value has
        return F.concat(X.ntz_text(c), F.lit("."), F.lpad((X.epoch_micros(c) % 1_000_000).cast("string"), 6, "0"))

    clock = X.time_value("ts").cast("string")
    return _t(spark, sf_dir, "events").select("event_id", ts.alias("ts")).select(
        "event_id", *[text(X.date_trunc_ntz(u, "ts")).alias(f"to_{u}") for u in _UNITS],
        F.concat(F.substring(clock, 1, 8), F.lit("."), F.rpad(F.substring(clock, 10, 6), 6, "0")).alias("clock"))


@query("narrow_trailing_zeros", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '1.10' ELSE '1.1' END AS mixed, (p_partkey % 1000 + 0.50)::DECIMAL(5, 2)::VARCHAR AS price,
       (p_partkey % 8 / 8.0)::DOUBLE AS eighths
FROM part
""")
def narrow_trailing_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a number would not give back stay text, fixed decimals become DECIMAL."""
    from tablework.operators.clean import narrow_types

    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 2 == 0, "1.10").otherwise("1.1").alias("mixed"),
        (k % 1000 + F.lit(0.5)).cast("decimal(5,2)").cast("string").alias("price"), ((k % 8) / 8.0).cast("string").alias("eighths"))
    got, _ = narrow_types(p)
    types = dict(got.dtypes)
    assert types["price"].startswith("decimal") and types["eighths"] in ("float", "double"), types
    return got.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "mixed", F.col("price").cast("string").alias("price"),
                      F.col("eighths").cast("double").alias("eighths"))


# ------------------------------------------------- one scan, one group, one place
@query("parquet_two_schemas", """
SELECT o_orderkey AS k, o_custkey::VARCHAR AS v FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'
""")
def parquet_two_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two conflicting schemas are two scans, however many they are."""
    from tablework.sources.readers import read_parquet

    base = _scratch(spark, "two_schemas")
    o = _t(spark, sf_dir, "orders").repartition(8, "o_orderkey")
    o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v")).write.parquet(f"{base}/a")
    o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v")).write.parquet(f"{base}/b")
    return read_parquet(spark, base, recursive=True, lineage=False).select("k", "v")


@query("group_cube_two_steps", f"""
SELECT k3, status, year, grouping_id(k3, status, year)::BIGINT AS id, sum(cents)::BIGINT AS total, count(*) AS n, min(cents) AS low, max(cents) AS high,
       round(avg(cents), 6) AS mean
FROM (SELECT o.k % 3 AS k3, nullif(s.o_orderstatus, 'P') AS status, year(o.day)::BIGINT AS year, o.cents
      FROM {_ORDERS_SQL} o JOIN orders s ON s.o_orderkey = o.o_orderkey)
GROUP BY CUBE (k3, status, year)
""")
def group_cube_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18: CUBE where only the finest groups are copied for the grouping sets."""
    from tablework.operators.aggregates import grouping_sets

    o = _t(spark, sf_dir, "orders").select(
        (F.expr(_HOT) % 3).alias("k3"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.year("o_orderdate").cast("bigint").alias("year"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    out = grouping_sets(o, ["k3", "status", "year"], {
        "total": ("sum", "cents"), "n": ("count", "*"), "low": ("min", "cents"), "high": ("max", "cents"), "mean": ("avg", "cents")}, "cube", "id")
    return out.withColumn("mean", F.round("mean", 6))


@query("agg_distinct_many", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey,
       count(DISTINCT l_shipdate) AS n_l_shipdate, count(DISTINCT l_extendedprice) AS n_l_extendedprice
FROM lineitem GROUP BY l_returnflag
""")
def agg_distinct_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several exact distinct counts without copying the rows."""
    from tablework.operators.aggregates import distinct_counts

    return distinct_counts(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])


@query("agg_sketches_kept", """
SELECT o_orderpriority, count(*) AS n_rows, TRUE AS distinct_near, TRUE AS median_near FROM orders GROUP BY o_orderpriority
""")
def agg_sketches_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept for each ingested batch, merged and held against the
    exact values: distinct counts within 5 %, the median's rank within 3 %."""
    from tablework.operators.aggregates import from_sketches, keep_sketches
    from tablework.plans.showcase import _scratch_table
    from tablework.sinks.tables import drop_table

    t = _scratch_table(spark, "order_sketches", sf_dir)
    drop_table(spark, t)
    o = _t(spark, sf_dir, "orders")
    for i, status in enumerate(("F", "O", "P")):
        keep_sketches(o.where(F.col("o_orderstatus") == status), t, i, ["o_orderpriority"], ["o_custkey"], ["o_totalprice"])
    near = from_sketches(spark.table(t), ["o_orderpriority"], ["o_custkey"], {"o_totalprice": [0.5]})
    exact = o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("exact"))
    below = o.join(near.select("o_orderpriority", F.col("o_totalprice_q50").alias("m")), "o_orderpriority").groupBy("o_orderpriority") \
        .agg(F.avg((F.col("o_totalprice") <= F.col("m")).cast("int")).alias("rank"))
    return near.join(exact, "o_orderpriority").join(below, "o_orderpriority").select(
        "o_orderpriority", "n_rows", (F.abs(F.col("distinct_o_custkey") / F.col("exact") - 1) <= 0.05).alias("distinct_near"),
        (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_near"))


@query("page_other_order", f"""
SELECT o_orderkey, k, day, cents, _row FROM (SELECT *, row_number() OVER (ORDER BY cents DESC, o_orderkey) AS _row FROM {_ORDERS_SQL})
WHERE _row BETWEEN 3001 AND 4000
""")
def page_other_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of a snapshot in another order, by an index over it."""
    from tablework.operators.results import reorder, snapshot

    snap = snapshot(_hot_orders(spark, sf_dir), ["o_orderkey"])
    return reorder(snap, ["cents"], descending=True).page(3, 1000).select("o_orderkey", "k", "day", "cents", "_row")


# ------------------------------------------------------------ workbooks, names, tables
def _order_books(spark: SparkSession, sf_dir: str, name: str) -> str:
    from tablework.sinks.export import dealt, export_excel

    path = _scratch(spark, name)
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    export_excel(dealt(o, 3), path).collect()
    return path


@query("xlsx_sheet_by_name", """
SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS s, way FROM orders, (VALUES ('named'), ('fallback')) w(way)
""")
def xlsx_sheet_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet by its name, and the first one where there is none of that name."""
    from tablework.sources.xlsx import read_excel

    path = _order_books(spark, sf_dir, "xlsx_named")
    named, _ = read_excel(spark, path, sheet="Query Results", lineage=False)
    fallback, _ = read_excel(spark, path, sheet="no such sheet", lineage=False)
    return named.select("k", "s", F.lit("named").alias("way")).unionByName(fallback.select("k", "s", F.lit("fallback").alias("way")))


@query("xlsx_folder_with_xls", """
SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS s, 'rejected' AS xls FROM orders
""")
def xlsx_folder_with_xls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An .xls file beside the workbooks is reported, not dropped silently."""
    from tablework.sources.xlsx import read_excel

    path = _order_books(spark, sf_dir, "xlsx_xls")
    spark.range(1).select(F.lit("BIFF").alias("value")).coalesce(1).write.text(f"{path}_old")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(fs.globStatus(jvm.Path(f"{path}_old/part-*"))[0].getPath(), jvm.Path(f"{path}/old.xls"))
    df, res = read_excel(spark, path, lineage=False)
    status = {f["file_name"]: f["status"] for f in res.rejected_files}["old.xls"]
    return df.select("k", "s").withColumn("xls", F.lit(status))


@query("xlsx_sheet_names", """
SELECT o_orderkey::VARCHAR AS k, 'Query Results' AS sheet FROM orders
""")
def xlsx_sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of all workbooks of a folder, matched to the rows read from them."""
    from tablework.sources.probe import describe_workbooks
    from tablework.sources.xlsx import read_excel

    path = _order_books(spark, sf_dir, "xlsx_listed")
    sheets = describe_workbooks(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("_source_file"), F.col("sheet_name").alias("sheet"))
    # a few sheets, each with many rows: the rows stay where they are
    return read_excel(spark, path)[0].join(F.broadcast(sheets), "_source_file").select("k", "sheet")


@query("missing_columns_diff", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
""")
def missing_columns_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a frame that a table lacks."""
    from tablework.operators.schema import missing_columns
    from tablework.plans.showcase import _scratch_table
    from tablework.sinks.tables import write_table

    t = _scratch_table(spark, "missing_columns", sf_dir)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    write_table(o.select(F.col("o_orderkey").alias("O_ORDERKEY"), "o_custkey"), t, mode="replace")
    return spark.table(t).select(F.col("O_ORDERKEY").alias("o_orderkey")).join(
        o.select("o_orderkey", *missing_columns(spark.table(t).schema, o)), "o_orderkey")


@query("host_types", """
SELECT o_orderkey, o_totalprice::DOUBLE AS price, o_orderstatus AS status, o_orderdate::TIMESTAMP AS placed, o_orderkey % 2 = 0 AS even FROM orders
""")
def host_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts get the types that data-frame type names stand for."""
    from tablework.operators.schema import host_type_to_sql, spark_type_for_sql

    texts = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").cast("string").alias("placed"), (F.col("o_orderkey") % 2 == 0).cast("string").alias("even"))
    host = {"o_orderkey": "int64", "price": "float64", "status": "object", "placed": "datetime64[ns]", "even": "bool"}
    kinds = {c: spark_type_for_sql(host_type_to_sql(h)) for c, h in host.items()}
    return texts.select(*[F.col(c).cast("timestamp_ntz" if k == "timestamp" else k).alias(c) for c, k in kinds.items()])


@query("quick_clean_orders", """
SELECT o_orderkey AS key, o_orderstatus AS col_1, o_custkey AS key_1 FROM orders WHERE o_orderkey % 5 <> 0
""")
def quick_clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, generated and unique names; rows without a value go."""
    from tablework.operators.clean import quick_clean

    kept = F.col("o_orderkey") % 5 != 0  # the other rows hold NULLs only
    o = _t(spark, sf_dir, "orders").select(*[F.when(kept, F.col(c)).alias(c) for c in ("o_orderkey", "o_orderstatus", "o_custkey")])
    return quick_clean(o.toDF("  key ", "  ", "key"))


@query("schema_digest_changes", """
SELECT o_orderkey, TRUE AS same, TRUE AS changed FROM orders
""")
def schema_digest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest stays while a schema stays, and changes with a column."""
    from tablework.plans.showcase import _scratch_table
    from tablework.sinks.tables import list_tables, schema_digest, write_table

    t = _scratch_table(spark, "digest", sf_dir)
    db, _, name = t.rpartition(".")

    def digest() -> str:
        return schema_digest(list_tables(spark, db).where(F.col("table_name") == name)).first()[0]

    o = _t(spark, sf_dir, "orders")
    write_table(o.select("o_orderkey"), t, mode="replace")
    first, second = digest(), digest()
    write_table(o.select("o_orderkey", "o_custkey").limit(0), t, mode="append_evolve")
    third = digest()
    return spark.table(t).select("o_orderkey", F.lit(first == second).alias("same"), F.lit(third != first).alias("changed"))


@query("pipeline_unique_names", """
SELECT o_orderkey::VARCHAR AS id, TRUE AS refused FROM orders
""")
def pipeline_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of one table name are refused before anything is loaded."""
    from tablework.plans.pipeline import parse_pipeline, run_pipeline
    from tablework.sinks.tables import ensure_database

    base = _scratch(spark, "unique_names")
    _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).write.option("header", "true").csv(f"{base}/in")
    source = {"mode": "folder", "folder_path": f"{base}/in", "file_pattern": "*.csv"}
    doc = {"output_table": "unique_names_out", "sql_query": "SELECT id FROM first_rows", "sources": [{**source, "table_name": "first_rows"}]}
    try:
        parse_pipeline({**doc, "sources": [*doc["sources"], {**source, "table_name": "FIRST_ROWS"}]})
        refused = False
    except ValueError:
        refused = True
    res = run_pipeline(spark, doc, database=ensure_database(spark, "tablework_scratch"))
    return spark.table(res["output_table"]).withColumn("refused", F.lit(refused))


@query("fn_current_time", """
SELECT o_orderkey, TRUE AS is_now FROM orders
""")
def fn_current_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FD3: CURRENT_TIME is the statement's time of day, of the TIME type."""
    from tablework.functions import compat as X

    same = F.substring(F.current_time().cast("string"), 1, 8) == F.substring(X.time_value(F.localtimestamp()).cast("string"), 1, 8)
    return _t(spark, sf_dir, "orders").select("o_orderkey", same.alias("is_now"))
