"""Registered queries over the driver's tables for the library operators.

Every query reads the given tables (or files Spark writes from them into the
shared scratch folder) so its work grows with the data.  ``ORACLES`` holds
the DuckDB SQL producing the same rows; queries without an oracle are
checked for row counts only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablework.plans.pipeline import parse_pipeline, run_pipeline
from tablework.session import apply_runtime_conf
from tablework.sinks.tables import ensure_database
from tablework.sources.catalog_tables import TABLES, register, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SCRATCH_DB = "tablework_scratch"


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def run_surface_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    apply_runtime_conf(spark)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql, re.IGNORECASE)]
    register(spark, sf_dir, used)
    return spark.sql(sql)


# ----------------------------------------------------------------- P1 / K16
ENRICH_SQL = """
SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice, c.c_name, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate >= '1998-01-01'
"""


@query("automation_enrich", ENRICH_SQL.replace("'1998-01-01'", "TIMESTAMP '1998-01-01 00:00:00'"))
def automation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """README workflow: two sources, LEFT JOIN + date filter, output table."""
    db = ensure_database(spark, SCRATCH_DB)
    doc = {
        "sources": [
            {"mode": "file", "file_path": table_path(sf_dir, "orders"), "table_name": "orders",
             "file_type": "parquet", "load": "view"},
            {"mode": "file", "file_path": table_path(sf_dir, "customer"), "table_name": "customer",
             "file_type": "parquet", "load": "view"},
        ],
        "sql_query": ENRICH_SQL,
        "output_table": f"enriched_orders_{_dir_tag(sf_dir)}",
    }
    res = run_pipeline(spark, parse_pipeline(doc), database=db)
    return spark.table(res["output_table"])


# ----------------------------------------------------------------- §2.10 functions
def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_runtime_conf(spark)
    return spark.read.parquet(table_path(sf_dir, name))


@query("fn_string", """
SELECT p_partkey,
  concat(p_name, '|', p_brand) AS f_concat, substring(p_name, 2, 3) AS f_substring,
  substr(p_name, -3) AS f_substr, CAST(length(p_name) AS BIGINT) AS f_length,
  CAST(char_length(p_brand) AS BIGINT) AS f_char_length, upper(p_name) AS f_upper,
  lower(p_brand) AS f_lower, trim('  ' || p_name || '  ') AS f_trim,
  ltrim('  ' || p_name) AS f_ltrim, rtrim(p_name || '  ') AS f_rtrim,
  replace(p_name, 'e', 'E') AS f_replace,
  regexp_replace(p_name, '[aeiou]', '_', 'g') AS f_regexp_all,
  regexp_replace(p_name, '[aeiou]', '_') AS f_regexp_first,
  split_part(p_name, ' ', 2) AS f_split_part, CAST(position('e' IN p_name) AS BIGINT) AS f_position,
  CAST(instr(p_name, 'o') AS BIGINT) AS f_instr, left(p_name, 3) AS f_left, right(p_name, 3) AS f_right,
  reverse(p_name) AS f_reverse, repeat(p_type, 2) AS f_repeat, lpad(p_brand, 12, '*') AS f_lpad,
  rpad(p_brand, 12, '*') AS f_rpad, CAST(ascii(p_name) AS BIGINT) AS f_ascii,
  chr(65 + p_size % 26) AS f_chr, translate(p_name, 'ab', 'xy') AS f_translate,
  p_name || '/' || p_type AS f_concat_op, concat(p_name, NULL) AS f_concat_null
FROM part
""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    p = _t(spark, sf_dir, "part")
    n = F.col("p_name")
    return p.select(
        "p_partkey",
        X.concat_plain(n, F.lit("|"), "p_brand").alias("f_concat"),
        F.substring(n, 2, 3).alias("f_substring"),
        F.expr("substr(p_name, -3)").alias("f_substr"),
        F.length(n).cast("bigint").alias("f_length"),
        F.char_length("p_brand").cast("bigint").alias("f_char_length"),
        F.upper(n).alias("f_upper"), F.lower("p_brand").alias("f_lower"),
        F.trim(F.concat(F.lit("  "), n, F.lit("  "))).alias("f_trim"),
        F.ltrim(F.concat(F.lit("  "), n)).alias("f_ltrim"),
        F.rtrim(F.concat(n, F.lit("  "))).alias("f_rtrim"),
        F.replace(n, F.lit("e"), F.lit("E")).alias("f_replace"),
        X.regexp_replace_all(n, "[aeiou]", "_").alias("f_regexp_all"),
        X.regexp_replace_first(n, "[aeiou]", "_").alias("f_regexp_first"),
        F.split_part(n, F.lit(" "), F.lit(2)).alias("f_split_part"),
        F.expr("position('e' IN p_name)").cast("bigint").alias("f_position"),
        F.instr(n, "o").cast("bigint").alias("f_instr"),
        F.left(n, F.lit(3)).alias("f_left"), F.right(n, F.lit(3)).alias("f_right"),
        F.reverse(n).alias("f_reverse"), F.repeat("p_type", 2).alias("f_repeat"),
        F.lpad("p_brand", 12, "*").alias("f_lpad"), F.rpad("p_brand", 12, "*").alias("f_rpad"),
        F.ascii(n).cast("bigint").alias("f_ascii"),
        F.chr(F.lit(65) + F.col("p_size") % 26).alias("f_chr"),
        F.translate(n, "ab", "xy").alias("f_translate"),
        F.concat(n, F.lit("/"), "p_type").alias("f_concat_op"),
        X.concat_plain(n, F.lit(None).cast("string")).alias("f_concat_null"),
    )


@query("fn_initcap", """
SELECT p_partkey,
       array_to_string(list_transform(string_split(lower(p_name), ' '),
                                      lambda w: upper(w[1]) || w[2:]), ' ') AS f_initcap,
       array_to_string(list_transform(string_split(lower(p_brand || ' ' || p_type), ' '),
                                      lambda w: upper(w[1]) || w[2:]), ' ') AS f_initcap2
FROM part
""")
def fn_initcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FS24 INITCAP (the oracle spells it with a word split)."""
    from pyspark.sql import functions as F

    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.initcap("p_name").alias("f_initcap"),
        F.initcap(F.concat_ws(" ", "p_brand", "p_type")).alias("f_initcap2"))


@query("fn_string_extra")
def fn_string_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FS26 SOUNDEX: no counterpart in the oracle engine."""
    from pyspark.sql import functions as F

    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.initcap("p_name").alias("f_initcap"), F.soundex("p_name").alias("f_soundex"))


@query("fn_math", """
SELECT l_orderkey, l_linenumber, l_partkey,
  abs(l_discount - 0.05) AS f_abs, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS f_ceil,
  CAST(ceiling(l_tax * 10) AS BIGINT) AS f_ceiling, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS f_floor,
  round(sqrt(l_extendedprice), 1) AS f_round, trunc((l_discount - 0.05) * 100) AS f_trunc,
  power(l_quantity, 2) AS f_power, pow(l_tax * 10, 3) AS f_pow,
  round(sqrt(l_extendedprice), 6) AS f_sqrt, round(exp(l_discount), 6) AS f_exp,
  round(ln(l_extendedprice), 6) AS f_ln, round(log(l_extendedprice), 6) AS f_log,
  round(log10(l_quantity), 6) AS f_log10, round(sin(l_quantity), 6) AS f_sin,
  round(cos(l_quantity), 6) AS f_cos, round(tan(l_discount), 6) AS f_tan,
  round(asin(l_discount), 6) AS f_asin, round(acos(l_discount), 6) AS f_acos,
  round(atan(l_quantity), 6) AS f_atan, round(atan2(l_quantity, 2), 6) AS f_atan2,
  round(degrees(l_discount), 6) AS f_degrees, round(radians(l_quantity), 6) AS f_radians,
  round(pi(), 6) AS f_pi, CAST(sign(l_discount - 0.05) AS DOUBLE) AS f_sign, l_partkey % 7 AS f_mod,
  greatest(l_partkey, l_suppkey) AS f_greatest, least(l_partkey, l_suppkey) AS f_least,
  l_orderkey // 3 AS f_intdiv, CASE WHEN l_tax = 0 THEN NULL ELSE 1 / l_tax END AS f_safe_div,
  (l_linenumber + 1) * 2 - l_linenumber % 2 AS f_ops,
  random() BETWEEN 0 AND 1 AS f_random, CAST(l_quantity / 2 AS INTEGER) AS f_round_int
FROM lineitem
""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    li = _t(spark, sf_dir, "lineitem")
    r6 = lambda c: F.round(c, 6)
    q, d, e, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.abs(d - 0.05).alias("f_abs"), F.ceil(e / 1000).alias("f_ceil"),
        F.ceiling(t * 10).alias("f_ceiling"), F.floor(e / 1000).alias("f_floor"),
        F.round(F.sqrt(e), 1).alias("f_round"), X.trunc_number((d - 0.05) * 100).alias("f_trunc"),
        F.power(q, 2).alias("f_power"), F.pow(t * 10, 3).alias("f_pow"),
        r6(F.sqrt(e)).alias("f_sqrt"), r6(F.exp(d)).alias("f_exp"), r6(F.ln(e)).alias("f_ln"),
        r6(X.log_plain(e)).alias("f_log"), r6(F.log10(q)).alias("f_log10"),
        r6(F.sin(q)).alias("f_sin"), r6(F.cos(q)).alias("f_cos"), r6(F.tan(d)).alias("f_tan"),
        r6(F.asin(d)).alias("f_asin"), r6(F.acos(d)).alias("f_acos"), r6(F.atan(q)).alias("f_atan"),
        r6(F.atan2(q, F.lit(2.0))).alias("f_atan2"), r6(F.degrees(d)).alias("f_degrees"),
        r6(F.radians(q)).alias("f_radians"), r6(F.pi()).alias("f_pi"),
        F.signum(d - 0.05).alias("f_sign"), (F.col("l_partkey") % 7).alias("f_mod"),
        F.greatest("l_partkey", "l_suppkey").alias("f_greatest"),
        F.least("l_partkey", "l_suppkey").alias("f_least"),
        F.expr("l_orderkey div 3").alias("f_intdiv"),
        X.safe_divide(F.lit(1.0), t).alias("f_safe_div"),
        ((F.col("l_linenumber") + 1) * 2 - F.col("l_linenumber") % 2).alias("f_ops"),
        F.rand(42).between(0, 1).alias("f_random"),
        X.round_to_int(q / 2).alias("f_round_int"),
    )


@query("fn_date", """
SELECT o_orderkey,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS f_date,
  CAST(year(o_orderdate) AS BIGINT) AS f_year, CAST(month(o_orderdate) AS BIGINT) AS f_month,
  CAST(day(o_orderdate) AS BIGINT) AS f_day, CAST(quarter(o_orderdate) AS BIGINT) AS f_quarter,
  CAST(dayofyear(o_orderdate) AS BIGINT) AS f_dayofyear, CAST(week(o_orderdate) AS BIGINT) AS f_week,
  CAST(dayofweek(o_orderdate) AS BIGINT) AS f_dayofweek, CAST(weekday(o_orderdate) AS BIGINT) AS f_weekday,
  CAST(extract(month FROM o_orderdate) AS BIGINT) AS f_extract, CAST(date_part('day', o_orderdate) AS BIGINT) AS f_date_part,
  CAST(date_trunc('month', o_orderdate) AS VARCHAR) AS f_date_trunc,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE)::VARCHAR AS f_date_add,
  CAST(CAST(o_orderdate AS DATE) - 3 AS VARCHAR) AS f_date_sub,
  datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS f_datediff,
  CAST(o_orderdate + INTERVAL 1 MONTH AS VARCHAR) AS f_dateadd,
  CAST(last_day(o_orderdate) AS VARCHAR) AS f_last_day,
  datediff('day', TIMESTAMP '1990-01-01 00:00:00', o_orderdate) AS f_age_days,
  strftime(o_orderdate, '%Y-%m-%d') AS f_to_char,
  CAST(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS VARCHAR) AS f_parse_datetime,
  CAST(TRY_CAST(strftime(o_orderdate, '%Y') || '-01-01' AS DATE) AS VARCHAR) AS f_parse_date,
  CAST(TRY_CAST(o_orderpriority AS DATE) AS VARCHAR) AS f_parse_bad,
  CAST(CAST('2024-01-07 01:02:03' AS TIMESTAMP) AS VARCHAR) AS f_datetime,
  CAST(o_orderdate + INTERVAL 90 MINUTE AS VARCHAR) AS f_to_timestamp
FROM orders
""")
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    o = _t(spark, sf_dir, "orders")
    ts = F.col("o_orderdate")
    d = ts.cast("date")
    big = lambda c: c.cast("bigint")
    return o.select(
        "o_orderkey",
        d.cast("string").alias("f_date"),
        big(F.year(ts)).alias("f_year"), big(F.month(ts)).alias("f_month"),
        big(F.day(ts)).alias("f_day"), big(F.quarter(ts)).alias("f_quarter"),
        big(F.dayofyear(ts)).alias("f_dayofyear"), big(F.weekofyear(ts)).alias("f_week"),
        big(X.dayofweek0(ts)).alias("f_dayofweek"), big(X.dayofweek0(ts)).alias("f_weekday"),
        big(F.extract(F.lit("MONTH"), ts)).alias("f_extract"),
        big(F.date_part(F.lit("DAY"), ts)).alias("f_date_part"),
        X.month_start(ts).cast("string").alias("f_date_trunc"),
        F.date_add(d, 3).cast("string").alias("f_date_add"),
        F.date_sub(d, 3).cast("string").alias("f_date_sub"),
        big(F.datediff(d, F.lit("1995-01-01").cast("date"))).alias("f_datediff"),
        F.expr("dateadd(MONTH, 1, o_orderdate)").cast("string").alias("f_dateadd"),
        F.last_day(ts).cast("string").alias("f_last_day"),
        X.age_days(ts, "1990-01-01 00:00:00").alias("f_age_days"),
        F.to_char(ts.cast("date"), F.lit("yyyy-MM-dd")).alias("f_to_char"),
        X.parse_datetime(X.ntz_text(ts)).cast("string").alias("f_parse_datetime"),
        F.call_function("try_to_date", F.year(ts).cast("string"), F.lit("yyyy")).cast("string")
        .alias("f_parse_date"),
        F.call_function("try_to_date", F.col("o_orderpriority")).cast("string").alias("f_parse_bad"),
        F.lit("2024-01-07 01:02:03").cast("timestamp_ntz").cast("string").alias("f_datetime"),
        X.parse_datetime(F.concat(X.ntz_text(ts).substr(1, 11), F.lit("01:30:00"))).cast("string")
        .alias("f_to_timestamp"),
    )


@query("fn_time", """
SELECT event_id,
  CAST(hour(ts) AS BIGINT) AS f_hour, CAST(minute(ts) AS BIGINT) AS f_minute,
  CAST(second(ts) AS BIGINT) AS f_second, microsecond(ts) AS f_microsecond,
  strftime(ts, '%H:%M:%S') AS f_time,
  CAST(epoch_us(ts) AS BIGINT) AS f_epoch_us,
  strftime(to_timestamp(event_id * 86400), '%Y-%m-%d %H:%M:%S') AS f_from_unixtime
FROM events
""")
def fn_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    e = _t(spark, sf_dir, "events")
    ts = F.col("ts")
    return e.select(
        "event_id",
        F.hour(ts).cast("bigint").alias("f_hour"), F.minute(ts).cast("bigint").alias("f_minute"),
        F.second(ts).cast("bigint").alias("f_second"), X.microsecond(ts).alias("f_microsecond"),
        X.time_of_day(ts).alias("f_time"),
        X.epoch_micros(ts).alias("f_epoch_us"),
        X.ntz_text(X.from_unixtime_ntz(F.col("event_id") * 86400)).alias("f_from_unixtime"),
    )


@query("fn_cast_cond", """
SELECT c_custkey,
  CAST(c_custkey AS VARCHAR) AS f_cast, CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS f_convert,
  CAST(TRY_CAST(substr(c_name, 10) AS INTEGER) AS VARCHAR) AS f_try_cast,
  CAST(TRY_CAST(c_mktsegment AS INTEGER) AS VARCHAR) AS f_try_cast_bad,
  TRY_CAST('2024-01-07' AS DATE)::VARCHAR AS f_to_date,
  CAST(CAST('12.5' AS DECIMAL(3,1)) AS DOUBLE) AS f_to_number,
  coalesce(NULLIF(c_nationkey, 0), -1) AS f_coalesce, (NULLIF(c_nationkey, 0) IS NULL) AS f_isnull,
  ifnull(NULLIF(c_nationkey, 1), -1) AS f_ifnull, CAST(nullif(c_nationkey, 2) AS VARCHAR) AS f_nullif,
  coalesce(NULLIF(c_nationkey, 3), -1) AS f_nvl, if(NULLIF(c_nationkey, 4) IS NOT NULL, 1, 0) AS f_nvl2,
  CASE c_nationkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'z' END AS f_decode,
  CASE c_nationkey % 4 + 1 WHEN 1 THEN 'w' WHEN 2 THEN 'x' WHEN 3 THEN 'y' ELSE 'z' END AS f_choose,
  if(c_acctbal > 5000, 1, 0) AS f_iif,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey / c_nationkey END AS f_try_divide
FROM customer
""")
def fn_cast_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    c = _t(spark, sf_dir, "customer")
    nk = F.col("c_nationkey")
    return c.select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("f_cast"),
        F.col("c_acctbal").cast("decimal(10,2)").cast("double").alias("f_convert"),
        F.expr("try_cast(substr(c_name, 10) AS INT)").cast("string").alias("f_try_cast"),
        F.expr("try_cast(c_mktsegment AS INT)").cast("string").alias("f_try_cast_bad"),
        F.to_date(F.lit("2024-01-07")).cast("string").alias("f_to_date"),
        F.to_number(F.lit("12.5"), F.lit("99.9")).cast("double").alias("f_to_number"),
        F.coalesce(F.nullif(nk, F.lit(0)), F.lit(-1)).alias("f_coalesce"),
        F.isnull(F.nullif(nk, F.lit(0))).alias("f_isnull"),
        F.ifnull(F.nullif(nk, F.lit(1)), F.lit(-1)).alias("f_ifnull"),
        F.nullif(nk, F.lit(2)).cast("string").alias("f_nullif"),
        F.nvl(F.nullif(nk, F.lit(3)), F.lit(-1)).alias("f_nvl"),
        F.nvl2(F.nullif(nk, F.lit(4)), F.lit(1), F.lit(0)).alias("f_nvl2"),
        X.decode(nk % 4, 1, "a", 2, "b", "z").alias("f_decode"),
        X.choose(nk % 4 + 1, "w", "x", "y", "z").alias("f_choose"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("f_iif"),
        X.safe_divide(F.col("c_custkey"), nk).alias("f_try_divide"),
    )


@query("fn_json", """
SELECT event_id,
  json_extract_string(props, '$.k') AS f_json_extract,
  CAST(json_array(event_id, 2) AS VARCHAR) AS f_json_array,
  CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS f_json_object,
  array_to_string(json_keys(props), ',') AS f_json_keys,
  CAST(json_array_length('[' || props || ',1]') AS BIGINT) AS f_json_length,
  json_valid(props) AS f_json_valid,
  json_valid(event_type) AS f_json_valid_bad
FROM events
""")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    e = _t(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("f_json_extract"),
        F.to_json(F.array(F.col("event_id"), F.lit(2).cast("bigint"))).alias("f_json_array"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
        .alias("f_json_object"),
        F.array_join(F.json_object_keys("props"), ",").alias("f_json_keys"),
        F.json_array_length(F.concat(F.lit("["), F.col("props"), F.lit(",1]"))).cast("bigint")
        .alias("f_json_length"),
        X.json_valid(F.col("props")).alias("f_json_valid"),
        X.json_valid(F.col("event_type")).alias("f_json_valid_bad"),
    )


@query("fn_json_type")
def fn_json_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FJ8 JSON_TYPE: Spark names variant types differently from the oracle."""
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    return _t(spark, sf_dir, "events").select("event_id", X.json_type(F.col("props")).alias("f_json_type"))


@query("fn_array", """
SELECT vec_id,
  CAST(len(embedding) AS BIGINT) AS f_array_length,
  CAST(list_position([label, 7, label], 7) AS BIGINT) AS f_array_position,
  array_to_string(list_filter([label, 2, label], lambda v: v <> label), ',') AS f_array_remove,
  array_to_string(list_transform([label, 1, label], lambda v: if(v = label, 9, v)), ',') AS f_array_replace,
  array_to_string(list_append([1], label), ',') AS f_array_append,
  array_to_string(list_prepend(label, [1]), ',') AS f_array_prepend,
  list_contains([1, 2], label) AS f_array_contains,
  CAST(embedding[1] AS DOUBLE) AS f_first
FROM embeddings
""")
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from tablework.functions import compat as X

    e = _t(spark, sf_dir, "embeddings")
    lab = F.col("label")
    return e.select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("f_array_length"),
        F.array_position(F.array(lab, F.lit(7), lab), 7).cast("bigint").alias("f_array_position"),
        F.array_join(F.array_remove(F.array(lab, F.lit(2), lab), lab), ",").alias("f_array_remove"),
        F.array_join(X.array_replace(F.array(lab, F.lit(1), lab), lab, 9), ",").alias("f_array_replace"),
        F.array_join(F.array_append(F.array(F.lit(1)), lab), ",").alias("f_array_append"),
        F.array_join(F.array_prepend(F.array(F.lit(1)), lab), ",").alias("f_array_prepend"),
        F.array_contains(F.array(F.lit(1), F.lit(2)), lab).alias("f_array_contains"),
        F.element_at("embedding", 1).cast("double").alias("f_first"),
    )


@query("fn_unnest", """
SELECT vec_id, v, count(*) AS n FROM (SELECT vec_id, unnest([label, 9]) AS v FROM embeddings)
GROUP BY vec_id, v
""")
def fn_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    e = _t(spark, sf_dir, "embeddings")
    return (e.select("vec_id", F.explode(F.array("label", F.lit(9))).alias("v"))
            .groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")))


@query("fn_system")
def fn_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FY1-FY7 and FD1-FD7: session functions, one row per region (values are
    session-dependent, so the check is on rows only)."""
    from pyspark.sql import functions as F

    return _t(spark, sf_dir, "region").select(
        "r_regionkey",
        F.version().isNotNull().alias("has_version"), F.user().alias("user"),
        F.current_user().alias("current_user"), F.session_user().alias("session_user"),
        F.current_database().alias("database"), F.current_schema().alias("schema"),
        F.now().isNotNull().alias("has_now"), F.current_date().alias("today"),
        F.date_sub(F.current_date(), 1).alias("yesterday"), F.date_add(F.current_date(), 1).alias("tomorrow"),
        F.current_timestamp().isNotNull().alias("has_ts"),
        F.next_day(F.current_date(), "MON").alias("next_monday"),
        F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"),
                           F.current_timestamp().cast("timestamp_ntz")).alias("new_york"),
    )


# ----------------------------------------------------------------- Q15 / Q16 / Q28 / Q8
@query("join_range", """
SELECT c.event_id AS click_id, p.event_id AS purchase_id
FROM (SELECT * FROM events WHERE event_type = 'click') c
JOIN (SELECT event_id, user_id, ts AS lo, ts + INTERVAL 10 MINUTE AS hi FROM events WHERE event_type = 'purchase') p
  ON c.user_id = p.user_id AND c.ts BETWEEN p.lo AND p.hi
""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clicks within ten minutes after each purchase: a range join on time."""
    from pyspark.sql import functions as F
    from tablework.operators.joins import range_join

    ev = _t(spark, sf_dir, "events")
    clicks = ev.where(F.col("event_type") == "click").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    buys = ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("lo"),
        (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("hi"))
    return range_join(clicks, buys, "ts", "lo", "hi", on=["user_id"]).select("click_id", "purchase_id")


@query("join_asof", """
SELECT p.event_id AS purchase_id, p.user_id, c.event_id AS r_event_id, c.ts AS r_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the user's last click at or before it."""
    from pyspark.sql import functions as F
    from tablework.operators.joins import asof_join

    ev = _t(spark, sf_dir, "events")
    buys = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = ev.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    out = asof_join(buys, clicks, on=["user_id"], left_ts="ts", right_ts="ts")
    return out.select(F.col("event_id").alias("purchase_id"), "user_id", "r_event_id", "r_ts")


@query("qualify_top2", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2
""")
def qualify_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUALIFY as a skew-safe two-stage top-k per customer."""
    from pyspark.sql import functions as F
    from tablework.operators.joins import top_k_per_group

    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)


@query("qualify_filter", """
SELECT o_orderkey, o_custkey FROM orders
QUALIFY o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_custkey) * 1.5
""")
def qualify_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tablework.operators.joins import qualify

    o = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    return qualify(o, F.col("o_totalprice") > F.avg("o_totalprice").over(w) * 1.5) \
        .select("o_orderkey", "o_custkey")


@query("quantified_all_any", """
SELECT o_orderkey,
  o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'
                      AND o_totalprice < 100000) AS gt_all,
  o_totalprice < ANY (SELECT o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
                      AND o_totalprice < 20000) AS lt_any
FROM orders WHERE o_orderstatus = 'O'
""")
def quantified_all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: ``> ALL`` / ``< ANY`` rewritten to scalar subqueries."""
    from pyspark.sql import functions as F
    from tablework.functions.compat import compare_all, compare_any

    o = _t(spark, sf_dir, "orders")
    low = o.where((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")
                  & (F.col("o_totalprice") < 100000))
    urgent = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 20000))
    return o.where(F.col("o_orderstatus") == "O").select(
        "o_orderkey",
        compare_all("o_totalprice", ">", low, "o_totalprice").alias("gt_all"),
        compare_any("o_totalprice", "<", urgent, "o_totalprice").alias("lt_any"))


# ----------------------------------------------------------------- §2.4 unification
def _people(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Customers and suppliers as two drifting inputs: different column
    order, a column only one side has, lineage literal per input."""
    from pyspark.sql import functions as F

    cust = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.lit("customer.csv").alias("_source_file"))
    supp = _t(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("NAME"), F.col("s_suppkey").alias("Id"),
        F.when(F.col("s_acctbal") > 5000, "gold").otherwise("std").alias("tier"),
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"),
        F.lit("supplier.csv").alias("_source_file"))
    return [cust, supp]


_PEOPLE_SQL = """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
       c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS tier, 'customer.csv' AS _source_file
FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL,
       CASE WHEN s_acctbal > 5000 THEN 'gold' ELSE 'std' END, 'supplier.csv'
FROM supplier
"""


@query("union_drift", _PEOPLE_SQL)
def union_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name (case-insensitive), first input's order, new
    columns sorted after, lineage last, absent columns NULL."""
    from tablework.operators.schema import union_by_name

    return union_by_name(_people(spark, sf_dir), order="first_seen_then_sorted")


@query("union_fill", f"""
SELECT id, name, nation, balance, COALESCE(segment, 'n/a') AS segment, COALESCE(tier, 'n/a') AS tier,
       _source_file FROM ({_PEOPLE_SQL})
""")
def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 after U3: fill the padding with a value (typed: only text columns
    can hold 'n/a')."""
    from tablework.operators.clean import fill_missing
    from tablework.operators.schema import union_by_name

    return fill_missing(union_by_name(_people(spark, sf_dir)), "n/a")


@query("widen_union", """
SELECT p_partkey AS key, CAST(p_size AS VARCHAR) AS v, CAST(p_size AS DOUBLE) AS w, p_size AS x FROM part
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier
""")
def widen_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Int with string -> string, int with double -> double, int with
    int -> int."""
    from pyspark.sql import functions as F
    from tablework.operators.schema import union_by_name

    a = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"),
                                         F.col("p_size").alias("w"), F.col("p_size").alias("x"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("v"),
                                             F.col("s_acctbal").alias("w"), F.col("s_nationkey").alias("x"))
    return union_by_name([a, b])


@query("align_to_table", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS tier
FROM customer
""")
def align_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project an input onto an existing table's schema: extra columns
    dropped, missing ones NULL, types cast to the table's."""
    from tablework.operators.schema import align

    cust, supp = _people(spark, sf_dir)
    target = supp.select("Id", "NAME", "balance", "tier").toDF("id", "name", "balance", "tier").schema
    return align(cust, target)


# ----------------------------------------------------------------- §2.5 names and values
_AWKWARD = [("p_partkey", "Part Key"), ("p_name", "p-name!"), ("p_size", "2size"),
            ("p_brand", "Brand (#)"), ("p_type", "  type  "), ("p_retailprice", "Retail Price $"),
            ("p_name", "Prix Détail")]


def _awkward_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    p = _t(spark, sf_dir, "part")
    return p.select(*[F.col(src).alias(alias) for src, alias in _AWKWARD])


def _renamed_sql(names: list[str]) -> str:
    cols = ", ".join(f'{src} AS "{dst}"' for (src, _), dst in zip(_AWKWARD, names))
    return f"SELECT {cols} FROM part"


@query("clean_names_upper", _renamed_sql(
    ["PART_KEY", "PNAME", "_2SIZE", "BRAND_", "__TYPE__", "RETAIL_PRICE_", "PRIX_DTAIL"]))
def clean_names_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case policy."""
    from tablework.operators.names import rename_columns

    return rename_columns(_awkward_part(spark, sf_dir), "upper")


@query("clean_names_keep_case", _renamed_sql(
    ["Part_Key", "p_name", "col_2size", "Brand", "type", "Retail_Price", "Prix_Détail"]))
def clean_names_keep_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-case policy (Unicode word characters kept)."""
    from tablework.operators.names import rename_columns

    return rename_columns(_awkward_part(spark, sf_dir), "keep_case")


@query("clean_names_ascii", _renamed_sql(
    ["Part_Key", "p_name", "col_2size", "Brand", "type", "Retail_Price", "Prix_D_tail"]))
def clean_names_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII policy."""
    from tablework.operators.names import rename_columns

    return rename_columns(_awkward_part(spark, sf_dir), "ascii")


@query("dedupe_columns", """
SELECT o_orderkey AS k, o_custkey AS "K_2", o_totalprice AS k_3, o_orderstatus AS k_1 FROM orders
""")
def dedupe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive duplicate names get the first free ``_k`` suffix."""
    from tablework.operators.names import dedupe_columns as dedupe

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return dedupe(o.toDF("k", "K", "k", "k_1"))


def _sanitize_sql(v: str) -> str:
    s1 = f"CASE WHEN {v} IN ('nan', 'NaN', 'None', 'null', 'NULL', '') THEN NULL ELSE {v} END"
    s2 = (f"CASE ({s1}) WHEN 'inf' THEN 'infinity' WHEN 'Infinity' THEN 'infinity' "
          f"WHEN '-inf' THEN '-infinity' WHEN '-Infinity' THEN '-infinity' ELSE ({s1}) END")
    s3 = f"replace(replace({s2}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return (f"CASE WHEN length({s3}) > 10000 AND NOT (length({s3}) = 10014 AND suffix({s3}, '...[truncated]')) "
            f"THEN substr({s3}, 1, 10000) || '...[truncated]' ELSE {s3} END")


_DOC_TOKEN = ("CASE lang WHEN 'fr' THEN 'NULL' WHEN 'de' THEN 'Infinity' WHEN 'es' THEN '-inf' "
              "ELSE lang END")


@query("sanitize_documents", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_sanitize_sql("replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13))")} AS text,
       {_sanitize_sql(_DOC_TOKEN)} AS token, source
FROM documents
""")
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 = C10 null tokens, C11 infinity spellings, C12 CR/CRLF -> LF,
    C13 truncation at 10,000 characters, all columns to text, empty rows
    dropped - one projection and one filter, whole texts."""
    from pyspark.sql import functions as F
    from tablework.operators.clean import sanitize

    d = _t(spark, sf_dir, "documents")
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    token = (F.when(F.col("lang") == "fr", "NULL").when(F.col("lang") == "de", "Infinity")
             .when(F.col("lang") == "es", "-inf").otherwise(F.col("lang")))
    return sanitize(d.select("doc_id", text.alias("text"), token.alias("token"), "source"))


@query("truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || '...[truncated]'
                    ELSE text END AS text
FROM documents
""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 alone on whole document texts."""
    from tablework.operators.clean import truncate_texts

    return truncate_texts(_t(spark, sf_dir, "documents").select("doc_id", "text"))


_EVENT_TOKEN = ("CASE event_type WHEN 'click' THEN 'NULL' WHEN 'view' THEN 'nan' "
                "WHEN 'error' THEN 'Infinity' WHEN 'signup' THEN '-inf' ELSE event_type END")


@query("null_and_infinity_tokens", f"""
SELECT event_id,
  CASE WHEN t IN ('nan', 'NaN', 'None', 'null', 'NULL', '') THEN NULL
       WHEN t IN ('inf', 'Infinity') THEN 'infinity' WHEN t IN ('-inf', '-Infinity') THEN '-infinity'
       ELSE t END AS token,
  props
FROM (SELECT event_id, {_EVENT_TOKEN} AS t, props FROM events)
""")
def null_and_infinity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 + C11 on text columns (the token set is a parameter)."""
    from pyspark.sql import functions as F
    from tablework.operators.clean import normalize_infinity, replace_null_tokens

    e = _t(spark, sf_dir, "events")
    t = (F.when(F.col("event_type") == "click", "NULL").when(F.col("event_type") == "view", "nan")
         .when(F.col("event_type") == "error", "Infinity").when(F.col("event_type") == "signup", "-inf")
         .otherwise(F.col("event_type")))
    return normalize_infinity(replace_null_tokens(e.select("event_id", t.alias("token"), "props")))


def _headers_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text where some rows repeat the header and some are empty."""
    from pyspark.sql import functions as F

    o = _t(spark, sf_dir, "orders")
    is_header = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    is_blank = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return o.select(*[F.when(is_header, F.lit(c)).when(is_blank, F.lit(None).cast("string"))
                      .otherwise(F.col(c).cast("string")).alias(c) for c in cols])


@query("drop_header_and_empty_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, o_orderpriority
FROM orders
WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
  AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
""")
def drop_header_and_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 + C9: rows equal to the header and all-NULL rows are removed."""
    from tablework.operators.clean import drop_empty_rows, drop_header_rows

    return drop_empty_rows(drop_header_rows(_headers_and_blanks(spark, sf_dir)))


def _narrow_oracle() -> str:
    parts = []
    text_cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    for c in text_cols:
        x = f"CAST({c} AS VARCHAR)"
        is_int = f"regexp_full_match({x}, '(0|-?[1-9][0-9]{{0,18}})')"
        lng = f"CASE WHEN {is_int} THEN CAST({x} AS BIGINT) END"
        dbl = f"TRY_CAST({x} AS DOUBLE)"
        parts.append(f"""SELECT 't_{c}' AS column_name, 'string' AS from_type, count({x}) AS n_non_null,
  count({lng}) AS n_integer, count({dbl}) AS n_numeric, min({lng}) AS min_integer, max({lng}) AS max_integer,
  count(CASE WHEN CAST(CAST({dbl} AS FLOAT) AS DOUBLE) = {dbl} THEN 1 END) AS n_float_exact FROM lineitem""")
    native = [("l_linenumber", "int", True), ("l_orderkey", "bigint", True),
              ("l_quantity", "double", False), ("l_extendedprice", "double", False)]
    for c, t, integral in native:
        lng = f"CAST({c} AS BIGINT)" if integral else "CAST(NULL AS BIGINT)"
        parts.append(f"""SELECT '{c}', '{t}', count({c}), count({lng}), count(CAST({c} AS DOUBLE)),
  min({lng}), max({lng}),
  count(CASE WHEN CAST(CAST({c} AS FLOAT) AS DOUBLE) = CAST({c} AS DOUBLE) THEN 1 END) FROM lineitem""")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT column_name, from_type, n_non_null, n_integer, n_numeric,
  CAST(min_integer AS VARCHAR) AS min_integer, CAST(max_integer AS VARCHAR) AS max_integer, n_float_exact,
  CASE WHEN n_non_null = 0 THEN from_type
  WHEN n_integer = n_non_null THEN CASE WHEN min_integer >= -128 AND max_integer <= 127 THEN 'tinyint'
       WHEN min_integer >= -32768 AND max_integer <= 32767 THEN 'smallint'
       WHEN min_integer >= -2147483648 AND max_integer <= 2147483647 THEN 'int' ELSE 'bigint' END
  WHEN n_numeric = n_non_null AND n_float_exact = n_non_null THEN 'float'
  WHEN n_numeric = n_non_null THEN 'double' ELSE from_type END AS to_type
FROM ({body})"""


@query("narrow_types", _narrow_oracle())
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest lossless type per column from one aggregation."""
    from pyspark.sql import functions as F
    from tablework.operators.clean import narrow_report

    li = _t(spark, sf_dir, "lineitem")
    text_cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    df = li.select(*[F.col(c).cast("string").alias(f"t_{c}") for c in text_cols],
                   "l_linenumber", "l_orderkey", "l_quantity", "l_extendedprice")
    rep = narrow_report(df)
    return rep.withColumn("min_integer", F.col("min_integer").cast("string")) \
              .withColumn("max_integer", F.col("max_integer").cast("string"))


# ----------------------------------------------------------------- Q34 / C17 checks
@query("constraint_checks", """
SELECT 'orders_not_null' AS "check", count(*) AS n_violations FROM orders
  WHERE o_custkey IS NULL OR o_totalprice IS NULL
UNION ALL
SELECT 'lineitem_unique_key', count(*) FROM lineitem l
  WHERE (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber) > 1
UNION ALL
SELECT 'lineitem_fk_orders', count(*) FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'orders_status_domain', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL
SELECT 'lineitem_discount_check', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.08)
""")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q34: NOT NULL, UNIQUE, FOREIGN KEY, domain and CHECK as violation counts
    (conditions on single rows in one pass per table)."""
    from pyspark.sql import functions as F
    from tablework.operators import checks as C

    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    rows = C.row_summary(o, {
        "orders_not_null": F.col("o_custkey").isNull() | F.col("o_totalprice").isNull(),
        "orders_status_domain": ~F.col("o_orderstatus").isin("F", "O"),
    }).unionByName(C.row_summary(li, {"lineitem_discount_check": ~F.col("l_discount").between(0, 0.08)}))
    return rows.unionByName(C.summary({
        "lineitem_unique_key": C.unique_violations(li, ["l_orderkey", "l_linenumber"]),
        "lineitem_fk_orders": C.foreign_key_violations(li, "l_orderkey", o, "o_orderkey"),
    }))


@query("fk_orphans", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')
""")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q34/Q14: orders whose customer is not among the BUILDING customers (anti join)."""
    from pyspark.sql import functions as F
    from tablework.operators.checks import foreign_key_violations

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parents = _t(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return foreign_key_violations(o, "o_custkey", parents, "c_custkey")


@query("unique_violations", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
WHERE (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber) > 1
""")
def unique_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNIQUE (l_orderkey, l_linenumber): the rows of duplicated keys."""
    from tablework.operators.checks import unique_violations

    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return unique_violations(li, ["l_orderkey", "l_linenumber"])


@query("validate_import", """
SELECT * FROM (VALUES ('warning', 'duplicate_columns'), ('warning', 'problem_column_names'), ('error', 'append_target_missing'))
  AS v(level, code)
UNION ALL SELECT 'warning', 'large' FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 1000000
UNION ALL SELECT 'error', 'empty' FROM (SELECT count(*) AS n FROM lineitem) WHERE n = 0
UNION ALL SELECT 'error', 'empty' FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0) WHERE n = 0
""")
def validate_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: import validation messages for the lineitem table under awkward
    names (name checks are metadata; the row count is one bounded job)."""
    from tablework.operators.clean import validate

    li = _t(spark, sf_dir, "lineitem")
    df = li.toDF(*(["l orderkey", "1st", "L ORDERKEY"] + li.columns[3:]))
    none = df.where("l_quantity < 0") if "l_quantity" in df.columns else df.limit(0)
    return validate(df, "lineitem_import", mode="append", table_exists=False).select("level", "code").unionByName(
        validate(none.select(*[f"`{c}`" for c in df.columns[3:]]), "lineitem_import").select("level", "code"))


# ----------------------------------------------------------------- R2-R6 results
@query("page_by_row", """
SELECT * FROM (
  SELECT o_orderkey, o_custkey, o_totalprice,
         row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS _row FROM orders)
WHERE _row BETWEEN 2001 AND 3000
""")
def page_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 deep page over a written snapshot: rows 2001-3000 by price desc."""
    from pyspark.sql import functions as F
    from tablework.operators.results import snapshot

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    snap = snapshot(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return snap.page(2, 1000)


@query("page_shallow", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000 OFFSET 3000
""")
def page_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 shallow page: ORDER BY + OFFSET + LIMIT."""
    from pyspark.sql import functions as F
    from tablework.operators.results import shallow_page

    o = _t(spark, sf_dir, "orders")
    return shallow_page(o, [F.col("o_orderdate").desc(), "o_orderkey"], 3000, 1000) \
        .select("o_orderkey", "o_totalprice")


@query("result_count", """
SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05
""")
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2."""
    from tablework.operators.results import count_rows

    li = run_surface_sql(spark, sf_dir, "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05")
    return count_rows(li)


@query("sorted_nulls_last", """
SELECT o_orderkey, NULLIF(o_orderpriority, '3-MEDIUM') AS priority FROM orders
ORDER BY priority DESC NULLS LAST, o_orderkey
""")
def sorted_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort by one column, NULLs last."""
    from pyspark.sql import functions as F
    from tablework.operators.results import sort_result

    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("priority"))
    return sort_result(o, "priority", ascending=False)


# ----------------------------------------------------------------- K1-K7, Q29-Q31, R10-R11 tables
def _scratch_table(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A scratch table name per query and input folder, so results built
    from different scale factors never share a table."""
    return f"{ensure_database(spark, SCRATCH_DB)}.{name}_{_dir_tag(sf_dir)}"


def _dir_tag(sf_dir: str) -> str:
    import hashlib
    import re

    base = re.sub(r"[^A-Za-z0-9]+", "_", sf_dir.rstrip("/").rsplit("/", 1)[-1]).strip("_")
    return f"{base}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:6]}"


@query("table_update", """
SELECT o_orderkey,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
       o_orderpriority
FROM orders
""")
def table_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31 UPDATE on a parquet table (staged rewrite + rename)."""
    from tablework.sinks.tables import update_where, write_table

    t = _scratch_table(spark, "orders_update", sf_dir)
    src = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    write_table(src, t, mode="replace")
    update_where(spark, t, {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice * 2"},
                 "o_orderpriority = '1-URGENT'")
    return spark.table(t)


@query("table_delete", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000)
""")
def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31 DELETE on a parquet table."""
    from tablework.sinks.tables import delete_where, write_table

    t = _scratch_table(spark, "orders_delete", sf_dir)
    write_table(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), t)
    delete_where(spark, t, "o_orderstatus = 'P' AND o_totalprice < 100000")
    return spark.table(t)


@query("table_drop_column", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def table_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DROP COLUMN on parquet = staged rewrite without the column."""
    from tablework.sinks.tables import drop_column, write_table

    t = _scratch_table(spark, "customer_drop", sf_dir)
    write_table(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), t)
    drop_column(spark, t, "c_acctbal")
    return spark.table(t)


@query("table_append_evolve", """
SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part
""")
def table_append_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4/K5: append by name; new columns added with ALTER TABLE ADD COLUMNS,
    absent ones NULL, table columns keep their order."""
    from pyspark.sql import functions as F
    from tablework.sinks.tables import drop_table, write_table

    t = _scratch_table(spark, "people_evolve", sf_dir)
    drop_table(spark, t)
    write_table(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"),
                                                     F.col("c_name").alias("name")), t, mode="append")
    write_table(_t(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"),
                                                     F.col("s_suppkey").alias("id"),
                                                     F.col("s_name").alias("name")), t, mode="append")
    write_table(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"),
                                                 F.col("p_retailprice").alias("Balance")), t, mode="append")
    return spark.table(t)


@query("table_ctas_insert", """
SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT c_nationkey + 100, count(*) FROM customer GROUP BY c_nationkey
""")
def table_ctas_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q29 CREATE TABLE AS, Q30 INSERT INTO ... SELECT, K1 create-fails-if-exists."""
    from tablework.sinks.tables import drop_table, write_table

    t = _scratch_table(spark, "ctas_counts", sf_dir)
    drop_table(spark, t)
    register(spark, sf_dir, ["nation", "customer"])
    write_table(spark.sql("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"), t, mode="create")
    try:
        write_table(spark.sql("SELECT 1 AS n_regionkey, 1L AS n"), t, mode="create")
        raise AssertionError("create must fail on an existing table")
    except ValueError:
        pass
    spark.sql(f"INSERT INTO {t} SELECT c_nationkey + 100, count(*) FROM customer GROUP BY c_nationkey")
    return spark.table(t)


# ----------------------------------------------------------------- K8-K14 exports and S1-S7 reads
def _scratch(spark: SparkSession, name: str) -> str:
    from tablework.session import shared_dir

    return shared_dir(spark, "files", name)


_PART_TEXT_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice
FROM part
"""


@query("csv_roundtrip", _PART_TEXT_SQL)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 export then S1 import (probe, text mode)."""
    from tablework.sinks.export import export_csv
    from tablework.sources.readers import read_files

    path = export_csv(_t(spark, sf_dir, "part"), _scratch(spark, "csv"))
    df, _ = read_files(spark, path, "csv", lineage=False)
    return df


@query("tsv_roundtrip", _PART_TEXT_SQL)
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9 export then S2 import."""
    from tablework.sinks.export import export_tsv
    from tablework.sources.readers import read_files

    path = export_tsv(_t(spark, sf_dir, "part"), _scratch(spark, "tsv"))
    df, _ = read_files(spark, path, "csv", pattern="*.csv", lineage=False)
    return df


@query("json_roundtrip", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part
""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 export (JSON lines) then S6 import."""
    from tablework.sinks.export import export_json
    from tablework.sources.readers import read_files

    path = export_json(_t(spark, sf_dir, "part"), _scratch(spark, "json"))
    df, _ = read_files(spark, path, "json", lineage=False)
    return df


@query("json_array_roundtrip", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part
""")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 as JSON array documents then S5 import (array of objects)."""
    from tablework.sinks.export import export_json
    from tablework.sources.readers import read_files

    path = export_json(_t(spark, sf_dir, "part"), _scratch(spark, "jsonarr"), as_array=True)
    df, _ = read_files(spark, path, "json", pattern="*.txt", lineage=False)
    return df


@query("parquet_roundtrip", "SELECT * FROM part")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K11 export then S4 import."""
    from tablework.sinks.export import export_parquet
    from tablework.sources.readers import read_files

    path = export_parquet(_t(spark, sf_dir, "part"), _scratch(spark, "parquet"))
    df, _ = read_files(spark, path, "parquet", lineage=False)
    return df


@query("xml_roundtrip", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part
""")
def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12 export, read back with Spark's XML source (row tag ``row``)."""
    from tablework.sinks.export import export_xml

    path = export_xml(_t(spark, sf_dir, "part"), _scratch(spark, "xml"), query="SELECT * FROM part")
    return spark.read.format("xml").option("rowTag", "row").load(path)


def _html_escape_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#39;')")


@query("html_export", f"""
SELECT '<tr><td>' || CAST(n_nationkey AS VARCHAR) || '</td><td>' || {_html_escape_sql("n_name || ' <&> ' || CAST(n_regionkey AS VARCHAR)")}
       || '</td></tr>' AS value
FROM nation
UNION ALL
SELECT '<tr><td>' || CAST(c_custkey AS VARCHAR) || '</td><td>' || {_html_escape_sql("c_name || ' \"' || c_mktsegment || '''s\"'")}
       || '</td></tr>' FROM customer
""")
def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written document's table rows, escaped, read back as text."""
    from pyspark.sql import functions as F
    from tablework.sinks.export import export_html

    n = _t(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"),
        F.concat(F.col("n_name"), F.lit(" <&> "), F.col("n_regionkey").cast("string")).alias("label"))
    c = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        F.concat(F.col("c_name"), F.lit(' "'), F.col("c_mktsegment"), F.lit("'s\"")).alias("label"))
    path = export_html(n.unionByName(c), _scratch(spark, "html"), title="Keys & labels")
    return spark.read.text(path).where(F.col("value").startswith("<tr><td>"))


@query("xlsx_roundtrip", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice,
       'Query Results' AS _source_sheet
FROM part
""")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K14 export (one workbook per partition) then S7/S11 folder import."""
    from tablework.sinks.export import dealt, export_excel
    from tablework.sources.xlsx import read_excel

    path = _scratch(spark, "xlsx")
    export_excel(dealt(_t(spark, sf_dir, "part")), path).collect()
    df, _ = read_excel(spark, path)
    return df.drop("_source_file")


# ----------------------------------------------------------------- S11-S21, U1, U7, B1-B5 folders
_DRIFT = [
    ("g1", "1-URGENT", ",", [("o_orderkey", "Order Key"), ("o_custkey", "Cust Key"),
                             ("o_orderstatus", "Status"), ("o_totalprice", "Total Price")]),
    ("g2", "2-HIGH", ",", [("o_orderstatus", "status"), ("o_orderkey", "order key"),
                           ("o_totalprice", "total price"), ("o_orderdate", "order date")]),
    ("g3", "3-MEDIUM", ";", [("o_orderkey", "ORDER KEY"), ("o_orderpriority", "Priority"),
                             ("o_custkey", "cust key")]),
    ("g4", "4-NOT SPECIFIED", "\t", [("o_custkey", "Cust_Key"), ("o_orderkey", "Order_Key"),
                                     ("o_orderdate", "Order Date")]),
    ("g5", "5-LOW", "|", [("o_orderkey", "order key"), ("o_custkey", "cust key"),
                          ("o_orderdate", "order date"), ("o_orderpriority", "priority")]),
]
_DRIFT_COLS = ["ORDER_KEY", "CUST_KEY", "STATUS", "TOTAL_PRICE", "ORDER_DATE", "PRIORITY"]


def _write_drift_folder(spark: SparkSession, sf_dir: str) -> str:
    """Orders split by priority into five CSV folders whose headers drift:
    other names, case, order, subsets and delimiters."""
    from pyspark.sql import functions as F

    o = _t(spark, sf_dir, "orders")
    base = _scratch(spark, "drift")
    for group, prio, sep, cols in _DRIFT:
        part = o.where(F.col("o_orderpriority") == prio).select(*[F.col(c).alias(a) for c, a in cols])
        (part.write.option("header", "true").option("sep", sep)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{base}/{group}"))
    return base


def _drift_oracle() -> str:
    text = {"o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)",
            "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
            "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "o_orderpriority": "o_orderpriority"}
    name_to_src = {"ORDER_KEY": "o_orderkey", "CUST_KEY": "o_custkey", "STATUS": "o_orderstatus",
                   "TOTAL_PRICE": "o_totalprice", "ORDER_DATE": "o_orderdate", "PRIORITY": "o_orderpriority"}
    parts = []
    for _, prio, _, cols in _DRIFT:
        have = {c for c, _ in cols}
        sel = [f"{text[name_to_src[n]]} AS {n}" if name_to_src[n] in have else f"CAST(NULL AS VARCHAR) AS {n}"
               for n in _DRIFT_COLS]
        parts.append(f"SELECT {', '.join(sel)} FROM orders WHERE o_orderpriority = '{prio}'")
    return "\nUNION ALL\n".join(parts)


@query("folder_ingest", _drift_oracle())
def folder_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files with drifting headers and
    delimiters -> one read per header group, union by cleaned name."""
    from tablework.sources.readers import read_files

    base = _write_drift_folder(spark, sf_dir)
    df, res = read_files(spark, base, "csv", recursive=True, policy="upper")
    assert res.groups <= len(_DRIFT), res.groups  # files of equal width share a read
    return df.select(*_DRIFT_COLS)


@query("folder_column_report", """
SELECT * FROM (VALUES (4, 'ORDER_DATE,PRIORITY'), (4, 'CUST_KEY,PRIORITY'), (3, 'ORDER_DATE,STATUS,TOTAL_PRICE'),
                      (3, 'PRIORITY,STATUS,TOTAL_PRICE'), (4, 'STATUS,TOTAL_PRICE')) AS t(n_columns, missing)
""")
def folder_column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per distinct header, the unified columns its files lack -
    computed from the probe listing in one job (file names are random, so
    the report is grouped by header)."""
    from pyspark.sql import functions as F
    from tablework.operators.schema import column_mismatch_report
    from tablework.sources.probe import describe_files, header_columns

    base = _write_drift_folder(spark, sf_dir)
    probes = describe_files(spark, base, "*.csv", recursive=True)
    cols = header_columns(probes, "upper").groupBy("path").agg(
        F.array_sort(F.collect_list("column_name")).alias("columns"))
    rep = column_mismatch_report(cols, "columns", "path")
    return rep.select(F.size("columns").cast("int").alias("n_columns"),
                      F.array_join("missing_columns", ",").alias("missing")).distinct()


@query("describe_files")
def describe_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file encoding, delimiter, header, column count."""
    from tablework.sources.probe import describe_files

    base = _write_drift_folder(spark, sf_dir)
    return describe_files(spark, base, "*.csv", recursive=True).select(
        "file_name", "size", "encoding", "delimiter", "header", "n_columns", "status")


def _write_ragged(spark: SparkSession, sf_dir: str) -> str:
    """Orders as CSV text where urgent rows carry an extra field and low
    rows lack the last one; every part file starts with the header line."""
    import pandas as pd
    from pyspark.sql import functions as F

    o = _t(spark, sf_dir, "orders")
    base_fields = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
                   F.col("o_orderstatus"), F.col("o_orderpriority")]
    line = (F.when(F.col("o_orderpriority") == "1-URGENT",
                   F.concat_ws(",", *base_fields, F.col("o_totalprice").cast("string"), F.lit("EXTRA")))
            .when(F.col("o_orderpriority") == "5-LOW", F.concat_ws(",", *base_fields))
            .otherwise(F.concat_ws(",", *base_fields, F.col("o_totalprice").cast("string"))))
    header = "o_orderkey,o_custkey,o_orderstatus,o_orderpriority,o_totalprice"

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    path = _scratch(spark, "ragged")
    o.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path)
    return path


_RAGGED_BASE = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END
       AS o_totalprice
FROM orders
"""


@query("bad_rows_skip_long", _RAGGED_BASE + "WHERE o_orderpriority <> '1-URGENT'")
def bad_rows_skip_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: rows with too many fields are rejected, short rows NULL-padded."""
    from tablework.sources.readers import read_files

    path = _write_ragged(spark, sf_dir)
    df, res = read_files(spark, path, "txt", pattern="*.txt", delimiter=",", bad_rows="skip_long",
                         lineage=False)
    return df


@query("bad_rows_drop_malformed", _RAGGED_BASE + "WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def bad_rows_drop_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: DROPMALFORMED drops both too-long and too-short rows."""
    from tablework.sources.readers import read_files

    path = _write_ragged(spark, sf_dir)
    df, _ = read_files(spark, path, "txt", pattern="*.txt", delimiter=",", bad_rows="drop_malformed",
                       lineage=False)
    return df


@query("bad_rows_rejected", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'EXTRA' AS extra FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def bad_rows_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected long rows themselves (with the field that overflowed)."""
    from pyspark.sql import functions as F
    from tablework.sources.readers import EXTRA_FIELD, read_files

    path = _write_ragged(spark, sf_dir)
    _, res = read_files(spark, path, "txt", pattern="*.txt", delimiter=",", bad_rows="skip_long",
                        lineage=False)
    return res.rejected_rows.select(F.col("_c0").alias("o_orderkey"), F.col(EXTRA_FIELD).alias("extra"))


# ----------------------------------------------------------------- T1/T2 streaming, P1 folders
def _stream_oracle() -> str:
    return """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority
FROM orders"""


@query("stream_ingest", _stream_oracle())
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive as three CSV drops; each availableNow run loads
    only the files it has not seen, and the last drop's reordered header
    with an extra column is mapped by name (table gains the column)."""
    from pyspark.sql import functions as F
    from tablework.sinks.tables import drop_table
    from tablework.streaming.ingest import ingest_new_files

    o = _t(spark, sf_dir, "orders")
    folder = _scratch(spark, "incoming")
    table = _scratch_table(spark, "orders_stream", sf_dir)
    drop_table(spark, table)
    ckpt = _scratch(spark, "stream_ckpt")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]

    def drop(status: str, name: str, columns: list[str]):
        o.where(F.col("o_orderstatus") == status).select(*columns) \
            .write.option("header", "true").csv(f"{folder}/{name}")

    drop("F", "drop1", cols)
    n1 = ingest_new_files(spark, folder, table, checkpoint=ckpt, pattern="*.csv").count()
    drop("O", "drop2", cols)
    ingest_new_files(spark, folder, table, checkpoint=ckpt, pattern="*.csv")
    drop("P", "drop3", ["o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey"])
    out = ingest_new_files(spark, folder, table, checkpoint=ckpt, pattern="*.csv")
    assert n1 > 0
    return out.drop("_ingest_batch", "_source_file")


@query("automation_folder", """
SELECT CAST(o.o_orderkey AS VARCHAR) AS order_key, c.c_name AS customer_name, CAST(o.o_totalprice AS VARCHAR) AS total
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F'
""")
def automation_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1/P2 in the folder dialect: a CSV folder source (files appended
    over time) + a single-file source, one SQL, output table."""
    from pyspark.sql import functions as F

    o = _t(spark, sf_dir, "orders")
    base = _scratch(spark, "pipeline")
    for st in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == st).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice") \
            .write.option("header", "true").csv(f"{base}/sales/{st}")
    _t(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1) \
        .write.option("header", "true").csv(f"{base}/customers")
    doc = {
        "version": "1.0", "description": "orders with customer names",
        "sources": [
            {"mode": "csv_folder", "path": f"{base}/sales", "table_name": "sales", "file_type": "csv",
             "options": {"recursive": True}},
            {"mode": "csv_folder", "folder_path": f"{base}/customers", "table_name": "customers",
             "file_pattern": "*.csv"},
        ],
        "sql_query": (f"CREATE TABLE finished_sales_{_dir_tag(sf_dir)} AS SELECT s.o_orderkey AS order_key, c.c_name AS customer_name, "
                      "s.o_totalprice AS total FROM sales s LEFT JOIN customers c ON s.o_custkey = c.c_custkey "
                      "WHERE s.o_orderstatus = 'F'"),
    }
    res = run_pipeline(spark, parse_pipeline(doc), database=ensure_database(spark, SCRATCH_DB))
    return spark.table(res["output_table"])


@query("folder_ingest_generic", _drift_oracle())
def folder_ingest_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: files of equal width under different headers are one positional
    read, mapped by name through a join on the path."""
    from tablework.sources.readers import read_files

    base = _write_drift_folder(spark, sf_dir)
    df, _ = read_files(spark, base, "csv", recursive=True, policy="upper", encoding_check="head")
    return df.select(*_DRIFT_COLS)


# ----------------------------------------------------------------- K6 / K7 / B7 import workflows
@query("bulk_import", _drift_oracle())
def bulk_import_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the drifting folder into one table, one union, one write."""
    from tablework.plans.imports import bulk_import

    base = _write_drift_folder(spark, sf_dir)
    t = _scratch_table(spark, "orders_bulk", sf_dir)
    bulk_import(spark, base, t, mode="replace", recursive=True, policy="upper")
    return spark.table(t).select(*_DRIFT_COLS)


@query("merge_csv_append", f"""
SELECT * FROM ({_drift_oracle()})
UNION ALL
SELECT * FROM ({_drift_oracle()}) WHERE PRIORITY IS NOT NULL
""")
def merge_csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: merge a CSV folder into a CSV output, then append a second folder
    (re-read, union by name, staged rewrite)."""
    from pyspark.sql import functions as F
    from tablework.plans.imports import merge_folder_to_csv
    from tablework.sources.readers import read_files

    base = _write_drift_folder(spark, sf_dir)
    out = _scratch(spark, "merged")
    merge_folder_to_csv(spark, base, out, "create_new", recursive=True, policy="upper", lineage=False)
    merge_folder_to_csv(spark, f"{base}/g3", out, "append", policy="upper", lineage=False)
    merge_folder_to_csv(spark, f"{base}/g5", out, "append", policy="upper", lineage=False)
    df, _ = read_files(spark, out, "csv", lineage=False)
    return df.select(*_DRIFT_COLS)


def _lineitem_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    li = _t(spark, sf_dir, "lineitem")
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return li.select(F.col("l_orderkey").cast("string").alias("l_orderkey"),
                     F.col("l_linenumber").cast("string").alias("l_linenumber"),
                     F.when(bad, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
                     F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"))


_TYPED = "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate date"


@query("typed_load", """
SELECT l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate
FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')
""")
def typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to a typed schema; convertible rows."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from tablework.plans.imports import typed_with_rejects

    ok, _ = typed_with_rejects(_lineitem_text(spark, sf_dir), T.StructType.fromDDL(_TYPED))
    return ok.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("typed_rejects", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, 'n/a' AS l_quantity, 'l_quantity' AS failed_columns
FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'
""")
def typed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that do not convert, with the failing columns."""
    from pyspark.sql import types as T
    from tablework.plans.imports import typed_with_rejects

    _, rej = typed_with_rejects(_lineitem_text(spark, sf_dir), T.StructType.fromDDL(_TYPED))
    return rej.select("l_orderkey", "l_quantity", "failed_columns")


@query("agg_approx")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct count and quantiles (sketches differ between
    engines, so rows only)."""
    from pyspark.sql import functions as F

    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey").alias("approx_parts"),
        F.percentile_approx("l_extendedprice", [0.5, 0.9]).alias("price_p50_p90"))


@query("numeric_nan_to_null", """
SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN NULL ELSE value END AS value
FROM events
""")
def numeric_nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and +-infinity in numeric columns become NULL."""
    from pyspark.sql import functions as F
    from tablework.operators.clean import numeric_nan_to_null as to_null

    e = _t(spark, sf_dir, "events")
    v = (F.when(F.col("event_type") == "error", F.lit(float("nan")))
         .when(F.col("event_type") == "view", F.lit(float("inf")))
         .when(F.col("event_type") == "signup", F.lit(float("-inf")))
         .otherwise(F.col("value")))
    return to_null(e.select("event_id", v.alias("value")))


@query("import_report", """
SELECT CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 3 ELSE 4 END AS n_columns,
       'ok' AS status, count(*) AS rows
FROM orders GROUP BY 1
""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-file import report (status, columns, rows loaded),
    rolled up by column count since part-file names are random."""
    from pyspark.sql import functions as F
    from tablework.sources.readers import read_files

    base = _write_drift_folder(spark, sf_dir)
    df, res = read_files(spark, base, "csv", recursive=True, policy="upper")
    rep = res.report(df)
    return rep.groupBy("n_columns", "status").agg(F.sum("rows").cast("bigint").alias("rows"))


@query("row_number_hot_keys", """
SELECT o_orderkey, o_custkey,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS row_number
FROM orders
""")
def row_number_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over a key with very few values (a third of the rows each): numbered
    by range partitions instead of one task per key."""
    from pyspark.sql import functions as F
    from tablework.operators.windows import row_number_by_range

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    out = row_number_by_range(o, ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return out.select("o_orderkey", "o_custkey", "row_number")
