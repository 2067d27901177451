from pyspark.sql import functions as F

from conftest import rows
from tablework.functions import compat as X
from tablework.operators.checks import primary_key_violations
from tablework.operators.clean import strip_control_chars


def test_small_helpers(spark):
    df = spark.createDataFrame([(7, -7.25, "abcabc", "x\r\ny\u0000")], "i int, d double, s string, t string")
    r = df.select(
        X.int_div("i", F.lit(2)).alias("div"),
        X.substring_plain(F.col("s"), 0, 2).alias("sub0"),
        X.substring_plain(F.col("s"), 2, 2).alias("sub2"),
        X.regexp_replace_first(F.col("s"), "b", "$").alias("first"),
        X.trunc_number(F.col("d")).alias("tr0"),
        X.trunc_number(F.col("d"), 1).alias("tr1"),
        X.choose(F.lit(2), "a", "b", "c").alias("ch"),
        X.decode(F.col("i"), 7, "seven", "other").alias("dec"),
        X.json_valid(F.lit('{"a": 1}')).alias("jv"),
        X.array_replace(F.array(F.lit(1), F.lit(2), F.lit(1)), 1, 9).alias("ar"),
    ).first()
    assert (r["div"], r["sub0"], r["sub2"], r["first"]) == (3, "a", "bc", "a$cabc")
    assert (r["tr0"], r["tr1"], r["ch"], r["dec"], r["jv"], list(r["ar"])) == (-7.0, -7.2, "b", "seven", True, [9, 2, 9])
    assert strip_control_chars(df.select("t")).first()["t"] == "x\ny"


def test_primary_key_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    assert rows(primary_key_violations(df, ["k"]), ["v"]) == [("a",), ("b",), ("c",)]


def test_group_concat_and_array_agg(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z")], "k int, v string")
    out = {r["k"]: (r["g"], len(r["arr"])) for r in df.groupBy("k").agg(
        X.group_concat("v", ",", order_by="v").alias("g"), X.array_agg_keep_nulls("v").alias("arr")).collect()}
    assert out[1] == ("a,b", 3) and out[2] == ("z", 1)
