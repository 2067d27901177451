"""Windows and joins over hot keys against Spark's own windows and brute force."""
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablework.operators import windows as W
from tablework.operators.buckets import BUCKET, KEY, ORDER
from tablework.operators.joins import asof_join, range_join

HOT = 40


def table(spark, seed=1, n=900):
    """A third of the rows has one key; ties, NULL keys, NULL orders."""
    r = random.Random(seed)
    data = [(i, "hot" if i % 3 == 0 else r.choice([None, "a", "b", *"cdefgh"]), r.choice([None, *range(60)]) if r.random() < 0.8 else 17,
             r.choice([None, 1, 2, 3, 10])) for i in range(n)]
    return spark.createDataFrame(data, "id long, k string, o int, v long").repartition(6)


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert got.columns == want.columns
    a, b = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=key) for d in (got, want))
    assert a == b


@pytest.mark.parametrize("order", [["o", "id"], ["-o", "-id"]])
def test_numbers_and_tiles(spark, order):
    df = table(spark)
    w = Window.partitionBy("k").orderBy(*[F.col(o[1:]).desc() if o[0] == "-" else F.col(o).asc() for o in order])
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.ntile(7).over(w).alias("t7"), F.ntile(1000).over(w).alias("t1000"))
    same(W.numbered(df, ["k"], order, "n", {"t7": 7, "t1000": 1000}, hot_rows=HOT), want)
    same(W.row_number_by_range(df, [], ["id"], "n", hot_rows=HOT),
         df.select("*", F.row_number().over(Window.orderBy("id")).cast("bigint").alias("n")))


@pytest.mark.parametrize("order", [["o", "id"], ["-o", "-id"]])
def test_running(spark, order):
    df = table(spark, 2)
    w = Window.partitionBy("k").orderBy(*[F.col(o[1:]).desc() if o[0] == "-" else F.col(o).asc() for o in order]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    fns = {"s": "sum", "c": "count", "lo": "min", "hi": "max", "a": "avg"}
    want = df.select("*", *[getattr(F, f)("v").over(w).alias(n) for n, f in fns.items()])
    same(W.running(df, ["k"], order, {n: (f, "v") for n, f in fns.items()}, hot_rows=HOT), want)


@pytest.mark.parametrize("order", [["o"], ["-o", "-v"], ["o", "v"]])
def test_ranks(spark, order):
    df = table(spark, 3)
    w = Window.partitionBy("k").orderBy(*[F.col(o[1:]).desc() if o[0] == "-" else F.col(o).asc() for o in order])
    want = df.select("*", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.percent_rank().over(w).alias("p"),
                     F.cume_dist().over(w).alias("c"))
    same(W.ranked(df, ["k"], order, "r", "d", "p", "c", hot_rows=HOT), want)


@pytest.mark.parametrize("hot,before,after", [(HOT, 3, 2), (2, 5, 5), (3, 0, 4), (4, 6, 0), (10 ** 6, 2, 2)])
def test_frames(spark, hot, before, after):
    df = table(spark, 4)
    w = Window.partitionBy("k").orderBy("o", "id")
    fns = {"s": lambda w: F.sum("v").over(w.rowsBetween(-before, after)), "n": lambda w: F.count("*").over(w.rowsBetween(-before, after))}
    if before:
        fns["lag"] = lambda w: F.lag("id", before, -1).over(w)
    if after:
        fns["lead"] = lambda w: F.lead("id", after).over(w)
    want = df.select("*", *[f(w).alias(n) for n, f in fns.items()])
    same(W.framed(df, ["k"], ["o", "id"], fns, before, after, hot_rows=hot), want)


@pytest.mark.parametrize("hot", [HOT, 10 ** 6])
def test_range_frames(spark, hot):
    df = table(spark, 5)
    w = Window.partitionBy("k").orderBy("o").rangeBetween(-4, 2)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("a"))
    same(W.ranged(df, ["k"], "o", {"s": ("sum", "v"), "n": ("count", "v"), "a": ("avg", "v")}, 4, 2, hot_rows=hot), want)


def test_no_task_has_the_whole_key(spark):
    df = table(spark, 6, 3000)
    cut = W._Cut(df, ["k"], ["o", "id"], 100)
    sizes = [r["count"] for r in cut.rows.groupBy(KEY, BUCKET).count().collect()]
    assert max(sizes) < 350 and sum(sizes) == 3000
    text = df.withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))  # texts are cut as well
    assert max(r["count"] for r in W._Cut(text, ["k"], ["t"], 100).rows.groupBy(KEY, BUCKET).count().collect()) < 350


def test_mixed_directions_are_refused(spark):
    with pytest.raises(ValueError, match="one direction"):
        W.numbered(table(spark), ["k"], ["o", "-id"])


def test_empty_input(spark):
    df = table(spark).limit(0)
    assert W.numbered(df, ["k"], ["id"], hot_rows=1).count() == 0
    assert W.ranked(df, ["k"], ["id"], "r", hot_rows=1).count() == 0
    assert asof_join(df, df, ["k"], "o", "o", hot_rows=1).count() == 0


# ------------------------------------------------------------------------ as-of
def asof_brute(left, right, strict=False):
    out = []
    for i, k, t in left:
        fits = [rt for _, rk, rt in right if None not in (k, t, rk, rt) and rk == k and (rt < t if strict else rt <= t)]
        out.append((i, max(fits) if fits else None))
    return sorted(out)


@pytest.mark.parametrize("hot", [5, 60, 10 ** 6])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, hot, strict):
    r = random.Random(hot)

    def made(n):
        rows = []
        for i in range(n):
            t = r.choice([None, 0, 5000 + r.randrange(30), r.randrange(10_000)])  # a stray early time, a burst
            rows.append((i, 1 if r.random() < 0.6 else r.choice([None, 2, 3]), 5005 if r.random() < 0.2 else t))
        return rows

    left, right = made(500), made(300)
    L = spark.createDataFrame(left, "id long, k int, t long").repartition(5)
    R = spark.createDataFrame(right, "id long, k int, t long").repartition(3)
    got = asof_join(L, R, ["k"], "t", "t", how="left", hot_rows=hot, strict=strict)
    assert sorted((x.id, x.r_t) for x in got.collect()) == asof_brute(left, right, strict)
    inner = asof_join(L, R, ["k"], "t", "t", hot_rows=hot, strict=strict)
    assert sorted((x.id, x.r_t) for x in inner.collect()) == [x for x in asof_brute(left, right, strict) if x[1] is not None]


def test_asof_deals_out_a_burst(spark, monkeypatch):
    """All rows have one key, half of them one time."""
    L = spark.range(4000).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id") % 1000).alias("t")).repartition(8)
    seen = {}
    import tablework.operators.joins as J
    plain = Window.partitionBy

    def spy(*cols):
        seen["cols"] = cols
        return plain(*cols)

    cuts = J.hot_cuts
    monkeypatch.setattr(J, "hot_cuts", lambda rows, n: seen.setdefault("cuts", cuts(rows, n)))
    out = asof_join(L, L.withColumnRenamed("id", "rid"), ["k"], "t", "t", hot_rows=500)
    assert out.count() == 4000 and out.where("t <> r_t").count() == 0
    row = seen["cuts"].first()
    same_cut = max(row["__cuts"].count(c) for c in row["__cuts"])
    assert same_cut >= 4  # the burst fills several buckets


# ------------------------------------------------------------------ range join
def test_range_join_of_all_lengths(spark):
    r = random.Random(9)
    pts = [(i, r.choice([r.uniform(0, 1000), float(r.randrange(1000)), None, -5.0])) for i in range(400)]
    ivs = [(0, -1e9, 1e9), (1, 3.0, 3.0), (2, 10.0, 5.0), (3, None, 5.0), (4, float("-inf"), float("inf"))]
    ivs += [(10 + j, lo, lo + r.choice([0.0, 1e-3, 1.0, 4.0, 64.0])) for j, lo in ((j, float(r.randrange(1000))) for j in range(150))]
    P, I = spark.createDataFrame(pts, "pid long, x double"), spark.createDataFrame(ivs, "iid long, lo double, hi double")
    want = sorted((p, i) for p, x in pts for i, lo, hi in ivs if None not in (x, lo, hi) and lo <= x <= hi)
    assert sorted((q.pid, q.iid) for q in range_join(P, I, "x", "lo", "hi").collect()) == want
    left = range_join(P, I, "x", "lo", "hi", how="left")
    alone = {p for p, _ in pts} - {p for p, _ in want}
    assert sorted((q.pid, q.iid) for q in left.collect() if q.iid is not None) == want
    assert sorted(q.pid for q in left.where("iid is null").collect()) == sorted(alone)
    assert range_join(P, I.limit(0), "x", "lo", "hi", how="left").count() == len(pts)


def test_one_long_interval_adds_no_candidates_to_short_ones(spark):
    pts = spark.range(5000).select(F.col("id").alias("pid"), F.col("id").cast("double").alias("x"))
    short = spark.range(2500).select(F.col("id").alias("iid"), (F.col("id") * 2.0).alias("lo"), (F.col("id") * 2.0 + 1).alias("hi"))
    long = spark.createDataFrame([(-1, 0.0, 5000.0)], "iid long, lo double, hi double")
    assert range_join(pts, short.union(long), "x", "lo", "hi").count() == 10_000

    def bins(iv):  # rows of the interval side after it is dealt to bins
        return sum(r["n"] for r in iv.select(F.size(F.sequence(F.floor(F.col("lo") / F.pow(F.lit(2.0), "c")), F.floor(F.col("hi") / F.pow(F.lit(2.0), "c")))).alias("n")).collect())

    from tablework.operators.joins import _length_class
    assert bins(short.union(long).withColumn("c", _length_class(F.col("hi") - F.col("lo")))) <= 2 * 2501


def test_length_classes(spark):
    from tablework.operators.joins import _length_class
    xs = [0.0, 1e-300, 0.3, 0.5, 1.0, 1.0000001, 2.0, 3.0, 4.0, 1e9, 2.0 ** 40, 1e300, math.inf]
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", _length_class(F.col("x")).alias("c")).orderBy("i").collect()]
    for x, c in zip(xs, got):
        if 1e-200 < x < 1e299:
            assert 2.0 ** c >= x and 2.0 ** (c - 1) < x
