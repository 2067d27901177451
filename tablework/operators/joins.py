"""Joins and filters Spark's SQL lacks (Q15 range join, Q16 AS-OF join,
Q28 QUALIFY) as compositions of DataFrame operators.

Both joins are built to survive a hot key holding a third of the rows:

* the range join sorts intervals into classes of lengths, each with bins of
  its own width, and equi-joins on (class, bin): a long interval costs its
  own few bins and adds nothing to those of the short ones;
* the AS-OF join cuts hot keys at sampled quantiles of their times, finds
  the match inside each (key, bucket) with a running window, and carries the
  last right row of earlier buckets over in one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.compat import epoch_micros
from tablework.operators.buckets import BUCKET, HOT_ROWS, KEY, ORDER, hot_cuts, key_struct, most_cuts, position


def numeric_time(df: DataFrame, c: str) -> Column:
    """A monotone numeric key for a column: timestamps -> microseconds,
    dates -> days, numbers as they are."""
    t = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if isinstance(t, T.TimestampNTZType):
        return epoch_micros(col)
    if isinstance(t, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(t, T.DateType):
        return F.unix_date(col).cast("bigint")
    return col


# ------------------------------------------------------------------ range join
def range_join(points: DataFrame, intervals: DataFrame, point_col: str, lo_col: str, hi_col: str,
               how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """Pairs with ``lo <= point <= hi`` (Q15), ``how`` = inner | left, and equal
    ``on`` columns (same names on both sides) where given.

    An interval's class is the power of two just above its length, and the
    class's bins are as wide, so an interval lies in at most two bins of its
    class.  A point has one bin in each class that occurs (at most 64 for
    numbers of one magnitude; the list is one row).  The equality on (class,
    bin) gives Catalyst an equi-join, whose hot bins AQE splits; the predicate
    itself is the residual condition.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    lo_n, hi_n = numeric_time(intervals, lo_col).cast("double"), numeric_time(intervals, hi_col).cast("double")
    length = F.col("_hi") - F.col("_lo")
    exact = (intervals.withColumn("_lo", numeric_time(intervals, lo_col)).withColumn("_hi", numeric_time(intervals, hi_col))
             .where(F.col("_lo") <= F.col("_hi")).withColumn("_class", _length_class(length.cast("double"))))
    classes = [r[0] for r in exact.select("_class").distinct().collect()]  # exponents of doubles: a few dozen, 2,100 at most
    width = F.pow(F.lit(2.0), F.col("_class"))
    iv = exact.withColumn("_bin", F.explode(F.sequence(F.floor(lo_n / width), F.floor(hi_n / width))))
    pt = points.withColumn("_x", numeric_time(points, point_col))
    pt = pt.withColumn("_class", F.explode_outer(F.array(*[F.lit(c) for c in sorted(classes)]).cast("array<int>")))
    pt = pt.withColumn("_bin", F.floor(F.col("_x").cast("double") / width))
    cond = (pt["_class"] == iv["_class"]) & (pt["_bin"] == iv["_bin"]) & (iv["_lo"] <= pt["_x"]) & (pt["_x"] <= iv["_hi"])
    for c in on or []:
        cond = cond & (pt[c] == iv[c])
    found = [F.col(f"i.`{c}`") for c in intervals.columns]
    if how == "inner":
        return pt.alias("p").join(iv.alias("i"), cond).select(*[F.col(f"p.`{c}`") for c in points.columns], *found)
    # a point without a match in any class stays once: matches are looked up by a row's id
    from tablework.operators.buckets import stored

    kept = stored(points.withColumn("_row", F.monotonically_increasing_id()), "range_points")
    inner = range_join(kept, intervals.select(F.struct("*").alias("_i"), F.col(f"`{lo_col}`").alias("_from"), F.col(f"`{hi_col}`").alias("_to"),
                                              *[F.col(f"`{c}`") for c in on or []]), point_col, "_from", "_to", on=on)
    hits = inner.select(F.col("_row").alias("_hit"), "_i")
    return kept.join(hits, F.col("_row") == F.col("_hit"), "left").select(
        *[F.col(f"`{c}`") for c in points.columns], *[F.col(f"_i.`{c}`").alias(c) for c in intervals.columns])


def _length_class(length: Column) -> Column:
    """The smallest power of two that is not below the length (exponent; 0
    for the length 0).  The logarithm only has to be near: one step up is
    taken where it fell short."""
    e = F.least(F.greatest(F.ceil(F.log2(length)), F.lit(-1000)), F.lit(1100)).cast("int")  # 2^1100: endless
    return F.when(length <= 0, 0).when(F.pow(F.lit(2.0), e) < length, e + 1).otherwise(e)


# ------------------------------------------------------------------ as-of join
def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str,
              how: str = "inner", tolerance: float | None = None, hot_rows: int = HOT_ROWS,
              right_prefix: str = "r_", strict: bool = False) -> DataFrame:
    """For each left row, the right row with the same ``on`` keys and the
    greatest ``right_ts <= left_ts`` (Q16; DuckDB ``ASOF JOIN ... l.ts >=
    r.ts``), or ``<`` with ``strict``.  NULL keys and NULL times match nothing.

    Right columns are returned with ``right_prefix``; ``how`` = inner | left.
    ``tolerance`` (in the numeric time unit: microseconds for timestamps)
    bounds ``left_ts - right_ts``.  Of right rows with equal key and time any
    one is taken.

    Keys with more than ``hot_rows`` rows (of both sides) are cut at quantiles
    of their times.  Left rows of a time that fills several buckets are dealt
    out among them; the right rows of such a time are cut to one beforehand.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    lt, rt = numeric_time(left, left_ts), numeric_time(right, right_ts)
    some_key = F.lit(True)
    for k in on:
        some_key = some_key & F.col(f"`{k}`").isNotNull()
    pair = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`").alias(right_prefix + c) for c in right.columns])
    L = left.select(key_struct(on).alias(KEY), lt.alias("_t"), pair[0].alias("_l"), (some_key & lt.isNotNull()).alias("_ok"))
    R = right.where(some_key & rt.isNotNull()).select(key_struct(on).alias(KEY), rt.alias("_t"), pair[1].alias("_r"))
    time = F.struct(F.col("_t").cast(_common(L, R)).alias("t")).alias(ORDER)
    cuts = hot_cuts(L.where("_ok").select(KEY, time).unionByName(R.select(KEY, time)), hot_rows)
    if cuts is None:
        L, R = L.withColumn(BUCKET, F.lit(0)), R.withColumn(BUCKET, F.lit(0))
    else:
        most = most_cuts(cuts)
        full = F.filter("__cuts", lambda c, i: F.exists(F.slice("__cuts", i + 2, 1), lambda d: d == c))  # times that fill a bucket
        marked = cuts.select(KEY, "__cuts", F.array_distinct(full).alias("__full"))
        R = R.withColumn(ORDER, time).join(marked, KEY, "left")
        many = F.coalesce(F.array_contains("__full", F.col(ORDER)), F.lit(False))
        once = R.where(many).groupBy(KEY, ORDER).agg(F.first("_t").alias("_t"), F.first("_r").alias("_r"), F.first("__cuts").alias("__cuts"))
        R = R.where(~many).select(KEY, ORDER, "_t", "_r", "__cuts").unionByName(once)
        last = position(F.col("__cuts"), F.col(ORDER), most)
        run = F.size(F.filter("__cuts", lambda c: c == F.col(ORDER)))
        # a right row lies in its time's first bucket, and later ones find it as carried over; strictly
        # earlier ones are looked for, so there it lies in the last bucket, behind all left rows of its time
        placed = last if strict else last - F.greatest(run - 1, F.lit(0))
        R = R.withColumn(BUCKET, F.when(F.col("__cuts").isNull(), 0).otherwise(placed)).drop("__cuts", ORDER)
        L = L.withColumn(ORDER, time).join(marked, KEY, "left")
        spread = F.when(F.array_contains("__full", F.col(ORDER)), last - (F.monotonically_increasing_id() % F.greatest(run, F.lit(1))).cast("int")).otherwise(last)
        L = L.withColumn(BUCKET, F.when(F.col("__cuts").isNull() | ~F.col("_ok"), 0).otherwise(spread)).drop("__cuts", "__full", ORDER)
    kind = R.schema["_r"].dataType
    both = L.select(KEY, BUCKET, "_t", F.lit(0 if strict else 1).alias("_side"), "_l", F.lit(None).cast(kind).alias("_r"), "_ok").unionByName(
        R.select(KEY, BUCKET, "_t", F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(L.schema["_l"].dataType).alias("_l"), "_r",
                 F.lit(True).alias("_ok")))
    w = Window.partitionBy(KEY, BUCKET).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")))
    got = both.withColumn("_m", F.last(own, ignorenulls=True).over(w)).where("_l is not null")
    if cuts is not None:
        # one row per bucket: the last right row of the buckets before
        marks = cuts.select(KEY, F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias(BUCKET))
        lasts = R.join(cuts.select(KEY), KEY, "left_semi").groupBy(KEY, BUCKET).agg(F.max_by(F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")), "_t").alias("_last"))
        upto = Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.join(lasts, [KEY, BUCKET], "left").withColumn("_before", F.last("_last", ignorenulls=True).over(upto)).drop("_last")
        got = got.join(carried, [KEY, BUCKET], "left").withColumn("_m", F.coalesce("_m", "_before"))
    match = F.when(F.col("_ok") if tolerance is None else F.col("_ok") & (F.col("_t") - F.col("_m.t") <= F.lit(tolerance)), F.col("_m.r"))
    got = got.select("_l", match.alias("_match"))
    if how == "inner":
        got = got.where(F.col("_match").isNotNull())
    return got.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns],
                      *[F.col(f"_match.`{right_prefix + c}`").alias(right_prefix + c) for c in right.columns])


def _common(left: DataFrame, right: DataFrame) -> T.DataType:
    """The type both sides' times are compared in."""
    return left.select("_t").union(right.select("_t")).schema["_t"].dataType


# ------------------------------------------------------------------ qualify
def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Q28 ``QUALIFY``: filter on a window expression (Spark's parser rejects
    the clause; a projection + filter is the same plan)."""
    return df.withColumn("__qualify", condition).where(F.col("__qualify")).drop("__qualify")


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """``QUALIFY row_number() OVER (PARTITION BY keys ORDER BY order) <= k``.
    Spark cuts every task's rows to the top ``k`` of a key before the shuffle
    (window group limit), so a hot key sends ``k`` rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
