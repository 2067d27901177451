"""Window functions that stay balanced when one group is huge.

``f() OVER (PARTITION BY k ORDER BY o)`` sends every row of a key to one
task.  Here a key with more than ``hot_rows`` rows is cut into buckets of
consecutive rows (``operators.buckets``).  The functions run in each bucket,
and what they lack comes over from the others:

``numbered``   row_number, ntile      counts of the buckets before
``running``    sums, extremes ...     totals of the buckets before
``ranked``     rank, dense_rank, percent_rank, cume_dist: over one row for
               each distinct order, so that ties, however many, are one row
``framed``     lag, lead, ROWS frames copies of the neighbours' edge rows
``ranged``     sums in a RANGE frame  difference of two running sums, found
               by as-of joins

``order`` lists columns (or ascending expressions); ``"-name"`` is
descending.  All of them need one direction, and a total order within a key
where rows are told apart (all but ``ranked`` and ``ranged``).  NULL keys
are a group like any other; NULL orders come first (last if descending).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.operators.buckets import BUCKET, HOT_ROWS, KEY, ORDER, hot_cuts, key_struct, with_bucket


class _Cut:
    """``df`` with its key, order and bucket, and windows over the buckets."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column | str], hot_rows: int):
        names = [o for o in order if isinstance(o, str)]
        self.descending = bool(names) and names[0].startswith("-")
        if any(n.startswith("-") != self.descending for n in names) or (self.descending and len(names) < len(order)):
            raise ValueError("all of the order must have one direction")
        cols = [F.col(f"`{o.removeprefix('-')}`") if isinstance(o, str) else o for o in order]
        self.columns = df.columns
        rows = df.select("*", key_struct(keys).alias(KEY), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)]).alias(ORDER))
        self.cuts = hot_cuts(rows.select(KEY, ORDER), hot_rows)
        self.rows = with_bucket(rows, self.cuts, self.descending)
        self.order = F.col(ORDER).desc() if self.descending else F.col(ORDER).asc()
        self.in_bucket = Window.partitionBy(KEY, BUCKET).orderBy(self.order)

    def hot(self) -> DataFrame:
        """The rows of the keys that were cut."""
        return self.rows.join(self.cuts.select(KEY), KEY, "left_semi")

    def before(self, totals: dict[str, Column], combine: dict[str, Callable[[Column], Column]]) -> DataFrame | None:
        """(__key, __bucket, name: total of the buckets before, whole_name: of
        the key) of the hot keys.  A row here is a bucket, so a window over a
        key's rows is small."""
        if self.cuts is None:
            return None
        per = self.hot().groupBy(KEY, BUCKET).agg(*[t.alias(n) for n, t in totals.items()])
        w = Window.partitionBy(KEY).orderBy(BUCKET)
        return per.select(KEY, BUCKET, *[combine[n](F.col(n)).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n in totals],
                          *[combine[n](F.col(n)).over(Window.partitionBy(KEY)).alias(f"whole_{n}") for n in totals])

    def joined(self, rows: DataFrame, carry: DataFrame | None, names: list[str]) -> DataFrame:
        if carry is None:
            return rows.select("*", *[F.lit(None).alias(n) for n in names])
        return rows.join(carry, [KEY, BUCKET], "left")


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], row_number: str | None = "row_number",
             ntile: dict[str, int] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` + row_number and, for each name of ``ntile``, ntile(n)."""
    cut = _Cut(df, keys, order, hot_rows)
    carry = cut.before({"__count": F.count(F.lit(1))}, {"__count": F.sum})
    local = cut.rows.withColumn("__at", F.row_number().over(cut.in_bucket))
    if ntile:
        local = local.withColumn("__here", F.count(F.lit(1)).over(Window.partitionBy(KEY, BUCKET)))
    out = cut.joined(local, carry, ["__count", "whole___count"])
    at = (F.col("__at") + F.coalesce("__count", F.lit(0))).cast("bigint")
    cols = [at.alias(row_number)] if row_number else []
    for name, n in (ntile or {}).items():
        whole = F.coalesce("whole___count", "__here")
        low, more = F.floor(whole / n), whole % n  # the first `more` tiles have one row more
        early = more * (low + 1)
        tile = F.when(at <= early, F.floor((at - 1) / (low + 1))).otherwise(more + F.floor((at - 1 - early) / F.greatest(low, F.lit(1))))
        cols.append((tile + 1).cast("int").alias(name))
    return out.select(*[F.col(f"`{c}`") for c in cut.columns], *cols)


def row_number_by_range(df: DataFrame, keys: list[str], order: list[Column | str],
                        name: str = "row_number", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` plus ``name`` = ``row_number() over (partition by keys order by order)``."""
    return numbered(df, keys, order, name, hot_rows=hot_rows)


_RUNNING = {  # aggregate, how totals are put together, how a row's own part joins the carried one
    "sum": (F.sum, F.sum, lambda here, before: F.coalesce(here + before, here, before)),
    "count": (F.count, F.sum, lambda here, before: here + F.coalesce(before, F.lit(0))),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
}


def running(df: DataFrame, keys: list[str], order: list[Column | str], functions: dict[str, tuple[str, str]],
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` + for each name (function, column): sum, count, min, max or avg
    over ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW."""
    parts: dict[str, tuple[str, str]] = {}
    for f, c in functions.values():
        for g in ("sum", "count") if f == "avg" else (f,):
            parts[f"__{g}_{c}"] = (g, c)
    cut = _Cut(df, keys, order, hot_rows)
    carry = cut.before({n: _RUNNING[f][0](F.col(f"`{c}`")) for n, (f, c) in parts.items()}, {n: _RUNNING[f][1] for n, (f, _) in parts.items()})
    w = cut.in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.rows.select("*", *[_RUNNING[f][0](F.col(f"`{c}`")).over(w).alias(f"here{n}") for n, (f, c) in parts.items()])
    out = cut.joined(local, carry, list(parts))
    value = {n: _RUNNING[f][2](F.col(f"`here{n}`"), F.col(f"`{n}`")) for n, (f, _) in parts.items()}
    cols = [(F.try_divide(value[f"__sum_{c}"], value[f"__count_{c}"]) if f == "avg" else value[f"__{f}_{c}"]).alias(name)
            for name, (f, c) in functions.items()]
    return out.select(*[F.col(f"`{c}`") for c in cut.columns], *cols)


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str | None = None, dense_rank: str | None = None,
           percent_rank: str | None = None, cume_dist: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` + the named ranking functions.  They only depend on the key and
    the order, so they are computed on one row for each pair of them."""
    cols = [o.removeprefix("-") for o in order]
    here = df.select("*", key_struct(keys).alias(KEY), F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(cols)]).alias(ORDER))
    peers = here.groupBy(KEY, ORDER).agg(F.count(F.lit(1)).alias("__peers"))
    flat = peers.select(KEY, "__peers", *[F.col(f"{ORDER}.o{i}").alias(f"o{i}") for i in range(len(cols))])
    flat = flat.select(F.col(KEY).alias("k"), "__peers", *[f"o{i}" for i in range(len(cols))])
    signs = ["-" if o.startswith("-") else "" for o in order]
    spec = [f"{s}o{i}" for i, s in enumerate(signs)]
    done = running(flat, ["k"], spec, {"__to": ("sum", "__peers"), "__dense": ("count", "__peers")}, hot_rows)
    whole = here.groupBy(KEY).agg(F.count(F.lit(1)).alias("__whole"))
    done = done.select(F.col("k").alias(KEY), F.struct(*[f"o{i}" for i in range(len(cols))]).alias(ORDER), "__to", "__dense",
                       (F.col("__to") - F.col("__peers") + 1).alias("__rank")).join(whole, KEY)
    out = here.join(done, [KEY, ORDER])
    new = []
    if rank:
        new.append(F.col("__rank").cast("int").alias(rank))
    if dense_rank:
        new.append(F.col("__dense").cast("int").alias(dense_rank))
    if percent_rank:
        new.append(F.when(F.col("__whole") > 1, (F.col("__rank") - 1) / (F.col("__whole") - 1)).otherwise(0.0).alias(percent_rank))
    if cume_dist:
        new.append((F.col("__to") / F.col("__whole")).alias(cume_dist))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *new)


def framed(df: DataFrame, keys: list[str], order: list[Column | str], functions: dict[str, Callable],
           before: int = 0, after: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` + for each name ``function(window)``, a column that looks at most
    ``before`` rows back and ``after`` rows ahead: ``lambda w:
    F.lag("v").over(w)``, ``lambda w: F.sum("v").over(w.rowsBetween(-2, 0))``.
    Each bucket gets copies of its neighbours' nearest rows for the while."""
    cut = _Cut(df, keys, order, hot_rows)
    rows = cut.rows.withColumn("__own", F.lit(True))
    if cut.cuts is not None:
        for k, step in ((before, 1), (after, -1)):
            if k:
                rows = rows.unionByName(_edges(cut, k, step).withColumn("__own", F.lit(False)))
    out = rows.select("*", *[f(cut.in_bucket).alias(name) for name, f in functions.items()]).where("__own")
    return out.select(*[F.col(f"`{c}`") for c in cut.columns], *[F.col(f"`{n}`") for n in functions])


def _edges(cut: _Cut, k: int, step: int) -> DataFrame:
    """Copies of the last k rows before each bucket (``step`` 1), or of the
    first k behind it (-1), under that bucket's number."""
    hot = cut.hot()
    near = cut.order if step < 0 else (F.col(ORDER).asc() if cut.descending else F.col(ORDER).desc())
    edge = hot.withColumn("__r", F.row_number().over(Window.partitionBy(KEY, BUCKET).orderBy(near))).where(F.col("__r") <= k).drop("__r")
    # buckets are numbered in a row (each holds its cut's row), so k buckets hold k rows; mostly the next one does
    sizes = hot.groupBy(KEY, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(BUCKET).asc() if step > 0 else F.col(BUCKET).desc()
    reach = 1
    while reach < k:
        w = Window.partitionBy(KEY).orderBy(order).rowsBetween(-reach, -1)
        short = sizes.select("*", F.sum("__n").over(w).alias("__s"), F.count("__n").over(w).alias("__c"))
        if short.where((F.col("__c") == reach) & (F.col("__s") < k)).isEmpty():
            break
        reach += 1
    moved = edge.withColumn("__to", F.explode(F.sequence(F.lit(1), F.lit(reach)))) \
        .withColumn(BUCKET, F.col(BUCKET) + F.col("__to") * step).drop("__to").join(sizes.select(KEY, BUCKET), [KEY, BUCKET], "left_semi")
    w = Window.partitionBy(KEY, BUCKET).orderBy(near)
    return moved.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def ranged(df: DataFrame, keys: list[str], order: str, functions: dict[str, tuple[str, str]], before, after,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` + for each name (sum | count | avg, column) over RANGE BETWEEN
    ``before`` PRECEDING AND ``after`` FOLLOWING of the numeric ascending
    column ``order`` (rows with a NULL order frame each other, as in SQL).

    One running sum over the distinct orders, looked up at both ends of each
    distinct frame: however many rows a frame spans, they are not copied."""
    from tablework.operators.joins import asof_join

    names = ["k"]  # all keys as one struct, so that NULL keys meet
    base = df.select(key_struct(keys).alias("k"), F.col(f"`{order}`").alias("o"),
                     *[F.col(f"`{c}`").alias(f"v{i}") for i, (_, c) in enumerate(functions.values())])
    parts = [(f, i) for i in range(len(functions)) for f in ("sum", "count")]
    peers = base.groupBy(*names, "o").agg(*[_RUNNING[f][0](f"v{i}").alias(f"{f}{i}") for f, i in parts])
    known = peers.where("o is not null")
    total = running(known, names, ["o"], {f"to_{f}{i}": ("sum", f"{f}{i}") for f, i in parts}, hot_rows)
    totals = [f"to_{f}{i}" for f, i in parts]
    # up to the frame's end, less what lies below its start; orders below the start are found as those < o - before
    ends = known.select(*names, "o", (F.col("o") + F.lit(after)).alias("at"))
    upper = asof_join(ends, total.select(*names, F.col("o").alias("t"), *totals), names, "at", "t", how="left", right_prefix="hi_", hot_rows=hot_rows)
    starts = upper.withColumn("at", F.col("o") - F.lit(before))
    both = asof_join(starts, total.select(*names, F.col("o").alias("t"), *totals), names, "at", "t", how="left", right_prefix="lo_",
                     hot_rows=hot_rows, strict=True)
    frame = [(F.col(f"hi_to_{f}{i}") - F.coalesce(f"lo_to_{f}{i}", F.lit(0))).alias(f"{f}{i}") for f, i in parts]
    frames = both.select(*names, "o", *frame).unionByName(peers.where("o is null").select(*names, "o", *[f"{f}{i}" for f, i in parts]))
    here = df.select("*", key_struct(keys).alias(KEY), F.struct(F.col(f"`{order}`").alias("o")).alias(ORDER))
    found = frames.select(F.col("k").alias(KEY), F.struct("o").alias(ORDER), *[f"{f}{i}" for f, i in parts])
    out = here.join(found, [KEY, ORDER])
    cols = []
    for i, (name, (f, _)) in enumerate(functions.items()):
        seen = F.when(F.col(f"count{i}") > 0, F.col(f"sum{i}"))
        cols.append({"sum": seen, "count": F.col(f"count{i}"), "avg": F.try_divide(seen, F.col(f"count{i}"))}[f].alias(name))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *cols)
