"""Result handling (R1-R6, R12, R13): run SQL, count, decide paging, pages,
sort, stable deep pages over a written snapshot.

No function here brings a result to the driver except :meth:`Snapshot.page`
/ :func:`fetch_page`, whose size the caller bounds.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from tablework.session import shared_dir

# --- fixed values: the reference's paging defaults ---------------------------
PAGE_THRESHOLD = 100_000     # eager below, paged above
PAGE_SIZE = 1_000
# ---------------------------------------------------------------------------


@dataclass
class SqlResult:
    df: DataFrame | None
    statement: str
    seconds: float
    kind: str          # "query" | "command"


def run_sql(spark: SparkSession, statements: str | list[str]) -> list[SqlResult]:
    """Run one statement or a list of statements with ``spark.sql``.

    Commands (DDL/DML) run eagerly inside ``spark.sql``; queries stay lazy.
    Every statement is handed to Spark as it is - nothing is wrapped in
    ``COUNT(*)`` - so DDL, DML and trailing semicolons work (defect 1 of the
    reference).  ``kind`` only labels the result by its leading keyword."""
    if isinstance(statements, str):
        statements = [statements]
    out = []
    for stmt in statements:
        text = stmt.strip().rstrip(";")
        t0 = time.time()
        df = spark.sql(text)
        first = text.split(None, 1)[0].upper() if text else ""
        kind = "query" if first in _QUERY_WORDS else "command"
        out.append(SqlResult(df, text, time.time() - t0, kind))
    return out


_QUERY_WORDS = {"SELECT", "WITH", "VALUES", "FROM", "TABLE", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "("}


def count_rows(df: DataFrame) -> DataFrame:
    """R2: ``SELECT count(*) FROM (q)`` as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def should_page(df: DataFrame, threshold: int = PAGE_THRESHOLD) -> bool:
    """More than ``threshold`` rows?  Stops reading after threshold + 1."""
    return df.limit(threshold + 1).count() > threshold


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types (no job)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def sort_result(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Order a result by one column, NULLs last in both directions."""
    c = F.col(f"`{column}`")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def shallow_page(df: DataFrame, order: list[Column], offset: int, size: int = PAGE_SIZE) -> DataFrame:
    """R4 for shallow pages: ``ORDER BY ... LIMIT size OFFSET offset``.
    The plan walks the skipped rows, so its cost grows with ``offset``."""
    return df.orderBy(*order).offset(offset).limit(size)


def observed_write(df: DataFrame, write) -> dict:
    """Run ``write(df)`` and return rows/seconds/rows-per-second from
    an ``Observation`` on the same pass (no second scan)."""
    obs = Observation("write_metrics")
    t0 = time.time()
    write(df.observe(obs, F.count(F.lit(1)).alias("rows")))
    secs = time.time() - t0
    rows = obs.get.get("rows", 0)
    return {"rows": rows, "seconds": round(secs, 3), "rows_per_second": round(rows / secs, 1) if secs else None}


@dataclass
class Snapshot:
    """H4 deep paging: the result is range-partitioned by the order keys,
    sorted within partitions and written once with its partition id and a
    per-partition increasing id.  Per-partition counts (one row per
    partition) give each partition's first global row number, so a page is a
    filter on one or two partition directories - never a walk over the
    skipped rows, and stable because it reads the written snapshot.
    """
    path: str
    df: DataFrame
    bases: list[tuple[int, int, int, int]] = field(default_factory=list)  # (pid, first_row, min_id, n)

    @property
    def total(self) -> int:
        return sum(b[3] for b in self.bases)

    def rows(self, start: int, stop: int) -> DataFrame:
        """Rows ``start <= _row <= stop`` (1-based, inclusive) with ``_row``."""
        conds, row_expr = [], None
        for pid, first, min_id, n in self.bases:
            last = first + n - 1
            if last < start or first > stop:
                continue
            lo_id = min_id + max(start - first, 0)
            hi_id = min_id + min(stop, last) - first
            conds.append((F.col("_pid") == pid) & F.col("_mid").between(lo_id, hi_id))
            e = F.lit(first) + F.col("_mid") - F.lit(min_id)
            row_expr = F.when(F.col("_pid") == pid, e) if row_expr is None else row_expr.when(F.col("_pid") == pid, e)
        if not conds:
            return self.df.limit(0).withColumn("_row", F.lit(None).cast("bigint")).drop("_pid", "_mid")
        cond = conds[0]
        for c in conds[1:]:
            cond = cond | c
        out = self.df.where(cond).withColumn("_row", row_expr.cast("bigint"))
        return out.drop("_pid", "_mid")

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (0-based) of ``size`` rows."""
        return self.rows(number * size + 1, (number + 1) * size)


@dataclass
class Reordered:
    """R6 on a snapshot: another order of the same written rows.  Only the
    order's columns and the rows' places were sorted and written; a page is a
    slice of that index, whose places are looked up in the snapshot."""
    snap: Snapshot
    index: Snapshot

    @property
    def total(self) -> int:
        return self.index.total

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (0-based) with ``_row``, its rows' numbers in this order."""
        spark = self.snap.df.sparkSession
        # at most ``size`` places; they go into the scan's filter, so that it only reads the Parquet pages that hold them
        places = [(r["_p"], r["_m"], r["_row"]) for r in self.index.page(number, size).select("_p", "_m", "_row").collect()]
        if not places:
            return self.snap.rows(1, 0)
        by_part: dict[int, list[Column]] = {}
        for p, m, _ in places:
            by_part.setdefault(p, []).append(F.col("_mid") == m)
        wanted = _any_of([(F.col("_pid") == p) & _any_of(ms) for p, ms in sorted(by_part.items())])
        rows = spark.createDataFrame(places, "_pid int, _mid long, _row long")
        return self.snap.df.where(wanted).join(F.broadcast(rows), ["_pid", "_mid"]).drop("_pid", "_mid")


def _any_of(conds: list[Column]) -> Column:
    """OR of conditions as a balanced tree (Spark walks it by recursion)."""
    while len(conds) > 1:
        conds = [a | b for a, b in zip(conds[::2], conds[1::2])] + conds[len(conds) - len(conds) % 2:]
    return conds[0]


def reorder(snap: Snapshot, order: list[str], descending: bool = False) -> Reordered:
    """Another order of a snapshot's rows (columns of one direction; ties keep
    the snapshot's order)."""
    by = [F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`").asc() for c in order]
    keys = snap.df.select(*dict.fromkeys(order), F.col("_pid").alias("_p"), F.col("_mid").alias("_m"))
    return Reordered(snap, snapshot(keys, [*by, F.col("_p"), F.col("_m")]))


def snapshot(df: DataFrame, order: list[Column | str], partitions: int | None = None,
             path: str | None = None) -> Snapshot:
    """Write ``df`` ordered by ``order`` (add a unique tie-breaker for stable
    pages) to the shared folder and index it for deep paging."""
    spark = df.sparkSession
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or shared_dir(spark, "snapshots")
    (df.repartitionByRange(n, *order)
       .sortWithinPartitions(*order)
       .withColumn("_pid", F.spark_partition_id())
       .withColumn("_mid", F.monotonically_increasing_id())
       .write.mode("errorifexists").partitionBy("_pid").parquet(path))
    snap = spark.read.parquet(path)
    stats = (snap.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("min_id"))
             .orderBy("_pid").collect())   # one row per partition
    bases, first = [], 1
    for r in stats:
        bases.append((int(r["_pid"]), first, int(r["min_id"]), int(r["n"])))
        first += int(r["n"])
    return Snapshot(path=path, df=snap, bases=bases)


@dataclass
class OpenResult:
    """R1 + R3 + R4 together: a small result is fetched whole (bounded by the
    threshold); a large one is snapshotted once and served page by page."""
    columns: list[tuple[str, str]]
    rows: list | None = None
    snap: Snapshot | None = None

    @property
    def paged(self) -> bool:
        return self.snap is not None

    def page(self, number: int, size: int = PAGE_SIZE) -> list:
        if self.snap is None:
            return self.rows[number * size:(number + 1) * size]
        return [r for r in self.snap.page(number, size).orderBy("_row").collect()]


def open_result(df: DataFrame, order: list[Column | str], threshold: int = PAGE_THRESHOLD) -> OpenResult:
    """Fetch at most ``threshold`` rows eagerly, otherwise page over a
    snapshot ordered by ``order`` (give a unique tie-breaker for stable pages)."""
    head = df.limit(threshold + 1).collect()
    if len(head) <= threshold:
        return OpenResult(columns_of(df), rows=head)
    return OpenResult(columns_of(df), snap=snapshot(df, order))
