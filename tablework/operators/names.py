"""Column- and table-name cleaning.

Names are schema metadata, so renaming one DataFrame works on ``df.columns``
on the driver (no job).  Listings of many files' headers (``describe_files``)
are cleaned with the equivalent Column expressions in one Spark job; both
forms implement the same rules and are cross-checked in the tests.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's behaviour ----------------------
# Policy names and their outputs for an empty name / a digit-first name.
UNNAMED_UPPER = "UNNAMED_COLUMN"
UNNAMED_LOWER = "unnamed_column"
DEFAULT_TABLE = "imported_table"
TRUNCATED_TABLE_LEN = 50
# Table names equal (case-insensitively) to one of these words get "tbl_".
SQL_RESERVED_TABLE_WORDS = {
    "select", "from", "where", "insert", "update", "delete", "create", "drop", "alter", "table", "index", "view",
    "database", "schema", "primary", "key", "foreign", "references", "constraint", "unique", "not", "null", "default",
    "check", "order", "by", "group", "having", "union", "join", "inner", "outer", "left", "right", "on", "as",
    "distinct", "count", "sum", "avg", "max", "min",
}
# ---------------------------------------------------------------------------

_TRIMMED = (r"^\s+|\s+$", "")
_WORDS = [_TRIMMED, (r"[^\w\s]", "_"), (r"\s+", "_"), (r"_+", "_"), (r"^_|_$", "")]
#: Policy -> (upper case first?, (pattern, replacement) steps); both forms below run it.
_COLUMN_STEPS = {
    "upper": (True, [(r" ", "_"), (r"[^A-Z0-9_]", ""), (r"^(?=[0-9])", "_"), (r"^$", UNNAMED_UPPER)]),
    "keep_case": (False, [*_WORDS, (r"^(?=\d)", "col_"), (r"^$", UNNAMED_LOWER)]),
    "upper_collapse": (True, [*_WORDS, (r"^(?=\d)", "COL_"), (r"^$", UNNAMED_UPPER)]),
    "ascii": (False, [_TRIMMED, (r"[^a-zA-Z0-9_]", "_"), (r"_+", "_"), (r"^_|_$", ""), (r"^(?=[0-9])", "col_"), (r"^$", UNNAMED_LOWER)]),
    "trim": (False, [_TRIMMED, (r"^$", UNNAMED_LOWER)]),
}
POLICIES = tuple(_COLUMN_STEPS)


def _policy(name: str):
    if name not in _COLUMN_STEPS:
        raise ValueError(f"unknown name policy {name!r}; use one of {POLICIES}")
    return _COLUMN_STEPS[name]


def clean_name(name, policy: str = "upper") -> str:
    """Clean one column name.

    * ``upper``: upper-case, space -> ``_``, drop ``[^A-Z0-9_]``, ``_`` prefix
      when the first character is not a letter/underscore, empty ->
      ``UNNAMED_COLUMN``.  ``First Name`` -> ``FIRST_NAME``.
    * ``keep_case``: strip, ``[^\\w\\s]`` -> ``_``, whitespace runs -> ``_``,
      collapse ``_`` runs, strip ``_``, digit-first -> ``col_`` prefix, empty ->
      ``unnamed_column`` (``\\w`` is Unicode).
    * ``upper_collapse``: ``keep_case`` then upper-case with ``COL_`` /
      ``UNNAMED_COLUMN``.
    * ``ascii``: like ``keep_case`` but with ``[^a-zA-Z0-9_]``.
    * ``trim``: strip only; blank -> ``unnamed_column``.
    """
    upper, steps = _policy(policy)
    n = "" if name is None else str(name)
    n = n.upper() if upper else n
    for pattern, new in steps:
        n = re.sub(pattern, new, n)
    return n


def clean_name_col(c: Column | str, policy: str = "upper") -> Column:
    """Column-expression form of :func:`clean_name` (Java regex, Unicode classes)."""
    upper, steps = _policy(policy)
    n = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    n = F.upper(n) if upper else n
    for pattern, new in steps:
        n = F.regexp_replace(n, "(?U)" + pattern, new)
    return n


def dedupe_names(names: list[str]) -> list[str]:
    """Make names unique case-insensitively (Spark resolves names that way).

    The first occurrence keeps its name; a later duplicate gets the first
    ``_k`` suffix (k = 1, 2, ...) that collides neither with a name already
    given nor with any original name, so ``a, A, a_1`` -> ``a, A_2, a_1``.
    """
    reserved = {n.lower() for n in names}
    used: set[str] = set()
    out = []
    for n in names:
        cand = n
        if cand.lower() in used:
            k = 1
            while True:
                cand = f"{n}_{k}"
                if cand.lower() not in used and cand.lower() not in reserved:
                    break
                k += 1
        used.add(cand.lower())
        out.append(cand)
    return out


def clean_names(names: list, policy: str = "upper", dedupe: bool = True) -> list[str]:
    """Clean a header list (C15 blank -> ``col_i`` under ``trim``), then dedupe."""
    cleaned = []
    for i, n in enumerate(names):
        if policy == "trim" and (n is None or not str(n).strip()):
            cleaned.append(f"col_{i}")
        else:
            cleaned.append(clean_name(n, policy))
    return dedupe_names(cleaned) if dedupe else cleaned


def rename_columns(df: DataFrame, policy: str = "upper", keep: tuple = ()) -> DataFrame:
    """Rename every column of ``df`` by ``policy``; ``keep`` names stay as is."""
    names = [c if c in keep else clean_name(c, policy) for c in df.columns]
    return df.toDF(*dedupe_names(names))


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Positional rename so that names are unique case-insensitively."""
    return df.toDF(*dedupe_names(list(df.columns)))


# ----------------------------------------------------------------- table names
#: C4 as one list of (pattern, replacement) steps; both forms below run it.
_TABLE_NAME_STEPS = [
    (r"^\s+|\s+$", ""), (r"[^\w\s]", "_"), (r"\s+", "_"), (r"_+", "_"), (r"^_|_$", ""), (r"^(?=\d)", "table_"),
    (r"^$", DEFAULT_TABLE), (rf"^(.{{{TRUNCATED_TABLE_LEN}}}).+$", r"\1"), (r"_+$", ""),
    (r"(?i)^(?=(" + "|".join(sorted(SQL_RESERVED_TABLE_WORDS)) + r")$)", "tbl_"),
]


def clean_table_name(name) -> str:
    """C4: table-name cleaning (lower case, <= 50 chars, reserved -> ``tbl_``)."""
    n = "" if name is None else str(name)
    for pattern, new in _TABLE_NAME_STEPS:
        n = re.sub(pattern, new, n)
    return n.lower()


def clean_table_name_col(c: Column | str) -> Column:
    """Column form of :func:`clean_table_name` for file listings."""
    n = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    for pattern, new in _TABLE_NAME_STEPS:
        n = F.regexp_replace(n, "(?U)" + pattern, new.replace("\\1", "$1"))
    return F.lower(n)


def table_name_from_file(file_name_col: Column | str) -> Column:
    """Suggested table name from a file name: stem (no extension), cleaned."""
    c = F.col(file_name_col) if isinstance(file_name_col, str) else file_name_col
    stem = F.regexp_replace(c, r"\.[^./]*$", "")
    return clean_table_name_col(stem)


#: Letters whose accent a catalog name loses; other non-ASCII ones become "_".
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"


def catalog_name_col(c: Column) -> Column:
    """A cleaned table name in the characters that the catalog takes: ASCII
    letters and digits and ``_``.  ASCII names stay as they are."""
    n = F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[^a-z0-9_]+", "_")
    return F.when(c.rlike("^[a-z0-9_]+$"), c).otherwise(clean_table_name_col(n))


def plan_table_names(files: DataFrame, existing: DataFrame | None = None,
                     file_col: str = "file_name", prefix: str = "") -> DataFrame:
    """C5 over a listing: one unique table name per file, as a Spark job.

    ``files`` has one row per file; ``existing`` has a ``name`` column with
    the catalog's table names.  Within a base name, files in path order take
    ``base``, then ``base_1``, ``base_2`` ... skipping names already used by
    the catalog or by another base in this listing (case-insensitive).
    Returns ``files`` + ``base_name`` + ``table_name``.
    """
    base = F.concat(F.lit(prefix), table_name_from_file(file_col)) if prefix else table_name_from_file(file_col)
    f = files.withColumn("base_name", catalog_name_col(F.lower(base)))
    taken = f.select(F.col("base_name").alias("name")).distinct()
    ex = None
    if existing is not None:
        ex = existing.select(F.lower("name").alias("name")).distinct()
        taken = taken.unionByName(ex).distinct()
    w = Window.partitionBy("base_name").orderBy(file_col)
    f = f.withColumn("_k", F.row_number().over(w) - 1)
    # the plain base is available unless the catalog already has it
    if ex is not None:
        plain_free = f.select("base_name").distinct().join(
            ex.withColumnRenamed("name", "base_name"), "base_name", "left_anti"
        ).withColumn("_plain_free", F.lit(1))
        f = f.join(plain_free, "base_name", "left").fillna({"_plain_free": 0})
    else:
        f = f.withColumn("_plain_free", F.lit(1))
    # candidates for suffixed names: base_1 .. base_(n + m + 1), where n is the
    # number of files with this base and m the number of taken names that look
    # like base_<digits> (each can block at most one candidate)
    counts = f.groupBy("base_name").agg(F.count(F.lit(1)).alias("_n"))
    collide = taken.withColumn("_b", F.regexp_extract("name", r"^(.*)_\d+$", 1)).where(F.col("_b") != "")
    extra = collide.groupBy(F.col("_b").alias("base_name")).agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.join(extra, "base_name", "left").fillna({"_m": 0})
    cand = counts.select(
        "base_name",
        F.explode(F.sequence(F.lit(1), F.col("_n") + F.col("_m") + F.lit(1))).alias("_s"),
    ).withColumn("name", F.concat_ws("_", "base_name", F.col("_s").cast("string")))
    cand = cand.join(taken, "name", "left_anti")
    cand = cand.withColumn("_r", F.row_number().over(Window.partitionBy("base_name").orderBy("_s")))
    # rank of each file among those that need a suffix
    f = f.withColumn("_needs", F.when((F.col("_k") == 0) & (F.col("_plain_free") == 1), 0).otherwise(1))
    f = f.withColumn("_r", F.when(F.col("_needs") == 1,
                                  F.col("_k") + 1 - F.col("_plain_free")))
    out = f.join(cand.select("base_name", "_r", F.col("name").alias("_suffixed")),
                 ["base_name", "_r"], "left")
    out = out.withColumn("table_name", F.when(F.col("_needs") == 0, F.col("base_name"))
                         .otherwise(F.col("_suffixed")))
    return out.drop("_k", "_r", "_needs", "_plain_free", "_suffixed")
