"""Row and value cleaning.

Every operator is one projection and/or one filter over the input, so a
whole sanitising chain compiles into a single whole-stage-codegen stage with
no shuffle.  ``narrow_types`` and ``validate`` need statistics: each is one
aggregation (partial + final; the final input is one row per partition).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators.names import dedupe_names
from tablework.operators.schema import LINEAGE_COLUMNS

# --- fixed values: must equal the reference's behaviour ----------------------
NULL_TOKENS = ("nan", "NaN", "None", "null", "NULL", "")
INFINITY_TOKENS = {"inf": "infinity", "Infinity": "infinity",
                   "-inf": "-infinity", "-Infinity": "-infinity"}
MAX_TEXT_LEN = 10000
TRUNCATION_MARKER = "...[truncated]"
LARGE_ROW_WARNING = 1_000_000
MANY_COLUMNS_WARNING = 100
LONG_TABLE_NAME = 50
# ---------------------------------------------------------------------------


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _data_columns(df: DataFrame, exclude=LINEAGE_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in exclude]


# ----------------------------------------------------------- value operators
def null_tokens_expr(c: Column, tokens=NULL_TOKENS) -> Column:
    """Values spelled like a null become NULL."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def infinity_expr(c: Column, mapping=None) -> Column:
    """C11: ``inf``/``Infinity`` -> ``infinity``; ``-inf``/``-Infinity`` -> ``-infinity``."""
    mapping = INFINITY_TOKENS if mapping is None else mapping
    out = c
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def control_chars_expr(c: Column) -> Column:
    """Drop NUL, CRLF and lone CR -> LF (literal replacements)."""
    for old, new in (("\u0000", ""), ("\r\n", "\n"), ("\r", "\n")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def truncate_expr(c: Column, max_len: int = MAX_TEXT_LEN, marker: str = TRUNCATION_MARKER) -> Column:
    """Texts longer than ``max_len`` characters keep ``max_len`` characters
    plus the marker.  A value already in that form is left alone, so the
    operator is idempotent."""
    already = (F.length(c) == max_len + len(marker)) & c.endswith(F.lit(marker))
    return F.when((F.length(c) > max_len) & ~already,
                  F.concat(F.substring(c, 1, max_len), F.lit(marker))).otherwise(c)


def nan_inf_to_null_expr(c: Column) -> Column:
    """Numeric NaN / +-infinity -> NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def sanitize_value_expr(c: Column, tokens=NULL_TOKENS, max_len: int = MAX_TEXT_LEN) -> Column:
    """C10 -> C11 -> C12 -> C13 on one string column."""
    s = c.cast("string")
    s = infinity_expr(null_tokens_expr(s, tokens))
    return truncate_expr(control_chars_expr(s), max_len)


# ------------------------------------------------------------- df operators
def sanitize(df: DataFrame, tokens=NULL_TOKENS, max_len: int = MAX_TEXT_LEN,
             exclude=LINEAGE_COLUMNS, drop_empty: bool = True) -> DataFrame:
    """C14: names trimmed and deduplicated, every data column to sanitised
    text, rows with only NULL data dropped.  One narrow stage."""
    names = []
    for i, c in enumerate(df.columns):
        n = c.strip() if c is not None else ""
        names.append(n if n else f"col_{i}")
    names = dedupe_names(names)
    out = df.toDF(*names)
    data = [n for c, n in zip(df.columns, names) if c not in exclude]
    if drop_empty and data:
        # a row will be empty exactly when each raw cell is NULL or spelled like it: tested before the work
        out = out.where(~F.forall(F.array(*[_q(n).cast("string") for n in data]), lambda c: c.isNull() | c.isin(*tokens)))
    # a projection per step: each step's value is computed once, however often the next refers to it
    for step in (lambda c: _spelled(c.cast("string"), tokens), control_chars_expr, lambda c: truncate_expr(c, max_len)):
        out = out.select(*[step(_q(n)).alias(n) if n in data else _q(n) for n in names])
    return out


def _spelled(c: Column, tokens=NULL_TOKENS) -> Column:
    """C10 and C11 in one CASE (no infinity is spelled like a null)."""
    out = F.when(c.isin(*tokens), F.lit(None).cast("string"))
    for new in dict.fromkeys(INFINITY_TOKENS.values()):
        out = out.when(c.isin(*[k for k, v in INFINITY_TOKENS.items() if v == new]), F.lit(new))
    return out.otherwise(c)


def apply_to_strings(df: DataFrame, fn, exclude=LINEAGE_COLUMNS) -> DataFrame:
    """Apply a Column -> Column function to every string data column."""
    cols = []
    for f in df.schema.fields:
        if f.name not in exclude and isinstance(f.dataType, T.StringType):
            cols.append(fn(_q(f.name)).alias(f.name))
        else:
            cols.append(_q(f.name))
    return df.select(*cols)


def replace_null_tokens(df: DataFrame, tokens=NULL_TOKENS, exclude=LINEAGE_COLUMNS) -> DataFrame:
    return apply_to_strings(df, lambda c: null_tokens_expr(c, tokens), exclude)


def normalize_infinity(df: DataFrame, exclude=LINEAGE_COLUMNS) -> DataFrame:
    return apply_to_strings(df, infinity_expr, exclude)


def strip_control_chars(df: DataFrame, exclude=LINEAGE_COLUMNS) -> DataFrame:
    return apply_to_strings(df, control_chars_expr, exclude)


def truncate_texts(df: DataFrame, max_len: int = MAX_TEXT_LEN, exclude=LINEAGE_COLUMNS) -> DataFrame:
    return apply_to_strings(df, lambda c: truncate_expr(c, max_len), exclude)


def numeric_nan_to_null(df: DataFrame) -> DataFrame:
    """C19 on every float/double column."""
    cols = [nan_inf_to_null_expr(_q(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else _q(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def drop_empty_rows(df: DataFrame, exclude=LINEAGE_COLUMNS) -> DataFrame:
    """Drop rows whose data columns are all NULL (lineage ignored)."""
    data = _data_columns(df, exclude)
    if not data:
        return df
    return df.dropna(how="all", subset=data)


def drop_header_rows(df: DataFrame, exclude=LINEAGE_COLUMNS) -> DataFrame:
    """Drop rows whose every data cell equals its column name (NULL never equals)."""
    data = _data_columns(df, exclude)
    if not data:
        return df
    is_header = None
    for c in data:
        e = F.coalesce(_q(c).cast("string") == F.lit(c), F.lit(False))
        is_header = e if is_header is None else (is_header & e)
    return df.where(~is_header)


def fill_missing(df: DataFrame, value, exclude=LINEAGE_COLUMNS) -> DataFrame:
    """Fill NULLs with ``value`` in every data column, casting the value to
    each column's type (columns where the cast fails stay as they are)."""
    cols = []
    for f in df.schema.fields:
        if f.name in exclude:
            cols.append(_q(f.name))
        else:
            if isinstance(f.dataType, T.StringType):
                fill = F.lit(str(value))
            else:  # a constant: folded once by the optimizer
                fill = F.expr(f"try_cast({_sql_literal(value)} AS {f.dataType.simpleString()})")
            cols.append(F.coalesce(_q(f.name), fill).alias(f.name))
    return df.select(*cols)


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def quick_clean(df: DataFrame, exclude=LINEAGE_COLUMNS) -> DataFrame:
    """Trimmed names (blank -> ``col_i``), unique names, no all-NULL rows."""
    names = []
    for i, c in enumerate(df.columns):
        n = c.strip() if c is not None else ""
        names.append(n if n else f"col_{i}")
    return drop_empty_rows(df.toDF(*dedupe_names(names)), exclude)


# --------------------------------------------------------------- narrowing
# Only texts that a number gives back: no leading zeros or signs, no closing
# zeros but the one of "1.0", at most the 15 digits that a double holds, and
# exponents as a double is written; other texts (codes, long ids) stay text.
INTEGER_PATTERN = r"^(0|-?[1-9][0-9]{0,18})$"
NUMBER_PATTERN = (r"^(?!-0$)-?(?:0|[1-9][0-9]{0,14})(?:\.(?:0|[0-9]*[1-9]))?$"
                  r"|^-?[1-9]\.[0-9]+E-?[0-9]{1,3}$|^(?i:-?inf(?:inity)?|nan)$")
# A column of texts with one number of decimals ("12.50") becomes DECIMAL.
DECIMAL_PATTERN = r"^(?!-0\.0*$)-?(?:0|[1-9][0-9]*)\.[0-9]+$"
_INT_RANGES = (("tinyint", -128, 127), ("smallint", -32768, 32767),
               ("int", -2147483648, 2147483647), ("bigint", None, None))
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def _narrow_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregation: per column non-null count, integer/double parse counts,
    integer range, float-lossless count, decimal places.  The casts are a
    projection below it, so each is made once.  Returns one row per column."""
    cast, aggs = [], []
    for i, c in enumerate(columns):
        f = df.schema[c]
        x = _q(c)
        places = F.lit(None).cast("int")
        if isinstance(f.dataType, T.StringType):
            # gate the casts with a pattern: a failing cast raises and catches
            # an exception per value, which costs far more than the match
            as_long = F.when(x.rlike(INTEGER_PATTERN), F.expr(f"try_cast(`{c}` AS BIGINT)"))
            number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
            given_back = F.when(x.contains("E"), number.cast("string") == x).otherwise(F.length(F.translate(x, "-.", "")) <= 15)
            as_dbl = F.when(x.rlike(NUMBER_PATTERN) & given_back, number)
            places = F.when(x.contains(".") & x.rlike(DECIMAL_PATTERN) & (F.length(x) <= 38), F.length(x) - F.instr(x, "."))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            as_long = x.cast("bigint")
            as_dbl = x.cast("double")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            d = x.cast("double")
            as_long = F.when(d == F.floor(d), F.expr(f"try_cast(`{c}` AS BIGINT)"))
            as_long = F.lit(None).cast("bigint") if not isinstance(f.dataType, T.DecimalType) else as_long
            as_dbl = d
        else:
            as_long = F.lit(None).cast("bigint")
            as_dbl = F.lit(None).cast("double")
        width = F.length(F.translate(x.cast("string"), "-.", "")) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("int")
        cast += [x.isNotNull().alias(f"x{i}"), as_long.alias(f"l{i}"), as_dbl.alias(f"d{i}"), places.alias(f"p{i}"),
                 F.when(places.isNotNull(), width).alias(f"w{i}")]
        as_dbl = F.col(f"d{i}")
        aggs += [
            F.count_if(f"x{i}").alias(f"n{i}"),
            F.count(f"l{i}").alias(f"l{i}"),
            F.count(as_dbl).alias(f"d{i}"),
            F.min(f"l{i}").alias(f"mn{i}"),
            F.max(f"l{i}").alias(f"mx{i}"),
            F.count_if(as_dbl.cast("float").cast("double") == as_dbl).alias(f"f{i}"),
            F.count(f"p{i}").alias(f"dp{i}"), F.min(f"p{i}").alias(f"pn{i}"), F.max(f"p{i}").alias(f"px{i}"), F.max(f"w{i}").alias(f"w{i}"),
        ]
    wide = df.select(*cast).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("from_type"),
                     F.col(f"n{i}").alias("n_non_null"), F.col(f"l{i}").alias("n_integer"),
                     F.col(f"d{i}").alias("n_numeric"), F.col(f"mn{i}").alias("min_integer"),
                     F.col(f"mx{i}").alias("max_integer"), F.col(f"f{i}").alias("n_float_exact"),
                     F.when((F.col(f"dp{i}") == F.col(f"n{i}")) & (F.col(f"pn{i}") == F.col(f"px{i}")),
                            F.concat(F.lit("decimal("), F.col(f"w{i}"), F.lit(","), F.col(f"px{i}"), F.lit(")"))).alias("_decimal"))
            for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def narrow_type_expr() -> Column:
    """Chosen type from the statistics columns of :func:`narrow_report`."""
    n, li, d = F.col("n_non_null"), F.col("n_integer"), F.col("n_numeric")
    mn, mx, fl = F.col("min_integer"), F.col("max_integer"), F.col("n_float_exact")
    int_choice = None
    for name, lo, hi in _INT_RANGES:
        cond = F.lit(True) if lo is None else ((mn >= lo) & (mx <= hi))
        int_choice = F.when(cond, F.lit(name)) if int_choice is None else int_choice.when(cond, F.lit(name))
    return (F.when(n == 0, F.col("from_type"))
            .when(li == n, int_choice)
            .when((d == n) & (fl == n), F.lit("float"))
            .when(d == n, F.lit("double"))
            .otherwise(F.coalesce("_decimal", "from_type")))


def narrow_report(df: DataFrame, columns: list[str] | None = None,
                  exclude=LINEAGE_COLUMNS) -> DataFrame:
    """C7 report: DataFrame(column_name, from_type, statistics..., to_type).

    Text becomes numeric only when every non-NULL value converts and is given
    back by the number; texts with one number of decimals that end in zeros
    ("12.50") become DECIMAL; doubles
    become float only when every value survives the round trip exactly;
    integers take the narrowest of tinyint/smallint/int/bigint.
    """
    cols = columns or [f.name for f in df.schema.fields
                       if f.name not in exclude and isinstance(f.dataType, _NUMERIC + (T.StringType,))]
    return _narrow_stats(df, cols).withColumn("to_type", narrow_type_expr()).drop("_decimal")


def narrow_types(df: DataFrame, columns: list[str] | None = None,
                 exclude=LINEAGE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Returns (narrowed DataFrame, report).  The report is one row per
    column, so bringing it to the driver to build the projection is bounded
    by the column count."""
    report = narrow_report(df, columns, exclude)
    choice = {r["column_name"]: r["to_type"] for r in report.select("column_name", "to_type").collect()}
    cols = []
    for f in df.schema.fields:
        t = choice.get(f.name)
        if t is None or t == f.dataType.simpleString():
            cols.append(_q(f.name))
        else:
            cols.append(F.expr(f"try_cast(`{f.name}` AS {t})").alias(f.name))
    return df.select(*cols), report


# -------------------------------------------------------------- validation
def validate(df: DataFrame, table_name: str | None, mode: str = "create",
             table_exists: bool | None = None, exclude=LINEAGE_COLUMNS) -> DataFrame:
    """C17: DataFrame(level, code, message) of import errors and warnings.

    Name checks are metadata; the row count is one bounded job
    (``limit(LARGE_ROW_WARNING + 1).count()`` - it stops reading once the
    threshold is passed).
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in exclude]
    folded = Counter(c.lower() for c in cols)
    repeated = sorted(c for c in set(cols) if folded[c.lower()] > 1)
    awkward = [repr(c) for c in cols if not c.strip() or c.strip()[0].isdigit()]
    name = (table_name or "").strip()
    rows = df.limit(LARGE_ROW_WARNING + 1).count()
    known = True
    if name and mode in ("append", "replace"):
        known = spark.catalog.tableExists(name) if table_exists is None else table_exists
    # level, code, whether it applies, message
    rules = [
        ("error", "empty", rows == 0, "there are no rows to load"),
        ("error", "no_columns", not cols, "there are no data columns"),
        ("error", "empty_table_name", not name, "a table name is needed"),
        ("error", "append_target_missing", not known and mode == "append", f"append needs table {name}, which is not there"),
        ("warning", "replace_target_missing", not known and mode == "replace", f"table {name} is not there and will be made"),
        ("warning", "long_table_name", len(name) > LONG_TABLE_NAME, f"table name of {len(name)} characters will be cut"),
        ("warning", "duplicate_columns", bool(repeated), "repeated column names get a suffix: " + ", ".join(repeated)),
        ("warning", "problem_column_names", bool(awkward), "column names to be cleaned: " + ", ".join(awkward)),
        ("warning", "large", rows > LARGE_ROW_WARNING, f"over {LARGE_ROW_WARNING:,} rows"),
        ("warning", "many_columns", len(cols) > MANY_COLUMNS_WARNING, f"{len(cols)} columns"),
    ]
    return spark.createDataFrame([(level, code, text) for level, code, applies, text in rules if applies],
                                 "level string, code string, message string")
