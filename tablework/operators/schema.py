"""Schema unification across drifting inputs.

All of these are projections over DataFrames: computing a target column list
from schemas (driver metadata) and one ``select`` per input.  Unions are
positional after every input has been projected to the same target list, so
they add no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAGE_COLUMNS = ("_source_file", "_source_sheet")

# ------------------------------------------------------------------ type map
# Host (pandas/numpy) dtype name -> SQL type name, by target database.
# Fixed values.
DUCKDB_TYPES = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INTEGER", "int64": "BIGINT", "float32": "REAL",
    "float64": "DOUBLE", "bool": "BOOLEAN", "object": "VARCHAR", "datetime64[ns]": "TIMESTAMP", "category": "VARCHAR",
}
SQLITE_TYPES = {
    "int8": "INTEGER", "int16": "INTEGER", "int32": "INTEGER", "int64": "INTEGER", "float32": "REAL",
    "float64": "REAL", "bool": "INTEGER", "object": "TEXT", "datetime64[ns]": "TEXT", "category": "TEXT",
}

# SQL type spellings advertised by the reference -> Spark DDL type.
SQL_TO_SPARK = {
    "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "SMALLINT": "smallint",
    "TINYINT": "tinyint", "VARCHAR": "string", "CHAR": "string", "TEXT": "string",
    "STRING": "string", "CLOB": "string", "NVARCHAR": "string", "NCHAR": "string",
    "UUID": "string", "XML": "string", "JSON": "string", "JSONB": "string",
    "REAL": "float", "FLOAT": "double", "DOUBLE": "double", "NUMERIC": "decimal(38,9)",
    "DECIMAL": "decimal(38,9)", "MONEY": "decimal(19,4)", "DATE": "date",
    "TIMESTAMP": "timestamp", "DATETIME": "timestamp_ntz", "YEAR": "int",
    "BOOLEAN": "boolean", "BOOL": "boolean", "BIT": "boolean", "BLOB": "binary",
    "BINARY": "binary", "VARBINARY": "binary",
}


def host_type_to_sql(host_type: str, db: str = "duckdb") -> str:
    """Map a pandas dtype name to the SQL type the reference would use."""
    types, other = (DUCKDB_TYPES, "VARCHAR") if db == "duckdb" else (SQLITE_TYPES, "TEXT")
    return types.get(str(host_type).lower(), other)


def spark_type_for_sql(sql_type: str) -> str:
    """Spark DDL type for an advertised SQL type name (``DECIMAL(10,2)`` kept)."""
    t = sql_type.strip().upper()
    if t.startswith(("DECIMAL(", "NUMERIC(")):
        return "decimal" + t[t.index("("):].lower()
    if t.startswith(("VARCHAR(", "CHAR(")):
        return "string"
    try:
        return SQL_TO_SPARK[t]
    except KeyError:
        raise ValueError(f"no Spark type for SQL type {sql_type!r}") from None


# ------------------------------------------------------------------ widening
_INTEGRAL_ORDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def widen_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """U10 lattice: equal -> keep; integers widen; any float -> double;
    decimals widen; integer+decimal -> decimal that holds both; date+timestamp
    -> timestamp; NullType yields the other; everything else -> string."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    integral = tuple(_INTEGRAL_ORDER)
    if isinstance(a, integral) and isinstance(b, integral):
        ia = next(i for i, t in enumerate(_INTEGRAL_ORDER) if isinstance(a, t))
        ib = next(i for i, t in enumerate(_INTEGRAL_ORDER) if isinstance(b, t))
        return _INTEGRAL_ORDER[max(ia, ib)]()
    numeric = integral + (T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, numeric) and isinstance(b, numeric):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        da = a if isinstance(a, T.DecimalType) else T.DecimalType(20, 0)
        db = b if isinstance(b, T.DecimalType) else T.DecimalType(20, 0)
        scale = max(da.scale, db.scale)
        whole = max(da.precision - da.scale, db.precision - db.scale)
        if whole + scale > 38:
            return T.DoubleType()
        return T.DecimalType(whole + scale, scale)
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, temporal) and isinstance(b, temporal):
        if isinstance(a, T.TimestampType) or isinstance(b, T.TimestampType):
            return T.TimestampType()
        return T.TimestampNTZType()
    return T.StringType()


# --------------------------------------------------------------- unification
def target_columns(schemas: list[list[str]], order: str = "first_seen_then_sorted",
                   lineage: tuple = LINEAGE_COLUMNS) -> list[str]:
    """The unified column list of several inputs.

    ``sorted``: all data columns sorted; ``first_seen_then_sorted``: the first
    input's order, then the columns first seen later, sorted; ``first_seen``:
    order of first appearance.  Lineage columns always go last.  Names are
    matched case-insensitively (Spark semantics); the first spelling wins.
    """
    seen: dict[str, str] = {}
    first = []
    for i, cols in enumerate(schemas):
        for c in cols:
            if c in lineage:
                continue
            if c.lower() not in seen:
                seen[c.lower()] = c
                if i == 0:
                    first.append(c)
    rest = [c for k, c in seen.items() if c not in first]
    if order == "sorted":
        data = sorted(seen.values())
    elif order == "first_seen_then_sorted":
        data = first + sorted(rest)
    elif order == "first_seen":
        data = list(seen.values())
    else:
        raise ValueError(f"unknown order {order!r}")
    present = {c for cols in schemas for c in cols}
    return data + [c for c in lineage if c in present]


def unified_schema(dfs: list[DataFrame], order: str = "first_seen_then_sorted",
                   all_string: bool = False) -> T.StructType:
    names = target_columns([d.columns for d in dfs], order)
    types: dict[str, T.DataType] = {}
    for d in dfs:
        for f in d.schema.fields:
            k = f.name.lower()
            types[k] = widen_type(types[k], f.dataType) if k in types else f.dataType
    return T.StructType([
        T.StructField(n, T.StringType() if all_string else types[n.lower()], True) for n in names
    ])


def _pad(dtype: T.DataType, pad_value) -> Column:
    if pad_value is None:
        return F.lit(None).cast(dtype)
    return F.lit(pad_value).cast(dtype)


def align(df: DataFrame, schema: T.StructType | list[str], pad_value=None,
          cast: bool = True) -> DataFrame:
    """Project ``df`` onto ``schema``: present columns (cast), absent ones
    padded with NULL / ``pad_value``; columns not in the schema are dropped."""
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(n, T.StringType(), True) for n in schema])
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        if src is None:
            cols.append(_pad(f.dataType, pad_value).alias(f.name))
        elif cast and df.schema[src].dataType != f.dataType:
            cols.append(F.col(f"`{src}`").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f"`{src}`").alias(f.name))
    return df.select(*cols)


def union_by_name(dfs: list[DataFrame], order: str = "first_seen_then_sorted",
                  pad_value=None, all_string: bool = False) -> DataFrame:
    """U3 (+U4 with ``all_string``, U10 widening): union inputs by column name."""
    if not dfs:
        raise ValueError("nothing to union")
    schema = unified_schema(dfs, order, all_string)
    parts = [align(d, schema, pad_value) for d in dfs]
    return reduce(DataFrame.union, parts)


def missing_columns(table_schema: T.StructType | list[str], df: DataFrame) -> list[str]:
    """Columns of ``df`` that the table lacks (case-insensitive)."""
    names = table_schema.fieldNames() if isinstance(table_schema, T.StructType) else list(table_schema)
    have = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in have]


def column_mismatch_report(listing: DataFrame, columns_col: str = "columns",
                           file_col: str = "path") -> DataFrame:
    """Per file, which unified columns it lacks.

    ``listing`` has one row per file and an array of (cleaned) column names.
    The unified set is one aggregation used as a scalar subquery (one value:
    the distinct column names), fed to ``array_except`` per file.
    """
    exploded = listing.select(F.explode(columns_col).alias("_c")).distinct()
    allcols = exploded.agg(F.array_sort(F.collect_list("_c")).alias("_all")).scalar()
    missing = F.array_except(allcols, F.col(columns_col))
    return listing.select(file_col, columns_col, missing.alias("missing_columns"),
                          F.size(missing).alias("n_missing"))


def lineage_file_name() -> Column:
    """U8: the input file's name, decoded (``_metadata.file_name`` is
    URL-encoded except for ``+``)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def lineage_file_path() -> Column:
    """The input file's full path, decoded like :func:`lineage_file_name`."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def to_string_columns(df: DataFrame, exclude: tuple = LINEAGE_COLUMNS) -> DataFrame:
    """U4: every column to string (NULL stays NULL)."""
    return df.select(*[F.col(f"`{c}`") if c in exclude else F.col(f"`{c}`").cast("string").alias(c)
                       for c in df.columns])
