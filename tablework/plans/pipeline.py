"""Declarative pipelines (P1-P6): N file sources + one SQL transform + one
output table.

A pipeline document in any of the three dialects the reference wrote
(``path`` + ``mode: csv_folder``; ``folder_path``/``file_path`` +
``file_pattern``; README ``mode: folder|file``) is normalised into a
:class:`PipelineSpec`.  Running it reads every source as one Spark read per
header group (``tablework.sources.readers``), registers it as a table or a
view, runs the SQL with ``spark.sql`` and writes the output table (K16 =
replace).  No data reaches the driver; the per-step row counts are one
``count()`` per written table (parquet answers it from file footers).
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: source modes of the three pipeline dialects ---------------
FOLDER_MODES = ("csv_folder", "excel_folder", "folder")
FILE_MODES = ("single_file", "csv_file", "excel_file", "file")
# ---------------------------------------------------------------------------

_FILE_TYPES = {"csv": "csv", "tsv": "tsv", "txt": "txt", "excel": "excel", "xlsx": "excel",
               "xlsm": "excel", "json": "json", "jsonl": "json", "parquet": "parquet",
               "table": "table"}


@dataclass(frozen=True)
class SourceSpec:
    path: str
    table_name: str
    mode: str = "folder"            # folder | file | table
    file_type: str = "csv"
    file_pattern: str | None = None
    sheet: str | int | None = None  # None = first sheet; "*" = all sheets; name or index
    load: str = "replace"           # replace | append | view
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineSpec:
    sources: tuple[SourceSpec, ...]
    sql_query: str | None = None
    output_table: str | None = None
    name: str = "pipeline"
    description: str = ""
    on_error: str = "stop"          # stop | skip

    def validate(self) -> None:
        """Table names must be unique (case-insensitive) before any job runs."""
        seen = set()
        for s in self.sources:
            k = s.table_name.lower()
            if k in seen:
                raise ValueError(f"duplicate source table name {s.table_name!r}")
            seen.add(k)
        if self.on_error not in ("stop", "skip"):
            raise ValueError("on_error must be 'stop' or 'skip'")


def _infer_type(path: str, declared: str | None) -> str:
    if declared:
        return _FILE_TYPES.get(declared.lower(), declared.lower())
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "csv"
    return _FILE_TYPES.get(ext, "csv")


def _sheet_of(src: dict):
    sel = (src.get("sheet_selection") or "").lower()
    if sel.startswith("all"):
        return "*"
    if sel.startswith("specific"):
        return src.get("sheet_name") or None
    return src.get("sheet")


def parse_source(src: dict) -> SourceSpec:
    """Normalise one source entry of any dialect."""
    mode = (src.get("mode") or "").lower()
    path = src.get("path") or src.get("folder_path") or src.get("file_path")
    if not path or not src.get("table_name"):
        raise ValueError(f"source needs a path and a table_name: {src}")
    if mode in FOLDER_MODES or (not mode and "folder_path" in src):
        kind = "folder"
    elif mode in FILE_MODES or (not mode and "file_path" in src):
        kind = "file"
    elif mode == "table":
        kind = "table"
    else:
        kind = "folder" if not re.search(r"\.[A-Za-z0-9]+$", path) else "file"
    ftype = src.get("file_type")
    if not ftype and mode.startswith("excel"):
        ftype = "excel"
    return SourceSpec(path=path, table_name=src["table_name"], mode=kind,
                      file_type=_infer_type(path, ftype), file_pattern=src.get("file_pattern"),
                      sheet=_sheet_of(src), load=src.get("load", "replace"),
                      options=dict(src.get("options", {})))


_CREATE = r"(?i)\s*create\s+(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?([A-Za-z0-9_.`\"]+)"


def _output_from_sql(sql: str | None) -> str | None:
    """``CREATE TABLE x`` on the first line names the output."""
    if not sql:
        return None
    first = sql.strip().splitlines()[0].strip()
    m = re.match(_CREATE, first)
    return m.group(1).replace("`", "").replace('"', "").rstrip(";") if m else None


def parse_pipeline(doc: dict | str, name: str | None = None) -> PipelineSpec:
    """A pipeline document (dict or JSON text) -> :class:`PipelineSpec`."""
    if isinstance(doc, str):
        doc = json.loads(doc)
    sources = tuple(parse_source(s) for s in doc.get("sources", []))
    sql = (doc.get("sql_query") or "").strip() or None
    pname = name or doc.get("name") or "pipeline"
    out = doc.get("output_table") or _output_from_sql(sql)
    if sql and not out:
        out = f"{re.sub(r'[^A-Za-z0-9_]', '_', pname)}_result"
    spec = PipelineSpec(sources=sources, sql_query=sql, output_table=out, name=pname,
                        description=doc.get("description", ""),
                        on_error=doc.get("on_error", "stop"))
    spec.validate()
    return spec


def load_source(spark: SparkSession, src: SourceSpec) -> DataFrame:
    """One source -> one DataFrame (cleaned names, lineage, unified schema)."""
    from tablework.sources import readers

    if src.mode == "table":
        return spark.table(src.path)
    opts = {k: v for k, v in src.options.items() if k not in ("partition_by", "bucket_by")}
    if src.file_pattern:
        opts.setdefault("pattern", src.file_pattern)
    if src.file_type == "excel":
        opts.setdefault("sheet", src.sheet)
    df, _report = readers.read_files(spark, src.path, file_type=src.file_type, **opts)
    return df


def _strip_create(sql: str, output: str | None) -> str:
    """The transform is the SELECT; a leading ``CREATE TABLE x AS`` is the output."""
    m = re.match(_CREATE + r"\s+as\b\s*((?s:.*))$", sql)
    body = m.group(2) if m else sql
    return body.strip().rstrip(";").strip()


def run_pipeline(spark: SparkSession, spec: PipelineSpec | dict | str,
                 database: str | None = None) -> dict:
    """Load every source, run the SQL, write the output table.

    Returns the reference's result record: sources_processed, total_rows,
    tables_created, output_table, output_rows, execution_time, errors.
    Sources with ``load="view"`` are registered as temp views (no copy);
    others are written as tables (K2 replace / K4 append).  The views by
    which the SQL finds the sources go when its output is written, and views
    of the same names that were there before come back; without SQL the
    ``load="view"`` ones are the result and stay.
    """
    if not isinstance(spec, PipelineSpec):
        spec = parse_pipeline(spec)
    spec.validate()
    t0 = time.time()
    result = {"sources_processed": 0, "total_rows": 0, "tables_created": [],
              "output_table": None, "output_rows": 0, "execution_time": 0.0, "errors": []}
    views = _Views(spark)
    try:
        _run(spark, spec, database, views, result)
    finally:
        views.restore(keep=() if spec.sql_query else {s.table_name for s in spec.sources if s.load == "view"})
    result["execution_time"] = round(time.time() - t0, 3)
    return result


class _Views:
    """Temp views made for a while: what they hid comes back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.before: dict[str, DataFrame | None] = {}

    def make(self, df: DataFrame, name: str) -> None:
        if name not in self.before:
            there = any(t.isTemporary and t.name.lower() == name.lower() for t in self.spark.catalog.listTables())
            self.before[name] = self.spark.table(f"`{name}`") if there else None
        df.createOrReplaceTempView(name)

    def restore(self, keep=()) -> None:
        for name, df in self.before.items():
            if name in keep:
                continue
            if df is not None:
                df.createOrReplaceTempView(name)
            else:
                self.spark.catalog.dropTempView(name)


def _run(spark: SparkSession, spec: PipelineSpec, database: str | None, views: _Views, result: dict) -> None:
    from tablework.sinks import tables

    for src in spec.sources:
        try:
            df = load_source(spark, src)
            target = f"{database}.{src.table_name}" if database else src.table_name
            if src.load == "view":
                views.make(df, src.table_name)
                rows = None
            else:
                layout = {k: src.options[k] for k in ("partition_by", "bucket_by") if k in src.options}
                tables.write_table(df, target, mode=src.load, **layout)
                rows = spark.table(target).count()
                views.make(spark.table(target), src.table_name)
                result["tables_created"].append(target)
            result["sources_processed"] += 1
            result["total_rows"] += rows or 0
        except Exception as e:  # P6
            result["errors"].append({"source": src.table_name, "error": f"{type(e).__name__}: {e}"})
            if spec.on_error == "stop":
                raise
    if spec.sql_query:
        out = spec.output_table
        target = f"{database}.{out}" if database and "." not in out else out
        tables.write_table(spark.sql(_strip_create(spec.sql_query, out)), target, mode="replace")
        result["output_table"] = target
        result["output_rows"] = spark.table(target).count()
