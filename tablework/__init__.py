"""tablework: messy tabular folders -> clean Spark tables, SQL, pages and exports.

Every data step is a Spark DataFrame / SQL / Structured Streaming job.
Python on executors is limited to probing files (heads, encoding
confirmation) and the xlsx container format.

The names below are the user-facing surface; everything is importable from
its module as well.
"""

from tablework.session import get_session, shared_dir

__version__ = "0.1.0"

_LAZY = {
    # sources
    "read_files": "tablework.sources.readers", "read_csv": "tablework.sources.readers",
    "read_tsv": "tablework.sources.readers", "read_txt": "tablework.sources.readers",
    "read_json": "tablework.sources.readers", "read_parquet": "tablework.sources.readers",
    "read_table": "tablework.sources.readers", "read_excel": "tablework.sources.xlsx",
    "describe_files": "tablework.sources.probe", "describe_workbooks": "tablework.sources.probe",
    "list_files": "tablework.sources.probe",
    # operators
    "rename_columns": "tablework.operators.names", "dedupe_columns": "tablework.operators.names",
    "clean_name": "tablework.operators.names", "clean_table_name": "tablework.operators.names",
    "plan_table_names": "tablework.operators.names",
    "union_by_name": "tablework.operators.schema", "align": "tablework.operators.schema",
    "widen_type": "tablework.operators.schema", "column_mismatch_report": "tablework.operators.schema",
    "sanitize": "tablework.operators.clean", "quick_clean": "tablework.operators.clean",
    "drop_empty_rows": "tablework.operators.clean", "drop_header_rows": "tablework.operators.clean",
    "narrow_types": "tablework.operators.clean", "fill_missing": "tablework.operators.clean",
    "validate": "tablework.operators.clean",
    "range_join": "tablework.operators.joins", "asof_join": "tablework.operators.joins",
    "qualify": "tablework.operators.joins", "top_k_per_group": "tablework.operators.joins",
    "run_sql": "tablework.operators.results", "snapshot": "tablework.operators.results",
    "should_page": "tablework.operators.results", "shallow_page": "tablework.operators.results",
    # sinks
    "write_table": "tablework.sinks.tables", "append_evolve": "tablework.sinks.tables",
    "update_where": "tablework.sinks.tables", "delete_where": "tablework.sinks.tables",
    "drop_column": "tablework.sinks.tables", "export": "tablework.sinks.export",
    # plans / streaming
    "parse_pipeline": "tablework.plans.pipeline", "run_pipeline": "tablework.plans.pipeline",
    "bulk_import": "tablework.plans.imports", "import_folder_as_tables": "tablework.plans.imports",
    "merge_folder_to_csv": "tablework.plans.imports", "typed_with_rejects": "tablework.plans.imports",
    "start_folder_ingest": "tablework.streaming.ingest", "ingest_new_files": "tablework.streaming.ingest",
}

__all__ = ["get_session", "shared_dir", *_LAZY]


def __getattr__(name):
    if name in _LAZY:
        import importlib

        return getattr(importlib.import_module(_LAZY[name]), name)
    raise AttributeError(name)
