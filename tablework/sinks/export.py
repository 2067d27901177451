"""Result export (K8-K14): CSV, TSV, JSON, Parquet, XML, HTML, Excel.

Every export is a distributed write: one output part per partition, written
by executors.  HTML gets its head and tail as files beside the part files,
so that all of them in name order form the document without any shuffle or
single-task step; a part of a JSON array export is an array of its own.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# --- fixed values: the reference's export conventions ------------------------
XML_ROOT_TAG = "query_results"
XML_ROW_TAG = "row"
EXCEL_SHEET = "Query Results"
EXCEL_MAX_WIDTH = 50
EXCEL_MAX_ROWS = 1_048_575      # data rows per sheet (one row is the header)
# ---------------------------------------------------------------------------
EXCEL_TASK_ROWS = 100_000       # rows that ``dealt`` gives a task that writes workbooks
HTML_HEAD, HTML_TAIL = "00-head.html", "zz-tail.html"  # sort before and behind Spark's part files


def export_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True,
               encoding: str = "UTF-8", mode: str = "errorifexists") -> str:
    """K8 (and K9 with ``sep='\\t'``): header line, no index, RFC-4180 quoting."""
    (df.write.mode(mode).option("header", str(header).lower()).option("sep", sep)
       .option("quote", '"').option("escape", '"').option("encoding", encoding)
       .option("nullValue", "").option("emptyValue", '""').csv(path))
    return path


def export_tsv(df: DataFrame, path: str, **kw) -> str:
    """K9."""
    return export_csv(df, path, sep="\t", **kw)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists", as_array: bool = False) -> str:
    """JSON records, ISO dates, NULL fields kept.

    Default is JSON lines (splittable for readers).  ``as_array`` makes every
    part file one JSON array document (``[``, records joined by commas,
    ``]``): each partition frames its own records, so no task sees more than
    its partition and no ordering pass is needed."""
    if not as_array:
        (df.write.mode(mode).option("ignoreNullFields", "false")
           .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))
        return path
    import pandas as pd

    from tablework.session import ship_package

    ship_package(df.sparkSession)
    rec = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                              {"ignoreNullFields": "false"}).alias("value"))

    def frame(batches):
        yield pd.DataFrame({"value": ["["]})
        first = True
        for pdf in batches:
            if pdf.empty:
                continue
            vals = pdf["value"].astype(str)
            sep = pd.Series(",", index=vals.index)
            if first:
                sep.iloc[0] = ""
                first = False
            yield pd.DataFrame({"value": sep + vals})
        yield pd.DataFrame({"value": ["]"]})

    rec.mapInPandas(frame, "value string").write.mode(mode).text(path)
    return path


def export_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                   partition_by: list[str] | None = None) -> str:
    """K11."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def xml_name(name: str) -> str:
    """K12 element names: space and ``-`` -> ``_``, other non-alphanumerics removed."""
    n = re.sub(r"[ \-]", "_", str(name))
    n = re.sub(r"[^A-Za-z0-9_]", "", n)
    if not n or not (n[0].isalpha() or n[0] == "_"):
        n = "_" + n
    return n


def export_xml(df: DataFrame, path: str, mode: str = "errorifexists", query: str | None = None) -> str:
    """``<query_results><row><col>value</col>...</row>...`` with escaped
    values and NULL as an empty element; the metadata (query, row count,
    time) goes to ``<path>_metadata.json``."""
    from tablework.operators.names import dedupe_names

    names = dedupe_names([xml_name(c) for c in df.columns])
    out = df.toDF(*names)
    counted = Observation()  # the rows are counted as they are written
    (out.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode(mode).format("xml")
        .option("rootTag", XML_ROOT_TAG).option("rowTag", XML_ROW_TAG).option("nullValue", "").save(path))
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(query, datetime.datetime.now(datetime.timezone.utc).isoformat(), len(names), counted.get["rows"])],
        "query string, exported_at string, n_columns int, n_rows long")
    meta.write.mode(mode).json(path.rstrip("/") + "_metadata.json")
    return path


def html_escape(c):
    """Escape ``& < > " '`` in a string column."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    c = F.replace(c, F.lit('"'), F.lit("&quot;"))
    return F.replace(c, F.lit("'"), F.lit("&#39;"))


def html_rows(df: DataFrame) -> DataFrame:
    """One ``<tr><td>..</td></tr>`` line per row, cells escaped, NULL empty."""
    cells = [F.concat(F.lit("<td>"), F.coalesce(html_escape(F.col(f"`{c}`").cast("string")), F.lit("")),
                      F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def export_html(df: DataFrame, path: str, title: str = "Query Results", mode: str = "errorifexists") -> str:
    """An HTML table document (title, timestamp, row and column count,
    header) with escaped values - the reference wrote them unescaped.  The
    rows are counted as they are written; what goes around them is put beside
    the part files, so that the files in name order are the document."""
    import html

    spark = df.sparkSession
    counted = Observation()
    html_rows(df.observe(counted, F.count(F.lit(1)).alias("rows"))).write.mode(mode).text(path)
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
    head_cells = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
    head = ("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>" + html.escape(title)
            + "</title></head><body><h1>" + html.escape(title) + "</h1><p>Exported " + now
            + f" - {counted.get['rows']} rows, {len(df.columns)} columns</p><table border=\"1\"><thead><tr>" + head_cells
            + "</tr></thead><tbody>\n")
    _put(spark, f"{path.rstrip('/')}/{HTML_HEAD}", head)
    _put(spark, f"{path.rstrip('/')}/{HTML_TAIL}", "</tbody></table></body></html>\n")
    return path


def _put(spark, path: str, text: str) -> None:
    """A small text file on Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def dealt(df: DataFrame, least: int = 1, rows: int | None = None) -> DataFrame:
    """Rows dealt evenly over as many partitions as hold ``rows`` of them, or
    ``least``, so that writers that take a task per partition grow in number
    with the rows.  Counts the rows first; a frame of one part stays as it is."""
    n = max(least, -(-df.count() // (rows or EXCEL_TASK_ROWS)))
    return df.repartition(n) if n > 1 else df


def export_excel(df: DataFrame, path: str, max_rows_per_part: int = EXCEL_MAX_ROWS) -> DataFrame:
    """One ``.xlsx`` workbook per partition (sheet "Query Results",
    header row, column widths up to 50), written by executors.  Partitions
    larger than a sheet give several workbooks, one after another in their
    task; ``dealt(df)`` spreads them over more tasks.  Returns the per-part report
    (part, rows) as a DataFrame (lazy until the caller acts on it; call
    ``.collect()`` or ``.count()`` to write)."""
    from tablework.sources.xlsx import write_partitions

    return write_partitions(df, path, EXCEL_SHEET, EXCEL_MAX_WIDTH, max_rows_per_part)


def export(df: DataFrame, fmt: str, path: str, **kw):
    """Dispatch by format name: csv tsv json parquet xml html excel."""
    fn = {"csv": export_csv, "tsv": export_tsv, "json": export_json, "parquet": export_parquet,
          "xml": export_xml, "html": export_html, "excel": export_excel, "xlsx": export_excel}[fmt.lower()]
    return fn(df, path, **kw)
