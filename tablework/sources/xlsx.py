"""Excel ``.xlsx`` reading (S7-S10, S13, S14, S22) and writing.

Reading is a Python Data Source (``tablework_xlsx``): one input partition
per workbook, parsed with ``zipfile`` + ``xml.etree.iterparse`` inside the
executor, streaming rows as (path, sheet, row number, header, cells).  The
header of each sheet is its first row, cleaned and deduplicated in the
executor; rows become columns with ``map_from_arrays(header, cells)`` and
one projection onto the unified column list, so a folder of workbooks with
drifting headers is still a single scan.

Writing is ``mapInArrow``: every partition streams its rows into its own
workbook(s), rolling over at the sheet row limit.  Each task attempt writes
a temporary file and moves it to its deterministic final name when done, so
a lost executor's retry or a speculative copy never leaves a torn workbook.
"""

from __future__ import annotations

import contextlib
import datetime
import functools
import io
import itertools
import json
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablework.operators.names import clean_names, dedupe_names
from tablework.operators.schema import target_columns

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PKG_REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# --- fixed values: built-in number formats that are dates (ECMA-376) ---------
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
EXCEL_EPOCH = datetime.datetime(1899, 12, 30)
# ---------------------------------------------------------------------------

_ROW, _C, _V, _T = (NS[1:] + tag for tag in ("row", "c", "v", "t"))  # as expat gives them
_BLOCK = 1 << 16
_BATCH_ROWS = 5_000
_ROWS_A_WRITE = 200

ROW_SCHEMA = ("path string, sheet_index int, sheet_name string, row_number long, "
              "header array<string>, cells array<string>")
_ROW_ARROW = pa.schema([("path", pa.string()), ("sheet_index", pa.int32()), ("sheet_name", pa.string()), ("row_number", pa.int64()),
                        ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])


# ------------------------------------------------------------------ parsing
def _open(path: str):
    from tablework.sources.probe import _local_path

    local = _local_path(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs as pafs

    filesystem, p = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(p)


@functools.lru_cache(maxsize=20_000)
def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def workbook_sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    """[(sheet name, member path)] in workbook order."""
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels.iter(f"{PKG_REL_NS}Relationship")}
    out = []
    for s in wb.iter(f"{NS}sheet"):
        t = targets.get(s.get(f"{REL_NS}id"), "")
        t = t.lstrip("/")
        member = t if t.startswith("xl/") else "xl/" + t
        out.append((s.get("name"), member))
    return out


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    out = []
    with zf.open("xl/sharedStrings.xml") as fh:
        for _, el in ET.iterparse(fh):
            if el.tag == f"{NS}si":
                out.append(_plain("".join(t.text or "" for t in el.iter(f"{NS}t"))))
                el.clear()
    return out


def _date_styles(zf: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles (``s`` attribute) whose number format is a date."""
    if "xl/styles.xml" not in zf.namelist():
        return set()
    st = ET.fromstring(zf.read("xl/styles.xml"))
    custom = {}
    for nf in st.iter(f"{NS}numFmt"):
        code = (nf.get("formatCode") or "").lower()
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", code)
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dy]", code) or re.search(r"m.*[ds]|h", code))
    out = set()
    xfs = st.find(f"{NS}cellXfs")
    if xfs is not None:
        for i, xf in enumerate(xfs.findall(f"{NS}xf")):
            fid = int(xf.get("numFmtId", "0"))
            if fid in DATE_FORMAT_IDS or custom.get(fid, False):
                out.add(i)
    return out


def _excel_date(v: str) -> str:
    d = EXCEL_EPOCH + datetime.timedelta(days=float(v))
    if d.hour == d.minute == d.second == 0 and d.microsecond == 0:
        return d.date().isoformat()
    return d.isoformat(sep=" ", timespec="seconds")


def iter_sheet_rows(zf: zipfile.ZipFile, member: str, strings: list[str], date_styles: set[int]):
    """Yield (row number, [cell text or None, ...]) for one worksheet, parsed
    block by block: a cell's text is kept, no tree is built."""
    done: list[tuple] = []          # rows ended in the block
    depth = row_at = cell_at = 0    # of the element, of the row and the cell it is in (0: none)
    number = kind = style = None
    cells: dict[int, str | None] = {}
    auto = idx = 0
    text: list[str] = []
    seen = taking = False           # the cell has a <v>; text belongs to it

    def start(tag, attrs):
        nonlocal depth, row_at, cell_at, number, kind, style, cells, auto, idx, text, seen, taking
        depth += 1
        if cell_at:
            if kind == "inlineStr":
                taking = tag == _T
            elif tag == _V and depth == cell_at + 1 and not seen:
                seen = taking = True
            else:
                taking = False
        elif row_at:
            if tag == _C and depth == row_at + 1:
                cell_at, text, seen, taking = depth, [], False, False
                ref = attrs.get("r")
                idx = _col_index(ref.rstrip("0123456789")) if ref else auto
                auto = idx + 1
                kind, style = attrs.get("t"), attrs.get("s")
        elif tag == _ROW:
            row_at, number, cells, auto = depth, attrs.get("r"), {}, 0

    def chars(data):
        if taking:
            text.append(data)

    def end(tag):
        nonlocal depth, row_at, cell_at, taking
        taking = False
        depth -= 1
        if cell_at > depth:
            cell_at = 0
            val = "".join(text)
            if kind == "inlineStr":
                val = _plain(val)
            elif kind == "s":
                val = strings[int(val)] if val else None
            elif kind == "b":
                val = ("TRUE" if val == "1" else "FALSE") if seen else None
            else:
                val = val or None
                if val is not None and kind in (None, "n") and int(style or "0") in date_styles:
                    with contextlib.suppress(ValueError, OverflowError):
                        val = _excel_date(val)
            cells[idx] = val
        elif row_at > depth:
            row_at = 0
            width = max(cells) + 1 if cells else 0
            done.append((int(number) if number else None,
                         list(cells.values()) if [*cells] == [*range(width)] else [cells.get(i) for i in range(width)]))

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    with zf.open(member) as fh:
        more = True
        while more:
            block = fh.read(_BLOCK)
            more = bool(block)
            try:
                parser.Parse(block, not more)
            except expat.ExpatError as e:
                raise ET.ParseError(str(e)) from e
            yield from done
            done.clear()


def _select_sheets(sheets: list[tuple[str, str]], sheet, on_missing: str):
    if not sheets:
        return []
    if sheet is None or sheet == "" or sheet == "first":
        return [(0, sheets[0])]
    if sheet == "*":
        return list(enumerate(sheets))
    if isinstance(sheet, int) or (isinstance(sheet, str) and sheet.isdigit()):
        i = int(sheet)
        return [(i, sheets[i])] if 0 <= i < len(sheets) else [(0, sheets[0])]
    for i, s in enumerate(sheets):
        if s[0] == sheet:
            return [(i, s)]
    return [(0, sheets[0])] if on_missing == "first" else []


def _names_to(header: list[str], width: int) -> list[str]:
    """The header's names, and generated ones for cells to the right of it."""
    return dedupe_names(header + [f"column_{i + 1}" for i in range(len(header), width)])


def read_workbook(path: str, sheet=None, on_missing: str = "first", policy: str = "keep_case",
                  headers_only: bool = False):
    """Rows of the selected sheets of one workbook (executor-side).  With
    ``headers_only``, per sheet its names up to its widest row; a workbook
    that cannot be read to its end gives a row (path, -1, reason, 0, null,
    null) after what could."""
    if headers_only:
        try:
            yield from _sheet_headers(path, sheet, on_missing, policy)
        except Exception as e:  # B4: the workbook is reported, the others go on
            yield (path, -1, f"{type(e).__name__}: {e}", 0, None, None)
        return
    for idx, name, rnum, header, cells in _workbook_rows(path, sheet, on_missing, policy):
        if rnum is None:
            names = header
        else:
            width = max(len(header), len(cells))
            if len(names) != width:  # the names stay while the width does
                names = _names_to(header, width)
            yield (path, idx, name, rnum, names, cells + [None] * (width - len(cells)))


def _sheet_headers(path, sheet, on_missing, policy):
    at, widest, header = None, 0, []
    for idx, name, rnum, names, cells in _workbook_rows(path, sheet, on_missing, policy):
        if at != (idx, name):
            if at:
                yield (path, *at, 0, _names_to(header, widest), [])
            at, widest, header = (idx, name), len(names), names
        widest = max(widest, len(cells))
    if at:
        yield (path, *at, 0, _names_to(header, widest), [])


def _workbook_rows(path, sheet, on_missing, policy):
    """(sheet index, name, row number or None for the header, names, cells)."""
    with _open(path) as raw:
        data = raw if hasattr(raw, "seek") else io.BytesIO(raw.read())
        with zipfile.ZipFile(data) as zf:
            sheets = workbook_sheets(zf)
            strings = _shared_strings(zf)
            dates = _date_styles(zf)
            for idx, (name, member) in _select_sheets(sheets, sheet, on_missing):
                header = None
                for rnum, cells in iter_sheet_rows(zf, member, strings, dates):
                    if header is None:
                        if not any(c not in (None, "") for c in cells):
                            continue
                        header = clean_names(cells, policy)
                        yield idx, name, None, header, []
                        continue
                    if any(c not in (None, "") for c in cells):
                        yield idx, name, rnum or 0, header, cells


class _WorkbookPartition(InputPartition):
    """One workbook, or one sheet of it (``sheet`` set) when reading all sheets."""

    def __init__(self, path: str, sheet=None):
        super().__init__((path, sheet))
        self.path = path
        self.sheet = sheet


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))
        self.units = json.loads(options.get("sheet_units", "[]"))
        sheet = options.get("sheet")
        self.sheet = None if sheet in (None, "", "null") else sheet
        self.on_missing = options.get("on_missing_sheet", "first")
        self.policy = options.get("policy", "keep_case")
        self.headers_only = options.get("headers_only", "false") == "true"

    def partitions(self):
        if self.units:        # all sheets: one partition per (workbook, sheet index)
            return [_WorkbookPartition(p, int(i)) for p, i in self.units]
        return [_WorkbookPartition(p) for p in self.paths]

    def read(self, partition):
        sheet = self.sheet if partition.sheet is None else str(partition.sheet)
        rows = read_workbook(partition.path, sheet, self.on_missing, self.policy, self.headers_only)
        while some := list(itertools.islice(rows, _BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*some), _ROW_ARROW)], schema=_ROW_ARROW)


class XlsxDataSource(DataSource):
    """``spark.read.format("tablework_xlsx").option("paths", json_list)``."""

    @classmethod
    def name(cls):
        return "tablework_xlsx"

    def schema(self):
        return ROW_SCHEMA

    def reader(self, schema):
        return XlsxReader(self.options)


def register(spark: SparkSession) -> None:
    from tablework.session import ship_package

    ship_package(spark)
    spark.dataSource.register(XlsxDataSource)


def _excel_files(spark: SparkSession, path, pattern: str, recursive: bool):
    from tablework.sources.probe import list_files

    pats = [pattern]
    if pattern.lower().endswith(".xlsx"):      # S13: *.xlsx also matches .xls / .xlsm
        pats = [pattern, pattern[:-5] + ".xls", pattern[:-5] + ".xlsm"]
    rows = []
    for p in pats:
        rows += list_files(spark, path, p, recursive).select("path", "file_name").collect()
    seen, good, bad = set(), [], []
    for r in sorted(rows, key=lambda r: r["path"]):
        if r["path"] in seen:
            continue
        seen.add(r["path"])
        (bad if r["file_name"].lower().endswith(".xls") else good).append(r)
    return good, bad


def read_excel(spark: SparkSession, path, pattern: str = "*.xlsx", recursive: bool = False,
               sheet=None, on_missing_sheet: str = "first", policy: str = "keep_case",
               order: str = "first_seen_then_sorted", pad_value=None, lineage: bool = True):
    """Workbooks -> one DataFrame of text columns (+ ``_source_file``,
    ``_source_sheet``).  ``sheet``: None/"first", an index, a name (missing
    name -> first sheet, or skipped with ``on_missing_sheet="skip"``), "*" all."""
    from tablework.sources.readers import ReadResult

    register(spark)
    good, bad = _excel_files(spark, path, pattern, recursive)
    paths = [r["path"] for r in good]
    probes = spark.createDataFrame(
        [(r["path"], r["file_name"], "ok", None, None) for r in good]
        + [(r["path"], r["file_name"], "rejected", None, ".xls (BIFF) is not supported") for r in bad],
        "path string, file_name string, status string, n_columns int, error string")
    result = ReadResult(probes=probes, rejected_files=[{"file_name": r["file_name"], "status": "rejected",
                                                        "error": ".xls (BIFF) is not supported"} for r in bad])
    if not paths:
        raise ValueError(f"no .xlsx workbooks under {path}")
    reader = (spark.read.format("tablework_xlsx").option("paths", json.dumps(paths))
              .option("on_missing_sheet", on_missing_sheet).option("policy", policy))
    if sheet == "*":
        # all sheets: list them in executors first, then read one sheet per task
        units = sorted((r["path"], r["sheet_index"]) for r in
                       list_sheets_df(spark, spark.createDataFrame([(p,) for p in paths], "path string"))
                       .where("error IS NULL").collect())
        reader = reader.option("sheet_units", json.dumps(units))
    elif sheet is not None:
        reader = reader.option("sheet", str(sheet))
    # put in order here: a sort in Spark samples its input first, which reads every workbook once more
    heads = sorted(reader.option("headers_only", "true").load().select("path", "sheet_index", "sheet_name", "header").collect(),
                   key=lambda h: (h["path"], h["sheet_index"]))
    broken = {h["path"]: h["sheet_name"] for h in heads if h["sheet_index"] == -1}
    if broken:
        heads = [h for h in heads if h["path"] not in broken]
        paths = [p for p in paths if p not in broken]
        if not paths:
            raise ValueError(f"no readable workbook under {path}: {broken}")
        reader = reader.option("paths", json.dumps(paths))
        if sheet == "*":
            reader = reader.option("sheet_units", json.dumps([u for u in units if u[0] not in broken]))
        names = {r["path"]: r["file_name"] for r in good}
        result.rejected_files += [{"file_name": names[p], "status": "unreadable", "error": e} for p, e in sorted(broken.items())]
        reasons = spark.createDataFrame(list(broken.items()), "path string, _error string")
        result.probes = probes.join(reasons, "path", "left") \
            .withColumn("status", F.when(F.col("_error").isNotNull(), "unreadable").otherwise(F.col("status"))) \
            .withColumn("error", F.coalesce("_error", "error")).drop("_error")
    cols = target_columns([list(h["header"]) for h in heads], order, lineage=())
    rows = reader.option("headers_only", "false").load()
    m = F.map_from_arrays("header", "cells")
    sel = [F.element_at(m, F.lit(c)).alias(c) if pad_value is None
           else F.coalesce(F.element_at(m, F.lit(c)), F.lit(pad_value)).alias(c) for c in cols]
    if lineage:
        sel += [F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B"))).alias("_source_file"),
                F.col("sheet_name").alias("_source_sheet")]
    return rows.select(*sel), result


def list_sheets_df(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """(path, sheet_index, sheet_name) for every workbook in a listing."""

    def sheets(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    with _open(p) as raw:
                        data = raw if hasattr(raw, "seek") else io.BytesIO(raw.read())
                        with zipfile.ZipFile(data) as zf:
                            for i, (name, _) in enumerate(workbook_sheets(zf)):
                                out.append((p, i, name, None))
                except Exception as e:  # B4: report, go on
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sheet_index", "sheet_name", "error"])

    from tablework.session import ship_package

    ship_package(spark)
    return listing.select("path").mapInPandas(
        sheets, "path string, sheet_index int, sheet_name string, error string")


# ------------------------------------------------------------------ writing
_ILLEGAL_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_ESCAPED = re.compile("_(?=x[0-9A-Fa-f]{4}_)")
_SPECIAL = re.compile(f"[&<>]|{_ILLEGAL_XML.pattern}|{_ESCAPED.pattern}")
_HEX = re.compile("_x([0-9A-Fa-f]{4})_")


def _plain(text: str) -> str:
    """A cell's text with its ``_xHHHH_`` characters."""
    return _HEX.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _xml_text(v) -> str:
    """Text of a cell; characters XML has no place for as ``_xHHHH_``."""
    s = str(v)
    if not _SPECIAL.search(s):
        return s
    s = _ESCAPED.sub("_x005F_", s)
    s = _ILLEGAL_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", s)
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _col_letter(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


_CONTENT_TYPES = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                  '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                  '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                  '<Default Extension="xml" ContentType="application/xml"/>'
                  '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                  '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                  '</Types>')
_ROOT_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
              '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
              '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
              '</Relationships>')
_WB_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            '</Relationships>')


def _workbook_xml(sheet: str) -> str:
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            f'<sheets><sheet name="{_xml_text(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')


def _open_out(path: str):
    from tablework.sources.probe import _local_path

    path = _local_path(path) or path
    if path.startswith("/"):
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs as pafs

    filesystem, p = pafs.FileSystem.from_uri(path)
    return filesystem.open_output_stream(p)


def _publish(tmp: str, final: str) -> None:
    """Move a finished part into place (a retried or speculative attempt
    writes its own temporary file; the last finished one wins whole)."""
    from tablework.sources.probe import _local_path

    lt, lf = _local_path(tmp), _local_path(final)
    if lt is not None and lf is not None:
        import os

        os.replace(lt, lf)
        return
    from pyarrow import fs as pafs

    filesystem, src = pafs.FileSystem.from_uri(tmp)
    _, dst = pafs.FileSystem.from_uri(final)
    filesystem.move(src, dst)


class _WorkbookWriter:
    def __init__(self, path: str, sheet: str, columns: list[str], numeric: list[bool], boolean: list[bool],
                 widths: list[int]):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        attempt = f"{ctx.stageId()}-{ctx.taskAttemptId()}" if ctx is not None else "local"
        head, _, name = path.rpartition("/")
        self.final = path
        self.tmp = f"{head}/.{name}.{attempt}.tmp"
        self.fh = _open_out(self.tmp)
        self.zf = zipfile.ZipFile(self.fh, "w", compression=zipfile.ZIP_DEFLATED)
        self.zf.writestr("[Content_Types].xml", _CONTENT_TYPES)
        self.zf.writestr("_rels/.rels", _ROOT_RELS)
        self.zf.writestr("xl/workbook.xml", _workbook_xml(sheet))
        self.zf.writestr("xl/_rels/workbook.xml.rels", _WB_RELS)
        self.sheet = self.zf.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>'
                       for i, w in enumerate(widths))
        self._w('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                f'<cols>{cols}</cols><sheetData>')
        self.numeric, self.boolean = numeric, boolean
        self.letters = [_col_letter(i) for i in range(len(columns))]
        self.rows: list[str] = []   # not yet handed to the archive
        self.row = 0
        self.write_row(columns, header=True)

    def _w(self, s: str):
        self.sheet.write(s.encode("utf-8"))

    def write_row(self, values, header: bool = False):
        self.row += 1
        parts = [f'<row r="{self.row}">']
        for i, v in enumerate(values):
            if v is None:
                continue
            ref = f"{self.letters[i]}{self.row}"
            if not header and self.boolean[i]:
                parts.append(f'<c r="{ref}" t="b"><v>{int(v == "true")}</v></c>')
            elif not header and self.numeric[i] and not v.endswith("Infinity"):
                parts.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                parts.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_xml_text(v)}</t></is></c>')
        parts.append("</row>")
        self.rows.append("".join(parts))
        if len(self.rows) >= _ROWS_A_WRITE:
            self._flush()

    def _flush(self):
        self._w("".join(self.rows))
        self.rows.clear()

    def close(self):
        self._flush()
        self._w("</sheetData></worksheet>")
        self.sheet.close()
        self.zf.close()
        self.fh.close()
        _publish(self.tmp, self.final)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system Spark resolves it against."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_partitions(df: DataFrame, path: str, sheet: str, max_width: int, max_rows: int) -> DataFrame:
    """K14 writer: returns DataFrame(part, rows) - acting on it writes the files."""
    from pyspark.sql import types as T

    from tablework.session import ship_package

    ship_package(df.sparkSession)
    columns = df.columns
    numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema.fields]
    boolean = [isinstance(f.dataType, T.BooleanType) for f in df.schema.fields]
    base = qualified(df.sparkSession, path)
    # cells are texts in the cluster already (numbers as Spark writes them, dates in ISO form), NULL is no cell;
    # infinities and NaN are no numbers of a workbook: text and no cell
    cells = [_cell(f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    staged = df.select(*cells, F.spark_partition_id().alias("__part"))

    def write(batches):
        writer, part, k, n, report = None, None, 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("__part")[0].as_py()
            data = [batch.column(i).to_pylist() for i in range(len(columns))]
            for rec in zip(*data):
                if writer is None or n >= max_rows:
                    if writer is not None:
                        writer.close()
                        report.append((f"part-{part:05d}-{k:03d}.xlsx", n))
                        k += 1
                    widths = [min(max(len(c), *(len(v or "") for v in values[:100])) + 2, max_width)
                              for c, values in zip(columns, data)]
                    writer = _WorkbookWriter(f"{base}/part-{part:05d}-{k:03d}.xlsx", sheet, columns,
                                             numeric, boolean, widths)
                    n = 0
                writer.write_row(rec)
                n += 1
        if writer is not None:
            writer.close()
            report.append((f"part-{part:05d}-{k:03d}.xlsx", n))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in report], pa.string()), pa.array([r[1] for r in report], pa.int64())],
                                         names=["part", "rows"])

    return staged.mapInArrow(write, "part string, rows long")


def _cell(field) -> Column:
    """A column's values as the texts of cells."""
    from pyspark.sql import types as T

    c, kind = F.col(f"`{field.name}`"), field.dataType
    text = c.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.replace(text, F.lit(" "), F.lit("T"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c) if not isinstance(kind, T.VariantType) else text
    return text
