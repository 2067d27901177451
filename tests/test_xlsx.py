import io
import os
import zipfile
from xml.etree import ElementTree as ET

import pytest

from conftest import SF_SMALL, rows
from tablework.sinks import export
from tablework.sinks.export import dealt, export_excel
from tablework.sources.xlsx import iter_sheet_rows, read_excel

CT = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
      '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
      '<Default Extension="xml" ContentType="application/xml"/></Types>')
NSM = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NSR = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def make_workbook(path, sheets, shared=(), date_style=False):
    """sheets: [(name, [[cell xml, ...], ...])]; cells given as raw <c> xml."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", CT)
        wb = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NSM}" xmlns:r="{NSR}"><sheets>{wb}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="{NSR}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        if shared:
            si = "".join(f"<si><t>{s}</t></si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NSM}">{si}</sst>')
        if date_style:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NSM}"><cellXfs count="2"><xf numFmtId="0"/>'
                                        f'<xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, (_, rws) in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">{"".join(cells)}</row>' for r, cells in enumerate(rws))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       f'<worksheet xmlns="{NSM}"><sheetData>{body}</sheetData></worksheet>')


def s(ref, idx):
    return f'<c r="{ref}" t="s"><v>{idx}</v></c>'


def inline(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


def num(ref, v, style=None):
    st = f' s="{style}"' if style is not None else ""
    return f'<c r="{ref}"{st}><v>{v}</v></c>'


def build(tmp):
    make_workbook(tmp / "book1.xlsx", [
        ("Sales", [[s("A1", 0), s("B1", 1), inline("C1", "Sold On")],
                   [s("A2", 2), num("B2", 3), num("C2", 45292, style=1)],
                   [s("A3", 3), num("C3", 45293, style=1)]]),         # B3 missing cell
        ("Empty", []),
        ("Extra", [[inline("A1", "Region"), inline("B1", "Units")], [inline("A2", "North"), num("B2", 7)]]),
    ], shared=["Product Name", "Qty", "Apple", "Pear"], date_style=True)
    make_workbook(tmp / "book2.xlsx", [
        ("Sales", [[inline("A1", "qty"), inline("B1", "product name"), inline("C1", "Store")],
                   [num("A2", 5), inline("B2", "Fig"), inline("C2", "S1")]]),
    ])
    (tmp / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0 not supported")


def test_first_sheet_folder_with_drift(spark, tmp):
    build(tmp)
    df, res = read_excel(spark, str(tmp), policy="upper")
    assert df.columns == ["PRODUCT_NAME", "QTY", "SOLD_ON", "STORE", "_source_file", "_source_sheet"]
    assert rows(df) == [("Apple", "3", "2024-01-01", None, "book1.xlsx", "Sales"),
                        ("Fig", "5", None, "S1", "book2.xlsx", "Sales"),
                        ("Pear", None, "2024-01-02", None, "book1.xlsx", "Sales")]
    assert [r["file_name"] for r in res.rejected_files] == ["old.xls"]


def test_all_sheets_and_named_sheet(spark, tmp):
    build(tmp)
    df, _ = read_excel(spark, str(tmp / "book1.xlsx"), sheet="*")
    assert sorted({r["_source_sheet"] for r in df.collect()}) == ["Extra", "Sales"]   # empty sheet skipped
    extra, _ = read_excel(spark, str(tmp / "book1.xlsx"), sheet="Extra")
    assert rows(extra, ["Region", "Units"]) == [("North", "7")]
    missing, _ = read_excel(spark, str(tmp / "book1.xlsx"), sheet="Nope")            # falls back to first
    assert {r["_source_sheet"] for r in missing.collect()} == {"Sales"}
    skipped = read_excel(spark, str(tmp / "book1.xlsx"), sheet="Nope", on_missing_sheet="skip")[0]
    assert skipped.count() == 0


def test_export_roundtrip(spark, tmp):
    df = spark.createDataFrame([(i, f"name & <{i}>", i * 1.5) for i in range(25)], "id long, name string, v double")
    out = str(tmp / "xl")
    rep = export_excel(df.repartition(3), out, max_rows_per_part=4).collect()
    assert sum(r["rows"] for r in rep) == 25 and len(rep) >= 7
    back, _ = read_excel(spark, out)
    got = sorted((int(r["id"]), r["name"], float(r["v"])) for r in back.collect())
    assert got == [(i, f"name & <{i}>", i * 1.5) for i in range(25)]


def sheet_rows(body, strings=(), dates=()):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("s.xml", f'<worksheet xmlns="{NSM}">{body}</worksheet>')
    return list(iter_sheet_rows(zipfile.ZipFile(data), "s.xml", list(strings), set(dates)))


def test_odd_cells_of_a_sheet():
    got = sheet_rows('<sheetData><row r="3"><c r="C3"><v>7</v></c><c r="A3" t="inlineStr"><is><r><t>a &amp; </t></r><r><t>b_x0041_</t></r></is></c></row>'
                     '<row><c><v/></c><c t="b"><v>1</v></c><c t="b"/><c t="s"><v>1</v></c><c t="s"/><c s="1"><v>45292</v></c><c s="1"><v>1e99</v></c>'
                     '<c t="str"><f>A1<v>no</v></f><v>formula</v></c></row><row r="9"/></sheetData><c><v>out</v></c>', ["x", "y"], [1])
    assert got == [(3, ["a & bA", None, "7"]), (None, [None, "TRUE", None, "y", None, "2024-01-01", "1e99", "formula"]), (9, [])]
    with pytest.raises(IndexError):
        sheet_rows('<sheetData><row><c t="s"><v>5</v></c></row></sheetData>', ["x"])
    with pytest.raises(ET.ParseError):
        sheet_rows("<sheetData><row><c></row></sheetData>")


def test_rows_are_dealt_over_tasks(spark, tmp, monkeypatch):
    """the workbooks of a table grow in number with its rows."""
    from tablework.plans import scale

    one = spark.range(0, 1000, 1, 1).toDF("id")
    assert dealt(one, rows=1000).rdd.getNumPartitions() == 1 and dealt(one, 3, rows=1000).rdd.getNumPartitions() == 3
    rep = export_excel(dealt(one, rows=100), str(tmp / "xl")).collect()
    assert len(rep) == 10 and sum(r["rows"] for r in rep) == 1000 and max(r["rows"] for r in rep) < 200
    assert sorted(int(r.id) for r in read_excel(spark, str(tmp / "xl"))[0].collect()) == list(range(1000))
    monkeypatch.setattr(export, "EXCEL_TASK_ROWS", 100)
    monkeypatch.setattr(scale, "_scratch", lambda spark, name: str(tmp / name))
    path = scale._order_books(spark, SF_SMALL, "books")
    assert len([f for f in os.listdir(path) if f.endswith(".xlsx")]) == 15


def test_headers_are_read_in_one_pass(spark, tmp):
    """the sheets' names and widths take one scan of the workbooks, without a sort's sampling."""
    build(tmp)
    spark.sparkContext.setJobGroup("xlsx-headers", "")
    read_excel(spark, str(tmp))
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(i).numTasks for j in tracker.getJobIdsForGroup("xlsx-headers") for i in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(i)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # three listings (.xlsx, .xls, .xlsm) and the scan
    assert len(tasks) <= 4


def test_parts_are_dealt_over_tasks(spark, tmp, monkeypatch):
    """the round trip of the parts writes as many workbooks as its rows need."""
    from tablework.plans import showcase

    parts = spark.read.parquet(f"{SF_SMALL}/part.parquet").count()
    monkeypatch.setattr(export, "EXCEL_TASK_ROWS", 50)
    monkeypatch.setattr(showcase, "_scratch", lambda spark, name: str(tmp / name))
    assert showcase.xlsx_roundtrip(spark, SF_SMALL).count() == parts
    assert len([f for f in os.listdir(tmp / "xlsx") if f.endswith(".xlsx")]) == -(-parts // 50) > 1


def test_listed_sheets_are_sent_to_the_rows(spark):
    """rows are not dealt by workbook, of which there are few, to meet its sheets."""
    from tablework.plans import scale

    df = scale.xlsx_sheet_names(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert rows(df) == rows(orders.selectExpr("cast(o_orderkey as string) k", "'Query Results' sheet"))
