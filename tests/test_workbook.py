"""Workbooks: what is written is read, in blocks; cells as other programs write them."""

import datetime
import zipfile
from decimal import Decimal

import pytest

from tablematch.sources import workbook as wb

SHARED = "<sst><si><t>plain</t></si><si><r><t>two </t></r><r><rPr/><t>runs</t></r><rPh sb='0' eb='1'><t>hint</t></rPh></si><si><t xml:space='preserve'> a &amp; b\n</t></si></sst>"
STYLES = """<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="#,##0.00 [Red]&quot;days&quot;"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="14"/><xf numFmtId="171"/></cellXfs></styleSheet>"""


def book(path, rows, more="", size="", prefix="", shared=SHARED, properties=""):
    p = prefix and prefix + ":"
    tag = f"<{p}worksheet xmlns{':' + prefix if prefix else ''}='{wb.MAIN}'>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook xmlns:r='{wb.RELATIONS}'>{properties}<sheets><sheet name='One' r:id='x1'/><sheet name='Two' r:id='x2'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='x2' Target='/xl/worksheets/b.xml'/><Relationship Id='x1' Target='worksheets/a.xml'/></Relationships>")
        z.writestr("xl/worksheets/a.xml", f"{tag}{size}<{p}sheetData>{rows}</{p}sheetData>{more}</{p}worksheet>")
        z.writestr("xl/worksheets/b.xml", "<worksheet><dimension ref='A1'/><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>")
        z.writestr("xl/styles.xml", STYLES)
        if shared:
            z.writestr("xl/sharedStrings.xml", shared)


def grid(spark, path, **options):
    return [tuple(r) for r in sorted(wb.read_workbook(spark, str(path), **options).collect())]


def test_kinds_of_cells(spark, tmp_path):
    cells = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>
    <row r="3"><c r="A3"><v>1000</v></c><c r="B3"><v>0.30000000000000004</v></c><c r="C3"><v>1E3</v></c><c r="D3"><v>-1.5E-7</v></c></row>
    <row r="4"><c r="A4" s="1"><v>45000</v></c><c r="B4" s="2"><v>45000.5</v></c><c r="C4" s="3"><v>45000.5</v></c><c r="D4" t="b"><v>1</v></c></row>
    <row r="5" ht="3"><c r="A5" t="str"><f>A1&amp;1</f><v>formula</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" t="inlineStr"><is><t>in</t></is></c><c r="D5" s="1"/></row>"""
    book(tmp_path / "k.xlsx", cells)
    want = [
        (0, "plain", "two runs", None, " a & b\n"), (1, None, None, None, None), (2, "1000", "0.3", "1000", "-0.00000015"),
        (3, "2023-03-15", "2023-03-15 12:00:00", "45000.5", "True"), (4, "formula", "#N/A", "in", None),
    ]
    for block in (1, 2, 100):
        assert grid(spark, tmp_path / "k.xlsx", block=block) == want
    assert grid(spark, tmp_path / "k.xlsx", sheet="Two") == [(0, "7")] == grid(spark, tmp_path / "k.xlsx", sheet="1")
    assert grid(spark, tmp_path / "k.xlsx", sheet="*")[-1] == (wb.MAX_ROWS, "7", None, None, None)
    with pytest.raises(Exception, match="no sheet"):
        grid(spark, tmp_path / "k.xlsx", sheet="Three")


def test_merged_cells_prefixes_and_the_other_epoch(spark, tmp_path):
    rows = "".join(f'<x:row r="{i}"><x:c r="A{i}"><x:v>{i}</x:v></x:c><x:c r="B{i}" s="1"><x:v>{i}</x:v></x:c></x:row>' for i in range(1, 9))
    merged = '<x:mergeCells count="2"><x:mergeCell ref="A2:A7"/><x:mergeCell ref="A8:C8"/></x:mergeCells>'
    book(tmp_path / "m.xlsx", rows, merged, "<x:dimension ref='A1:C8'/>", "x", None, "<workbookPr date1904='1'/>")
    day = [str(datetime.date(1904, 1, 1) + datetime.timedelta(i)) for i in range(9)]
    want = [(0, "1", day[1], None), *[(i - 1, "2", day[i], None) for i in range(2, 8)], (7, "8", "8", "8")]
    for block in (1, 3, 50):
        assert grid(spark, tmp_path / "m.xlsx", block=block) == want


@pytest.mark.parametrize("block", [7, 1000])
def test_round_trip(spark, tmp_path, block):
    rows = [(i, f"text <{i}> & \n\r{'é' * (i % 9)}", i / 7 if i % 3 else None, Decimal(i) / 4, i % 2 == 0, datetime.date(2024, 1, 1 + i % 28)) for i in range(100)]
    df = spark.createDataFrame(rows, "n long, t string, x double, m decimal(10,2), b boolean, d date")
    wb.write_workbooks(df.repartition(3, "n"), str(tmp_path / "w"))
    wb.write_workbooks(df.coalesce(1), str(tmp_path / "w"))  # replaces the others
    frame = wb.read_workbook(spark, str(tmp_path / "w"), block=block)
    got = [tuple(r) for r in sorted(frame.collect())]
    text = lambda v: None if v is None else wb.number_text(str(v))
    assert got == [(0, "n", "t", "x", "m", "b", "d")] + [(i + 1, str(n), t, text(x), text(m), str(b), str(d)) for i, (n, t, x, m, b, d) in enumerate(rows)]
    assert frame.rdd.getNumPartitions() == (15 if block == 7 else 1) and not [f for f in (tmp_path / "w").iterdir() if f.name.startswith(".")]


def test_full_sheets_are_followed_by_others(spark, tmp_path):
    with open(tmp_path / "f.xlsx", "wb") as out:
        wb.write_sheets(out, ["a"], iter([(i,) for i in range(5)]), limit=3)
    assert [r[1] for r in grid(spark, tmp_path / "f.xlsx", sheet="*")] == ["a", "0", "1", "a", "2", "3", "a", "4"]
    with open(tmp_path / "e.xlsx", "wb") as out:
        wb.write_sheets(out, ["a"], iter([]))
    assert grid(spark, tmp_path / "e.xlsx") == [(0, "a")]


def test_declared_entities_are_refused():
    with pytest.raises(ValueError):
        list(wb._elements(iter([b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'])))


def test_blocks_of_a_sheet_are_bounded():
    """each block inflates the rows before it, so that their number must not grow with the rows."""
    for rows, block in ((1000, 1), (1000, 90), (wb.MAX_ROWS, 4000), (5, 2)):
        source = wb.WorkbookSource({"path": "x", "block": str(block), "sizes": f'[["x", "p", {rows}, 2]]'})
        blocks = source.reader(["_rid", "_c0", "_c1"]).partitions()
        assert len(blocks) <= wb.PARTS and blocks[0].first == 1 and blocks[-1].last is None
        assert [b.first for b in blocks[1:]] == [b.last + 1 for b in blocks[:-1]] and blocks[-1].first <= rows
