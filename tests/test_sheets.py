"""Workbooks read by many tasks: fragments, shared texts, sheets by name, rows in order, odd workbooks."""

import io
import zipfile

import pytest

from kindred.sources import excel, files, sheets, sinks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(parts: dict[str, str], shared: str = "", prefix: str = "") -> bytes:
    """A workbook of several sheets, name -> XML of its rows."""
    sink, x = io.BytesIO(), f"{prefix}:" if prefix else ""
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        sheets_ = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rel{k}"/>' for k, n in enumerate(parts, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{sheets_}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rel{k}" Target="worksheets/part{k}.xml"/>' for k in range(1, len(parts) + 1)) + "</Relationships>")
        for k, rows in enumerate(parts.values(), 1):
            z.writestr(f"xl/worksheets/part{k}.xml", f'<?xml version="1.0"?><{x}worksheet xmlns{":" + prefix if prefix else ""}="{MAIN}" xmlns:e="urn:e"><{x}cols/><{x}sheetData>{rows}</{x}sheetData><{x}rowBreaks/></{x}worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
    return sink.getvalue()


SHARED = "<si><t>Код</t></si><si><r><t>Гру</t></r><r><t>ппа</t></r><rPh><t>no</t></rPh></si><si><t/></si><si><t>кабель &lt;3x2.5&gt;</t></si>"
ROWS = '<row r="2" e:x="1"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"/><row r="5"><c r="A5"><v>7.0</v></c><c r="C5" t="s"><v>3</v></c></row><row r="6"><c r="A6" t="s"><v>2</v></c></row><row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c><v>1.50</v></c><c t="str"><f>A1</f><v>f</v></c><c><v>9</v></c></row>'


def test_cells_of_every_kind(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book({"empty": "", "list": ROWS}, SHARED))
    got = excel.read_excel(spark, str(tmp_path / "a.xlsx"), "list")
    assert got.columns == ["Код", "column_2", "Группа", "_row"]
    assert [tuple(r) for r in got.collect()] == [("7", None, "кабель <3x2.5>", 3), ("inline", "1.50", "f", 5)]
    empty = excel.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert empty.columns == ["_row"] and empty.count() == 0
    with pytest.raises(Exception, match="no sheet"):
        excel.read_excel(spark, str(tmp_path / "a.xlsx"), "none")


def test_prefixed_tags(spark, tmp_path):
    rows = '<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c></x:row><x:row r="2"><x:c r="A2" t="s"><x:v>3</x:v></x:c></x:row>'
    (tmp_path / "a.xlsx").write_bytes(book({"s": rows}, SHARED, "x"))
    assert [tuple(r) for r in excel.read_excel(spark, str(tmp_path / "a.xlsx")).collect()] == [("кабель <3x2.5>", 1)]


def test_small_fragments_give_the_same_rows(monkeypatch):
    whole = list(sheets.fragments(book({"s": ROWS}, SHARED), 1))
    monkeypatch.setattr(sheets, "FRAGMENT", 7)
    small = list(sheets.fragments(book({"s": ROWS}, SHARED), 1))
    rows = lambda found: [r for k, before, first, header, xml, texts in found for r in sheets.cells(xml, texts, before)]
    assert len(whole) == 1 and len(small) == 4 and {tuple(f[3]) for f in small} == {("Код", "column_2", "Группа")}
    assert [r for r in rows(small) if any(r[1])] == [r for r in rows(whole) if any(r[1])]


def test_a_large_sheet_is_many_tasks_in_order(spark, tmp_path):
    data = excel.workbook(["Наименование", "Цена"], ((f"товар {k} " + "x" * 200, k) for k in range(20_000)), "s")
    (tmp_path / "a.xlsx").write_bytes(data)
    raw = excel.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert raw.rdd.getNumPartitions() > 1 and [r["_row"] for r in raw.select("_row").collect()] == list(range(1, 20_001))
    got = files.load(spark, str(tmp_path / "a.xlsx"))
    assert [(r["name"].split()[1], r["price"]) for r in got.collect()] == [(str(k), float(k)) for k in range(20_000)]


def test_workbooks_of_a_folder_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(excel.workbook(["name", "price"], [("a", 1)], "s"))
    (tmp_path / "b.xlsx").write_bytes(excel.workbook(["cost", "товар", "colour`s"], [(2, "b", "red")], "s"))
    got = files.load(spark, str(tmp_path), file_format="xlsx")
    assert [(r["name"], r["price"], r["specifications"]) for r in got.collect()] == [("a", 1.0, {}), ("b", 2.0, {"colour`s": "red"})]


def test_the_first_text_column_is_the_name(spark, tmp_path):
    rows = '<row r="1"><c t="inlineStr"><is><t>x1</t></is></c><c t="inlineStr"><is><t>x2</t></is></c><c t="inlineStr"><is><t>x3</t></is></c></row><row r="2"><c><v>5</v></c><c t="inlineStr"><is><t>кабель</t></is></c><c t="inlineStr"><is><t>z</t></is></c></row>'
    (tmp_path / "a.xlsx").write_bytes(book({"s": rows}))
    got = files.load(spark, str(tmp_path / "a.xlsx"), "materials").collect()
    assert [(r["id"], r["name"], r["specifications"]) for r in got] == [("1", "кабель", {"x1": "5", "x3": "z"})]
    (tmp_path / "b.xlsx").write_bytes(book({"s": rows.replace("кабель", "").replace(">z<", "><")}))
    assert [r["name"] for r in files.load(spark, str(tmp_path / "b.xlsx"), "materials").collect()] == ["5"]
    (tmp_path / "c.xlsx").write_bytes(excel.workbook(["colour", "name"], [("no", "c")], "s"))
    assert [r["name"] for r in files.load(spark, str(tmp_path), "materials", "xlsx").collect()] == ["кабель", "5", "c"]


def test_a_table_of_workbooks(spark):
    rows = spark.range(10).selectExpr("id", "concat('n', id) as name", "id * 1.5 as price").repartition(2)
    books = excel.workbooks(rows, "s", 3)
    assert books.count() >= 4
    got = excel.price_list_from_excel(spark, books)
    assert sorted((r["id"], r["name"], r["price"]) for r in got.collect()) == [(str(k), f"n{k}", k * 1.5) for k in range(10)]
    assert excel.price_list_from_excel(spark, books.limit(0)).count() == 0


def test_round_trip_of_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a\n  b", "ü ' \" &"), ("😀" * 500, None)], "name string, description string")
    assert sinks.write_xlsx(rows, str(tmp_path / "r.xlsx"))
    assert [tuple(r)[:2] for r in excel.read_excel(spark, str(tmp_path / "r.xlsx")).collect()] == [tuple(r) for r in rows.collect()]
