"""Spreadsheets as item lists: roles of columns, the two readers, and a writer."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from itertools import chain, islice
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .records import number
from .sheets import Sheet

# Words that give a column its role.
ROLES: dict[str, tuple[str, ...]] = {
    "name": ("наименование", "название", "материал", "name", "material", "material_name", "наименование материала", "item", "товар", "продукт", "product", "артикул", "номенклатура"),
    "description": ("описание", "description", "характеристика", "комментарий", "примечание", "comment", "note", "спецификация", "тех.характеристики"),
    "category": ("категория", "category", "тип", "type", "группа", "group", "раздел", "класс", "вид", "classification"),
    "brand": ("бренд", "brand", "марка", "фирма"),
    "manufacturer": ("производитель", "изготовитель", "manufacturer", "vendor", "завод изг", "завод изг.", "завод изготовитель", "завод производитель", "поставщик производителя", "завод-изготовитель"),
    "model": ("модель", "model", "артикул", "article", "код", "code", "sku", "part_number", "код товара", "код изготовителя"),
    "unit": ("ед.изм", "единица", "unit", "ед", "единица измерения", "units", "uom", "ед изм", "measure"),
    "price": ("цена", "price", "стоимость", "cost", "тариф", "расценка", "цена за единицу", "unit_price", "прайс"),
    "supplier": ("поставщик", "supplier", "vendor", "продавец", "дилер", "компания", "company", "организация", "контрагент"),
    "id": ("id", "код", "номер", "артикул", "sku", "№", "number", "item_id", "product_id", "код товара", "идентификатор"),
    "equipment_code": ("код обор", "код обор.", "код оборудования", "equipment_code", "equipment", "оборудование", "код оборудование"),
}


def read_excel(spark: SparkSession, path: str | DataFrame, sheet: str | int = 1) -> DataFrame:
    """Text columns by the header row and ``_row`` from 1, of a workbook or a folder of them; the sheet by its name or
    place. Cells to the right of the header are left out."""
    return Sheet(spark, path, sheet).rows()


def find_column(header: Sequence[str], role: str) -> str | None:
    """The first column whose name contains one of the role's words, or is contained in one."""
    for c in header:
        low = c.lower().strip()
        if any(w in low or low in w for w in ROLES[role]):
            return c
    return None


def detect_kind(header: Sequence[str]) -> str:
    """A price or supplier column makes a price list."""
    return "pricelist" if find_column(header, "price") or find_column(header, "supplier") else "materials"


def roles(header: Sequence[str]) -> dict[str, str]:
    """Role -> column; a column may have several roles."""
    return {r: c for r in ROLES if (c := find_column(header, r))}


def _by_role(spark: SparkSession, path: str | DataFrame, sheet: str | int):
    """Each workbook by the roles of its own header; without a name column the first one with text is it."""
    df = Sheet(spark, path, sheet).records(roles, tuple(ROLES), "name")
    get = lambda r: F.nullif(F.trim(T.text(F.col(r))), F.lit(""))
    return df.filter((T.text(get("name")) != "") & (F.lower(T.text(get("name"))) != "nan")), get


def materials_from_excel(spark: SparkSession, path: str | DataFrame, sheet: str | int = 1) -> DataFrame:
    df, get = _by_role(spark, path, sheet)
    return df.select(
        F.coalesce(get("id"), F.col("_row").cast("string")).alias("id"), get("name").alias("name"), F.lit(None).cast("string").alias("type_mark"), get("equipment_code").alias("equipment_code"), get("manufacturer").alias("manufacturer"),
        F.coalesce(get("unit"), F.lit("шт")).alias("unit"), F.lit(None).cast("double").alias("quantity"), F.coalesce(get("description"), get("name")).alias("description"), F.coalesce(get("category"), F.lit("Общая")).alias("category"),
        get("brand").alias("brand"), get("model").alias("model"), "specifications",
    )


def price_list_from_excel(spark: SparkSession, path: str | DataFrame, sheet: str | int = 1) -> DataFrame:
    df, get = _by_role(spark, path, sheet)
    none = F.lit(None).cast("string")
    return df.select(
        F.coalesce(get("id"), F.col("_row").cast("string")).alias("id"), get("name").alias("name"), get("brand").alias("brand"), get("model").alias("article"), none.alias("brand_code"), none.alias("cli_code"), none.alias("material_class"), none.alias("class_code"),
        number(get("price"), 0.0).alias("price"), get("name").alias("material_name"), F.coalesce(get("description"), get("name")).alias("description"), F.lit("RUB").alias("currency"), F.coalesce(get("supplier"), F.lit("Не указан")).alias("supplier"),
        F.coalesce(get("category"), F.lit("Общая")).alias("category"), F.coalesce(get("unit"), F.lit("шт")).alias("unit"), "specifications",
    )


def workbooks(rows: DataFrame, title: str, most: int = 1_048_575) -> DataFrame:
    """path, content: the rows as workbooks of at most ``most`` rows, each made by the task that has its rows. A path tells
    the partition and the place in it."""
    columns = rows.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, every = TaskContext.get().partitionId(), (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for k, first in enumerate(every):
            content = workbook(columns, chain([first], islice(every, most - 1)), title)
            yield pa.RecordBatch.from_pydict({"path": [f"{part:08d}-{k:08d}.xlsx"], "content": [content]})

    return rows.mapInArrow(make, "path string, content binary")


def workbook(header: Sequence[str], rows: Iterator[Sequence], title: str) -> bytes:
    """A one-sheet workbook of inline texts."""
    sink = io.BytesIO()
    types = "http://schemas.openxmlformats.org/package/2006/"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        z.writestr("[Content_Types].xml", f'<Types xmlns="{types}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{part}worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{types}relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(title[:31])}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{types}relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for r in (header, *rows):
                cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in r)
                f.write(f"<row>{cells}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return sink.getvalue()
