"""Record rules shared by the readers: alias mapping, number parsing, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings of each standard field, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "name": ("name", "material_name", "title", "наименование", "наименования", "название"),
    "description": ("description", "desc", "details", "описание", "детали"),
    "category": ("category", "class", "type", "категория", "класс", "тип"),
    "brand": ("brand", "бренд"),
    "manufacturer": ("manufacturer", "производитель", "завод производитель", "завод изг", "завод изг.", "завод изг ."),
    "equipment_code": ("equipment_code", "код обор", "код обор.", "код оборудования", "equipment"),
    "type_mark": ("type_mark", "тип марка", "тип, марка", "марка", "тип"),
    "model": ("model", "модель"),
    "unit": ("unit", "measure", "единица", "ед_изм", "ед. изм."),
    "quantity": ("quantity", "qty", "кол-во", "количество"),
    "id": ("id", "article", "артикул"),
    "article": ("article", "артикул"),
    "brand_code": ("brand_code", "код_бренда", "код бренда"),
    "cli_code": ("cli_code", "client_code", "клиентский_код", "клиентский код"),
    "material_class": ("class", "material_class", "класс", "класс материала"),
    "class_code": ("class_code", "код_класса", "код класса"),
    "price": ("price", "cost", "цена", "стоимость"),
    "currency": ("currency", "валюта"),
    "supplier": ("supplier", "vendor", "поставщик", "продавец"),
    "material_name": ("material_name", "name", "title", "наименование", "название"),
}
# Lengths that the fast JSON reader cuts fields to.
LENGTHS = {"name": 500, "brand": 100, "article": 100, "brand_code": 100, "cli_code": 100, "material_class": 200, "class_code": 50, "description": 1000, "currency": 10, "supplier": 200}


def resolve_aliases(header: Sequence[str]) -> tuple[dict[str, str], list[str]]:
    """(standard field -> column, columns left for the specifications) of one header: whole names first,
    then parts of names; a column serves one field. Only whole names keep a column out of the rest."""
    low = {c: c.lower().strip() for c in header}
    taken: dict[str, str] = {}

    def claim(fits) -> None:
        for field, names in ALIASES.items():
            if field not in taken:
                free = [c for c in header if c not in taken.values()]
                hit = next((c for n in names for c in free if fits(n, low[c])), None)
                if hit is not None:
                    taken[field] = hit

    claim(lambda name, column: name == column)
    claim(lambda name, column: name in column)
    whole = {n for names in ALIASES.values() for n in names}
    return taken, [c for c in header if c.lower() not in whole]


def column(name: str) -> Column:
    """A column by its name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_filled(columns: Sequence[str], *names: str) -> Column:
    """The first non-null column of these, whatever their case; null if none is there."""
    low = {c.lower().strip(): c for c in columns}
    there = [column(low[n]).cast("string") for n in names if n in low]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def per_record(df: DataFrame, field: str) -> Column:
    """A field mapped record by record: its aliases' columns, the first that is not null."""
    return first_filled(df.columns, *ALIASES[field])


def specifications(df: DataFrame, columns: Sequence[str]) -> Column:
    """map<string,string> of the given columns without nulls."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), column(c).cast("string").alias("value")) for c in columns])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def number(c: Column, default: float | None = None) -> Column:
    """A price as people write it: currency words, blanks and decimal commas; ``default`` if it is none."""
    plain = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?iu)₽|руб\.?|[\s\x{A0}]", ""), ",", ".")
    out = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def truncated(df: DataFrame, lengths: dict[str, int] = LENGTHS) -> DataFrame:
    return df.withColumns({c: F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(n)) for c, n in lengths.items() if c in df.columns})
