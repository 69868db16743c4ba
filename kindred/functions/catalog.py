"""Scalar rules of the item catalogue: categories, currencies, prices, grades, ids, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Words that name a category, its label, and the aliases of currencies.
CATEGORY_WORDS = {"кабель": "cables", "провод": "cables", "светильник": "lighting", "лампа": "lighting", "выключатель": "switches", "автомат": "automation", "электрик": "electrical"}
CATEGORY_NAMES = {"electrical": "Электрооборудование", "cables": "Кабели и провода", "lighting": "Освещение", "switches": "Выключатели", "automation": "Автоматика", "general": "Общее"}
CATEGORY_RELATIONS = {("electrical", "cables"): 0.7, ("electrical", "switches"): 0.8, ("lighting", "electrical"): 0.6, ("automation", "switches"): 0.7}
CURRENCY_ALIASES = {"РУБ": "RUB", "РУБЛЬ": "RUB", "РУБ.": "RUB", "RUR": "RUB", "$": "USD", "ДОЛЛАР": "USD", "€": "EUR", "ЕВРО": "EUR"}


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def category(c: Column) -> Column:
    return lookup(CATEGORY_WORDS, F.trim(F.lower(T.text(c))), "general")


def category_name(c: Column) -> Column:
    return lookup(CATEGORY_NAMES, T.text(c), "Общее")


def currency(c: Column) -> Column:
    return lookup(CURRENCY_ALIASES, F.trim(F.upper(T.text(c))), "RUB")


def category_similarity(a: Column, b: Column) -> Column:
    out = F.when(a.isNull() & b.isNull(), 0.8).when(a.isNull() | b.isNull(), 0.6).when(a == b, 1.0)
    for (x, y), value in CATEGORY_RELATIONS.items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), value)
    return out.otherwise(0.3)


def price_display(price: Column, unit: Column) -> Column:
    shown = F.translate(F.format_number(price, 2), ",", " ")
    return F.when(F.coalesce(price, F.lit(0.0)) <= 0, "Не указана").otherwise(F.concat(shown, F.lit(" "), unit))


def relevance_band(relevance: Column) -> Column:
    return F.when(relevance > 0.7, "high").when(relevance > 0.4, "medium").otherwise("low")


def match_confidence(pct: Column, retrieval: Column) -> Column:
    return F.least(pct / 100 + F.least(retrieval / 10, F.lit(0.3)), F.lit(1.0))


def quality_score(pct: Column, retrieval: Column) -> Column:
    return 0.6 * pct + 0.3 * F.least(10 * retrieval, F.lit(30.0)) + 10 * match_confidence(pct, retrieval)


def quality_grade(score: Column) -> Column:
    return F.when(score >= 90, "Отличное").when(score >= 75, "Хорошее").when(score >= 60, "Удовлетворительное").when(score >= 40, "Слабое").otherwise("Плохое")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)


def variant_id(article: Column, brand_code: Column, cli_code: Column, *fallback: Column) -> Column:
    filled = [F.nullif(F.trim(T.text(c)), F.lit("")) for c in (article, brand_code, cli_code)]
    return F.coalesce(*filled, F.concat(F.lit("auto_"), stable_id(*fallback)))


def validation_errors(**rules: Column) -> Column:
    """Names of the rules that hold."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def _blank(c: Column) -> Column:
    return F.trim(T.text(c)) == ""


def material_errors(id_: Column, name: Column, description: Column) -> Column:
    return validation_errors(blank_id=_blank(id_), blank_name=_blank(name), blank_description=_blank(description))


def price_item_errors(id_: Column, name: Column, price: Column, supplier: Column) -> Column:
    return validation_errors(blank_id=_blank(id_), blank_name=_blank(name), negative_price=F.coalesce(price < 0, F.lit(False)), blank_supplier=_blank(supplier))
