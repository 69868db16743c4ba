"""Statistics, summaries, formatted results, selections, price refresh and flat exports of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as T
from .stored import large


def match_statistics(materials: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: totals, match rate, matches a material, and similarity range (0 without matches)."""
    each = matches.groupBy("material_id").agg(F.count("*").alias("n"), F.sum("pct").alias("s"), F.max("pct").alias("hi"), F.min("pct").alias("lo"))
    all_ = materials.select(F.col("id").alias("material_id")).join(each, "material_id", "left")
    out = all_.agg(F.count("*").alias("total_materials"), F.count("n").alias("with_matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), F.sum("s").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    n = F.col("total_materials")
    return out.select(
        n, "with_matches", (n - F.col("with_matches")).alias("without_matches"), F.coalesce(F.try_divide(100.0 * F.col("with_matches"), n), F.lit(0.0)).alias("match_rate"), "total_matches",
        F.coalesce(F.try_divide(F.col("total_matches").cast("double"), n), F.lit(0.0)).alias("avg_matches"), F.coalesce(F.try_divide("s", "total_matches"), F.lit(0.0)).alias("avg_similarity"),
        F.coalesce("hi", F.lit(0.0)).alias("max_similarity"), F.coalesce("lo", F.lit(0.0)).alias("min_similarity"),
    )


def results_summary(materials: DataFrame, matches: DataFrame) -> DataFrame:
    """The best match and the number of matches of every material; nulls and 0 where there is none."""
    best = matches.groupBy("material_id").agg(F.max_by("price_id", F.struct("pct", -F.col("match_rank"))).alias("best_price_id"), F.max("pct").alias("best_pct"), F.count("*").alias("matches"))
    out = materials.select(F.col("id").alias("material_id"), F.coalesce("name", F.lit("Unknown")).alias("material_name")).join(large(best), "material_id", "left")
    return out.withColumns({"best_pct": F.coalesce("best_pct", F.lit(0.0)), "matches": F.coalesce("matches", F.lit(0))})


def at_least(matches: DataFrame, threshold: float = 90.0) -> DataFrame:
    return matches.filter(F.col("pct") >= threshold)


def best_overall(matches: DataFrame, n: int) -> DataFrame:
    """The n best matches of all, ties by ids."""
    return matches.orderBy(F.desc("pct"), "material_id", "price_id").limit(n)


def format_rows(materials: DataFrame, items: DataFrame, matches: DataFrame, most: int = 7) -> DataFrame:
    """Flat form of the formatted result: up to ``most`` variants a material with relevance from 0 to 1, and one
    row without a variant for a material that has none."""
    kept = matches.filter(F.col("match_rank") <= most)
    p = items.select(F.col("id").alias("price_id"), F.col("name").alias("variant_name"), "article", "brand_code", "cli_code", "price", "brand")
    m = materials.select(F.col("id").alias("material_id"), F.coalesce("name", F.lit("Unknown")).alias("material_name"))
    out = m.join(large(kept.join(large(p), "price_id")), "material_id", "left")
    variant = F.when(F.col("price_id").isNotNull(), catalog.variant_id(F.col("article"), F.col("brand_code"), F.col("cli_code"), F.col("price_id"), F.col("variant_name")))
    return out.select("material_id", "material_name", "price_id", "match_rank", variant.alias("variant_id"), "variant_name", F.round(F.col("pct") / 100, 4).alias("relevance"), "price")


def nest(formatted: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """One row a material with its variants by rank, none for one without matches; ``order`` (material_id,
    position) fixes the order."""
    variant = F.struct("match_rank", "price_id", "variant_id", "variant_name", "relevance", "price")
    variants = F.array_sort(F.collect_list(F.when(F.col("price_id").isNotNull(), variant)))
    out = formatted.groupBy("material_id").agg(F.first("material_name").alias("material_name"), variants.alias("matches"))
    return out if order is None else out.join(order, "material_id").orderBy("position").drop("position")


def format_statistics(formatted: DataFrame, selections: DataFrame) -> DataFrame:
    chosen = formatted.join(selections.select("material_id", "variant_id").distinct().withColumn("chosen", F.lit(1)), ["material_id", "variant_id"], "left")
    out = chosen.agg(F.countDistinct("material_id").alias("materials"), F.count("price_id").alias("variants"), F.coalesce(F.round(F.avg("relevance"), 4), F.lit(0.0)).alias("avg_relevance"), F.countDistinct(F.when(F.col("chosen") == 1, F.col("material_id"))).alias("selected"))
    return out.withColumn("selection_rate", F.coalesce(F.round(F.try_divide(100.0 * F.col("selected"), F.col("materials")), 2), F.lit(0.0)))


def auto_select(matches: DataFrame) -> DataFrame:
    """Each material's variant of greatest percentage after rounding to one place; the first on ties."""
    w = Window.partitionBy("material_id").orderBy(F.desc(F.round("pct", 1)), "match_rank")
    return matches.withColumn("r", F.row_number().over(w)).filter("r = 1").select("material_id", "price_id", F.round("pct", 1).alias("shown_pct"))


def selected_only(matches: DataFrame, selections: DataFrame) -> DataFrame:
    return matches.join(selections.select("material_id", "price_id"), ["material_id", "price_id"], "left_semi")


def export_selected(formatted: DataFrame, selections: DataFrame, with_unselected: bool = True) -> DataFrame:
    """Selected materials keep only their variant; the others all of theirs, or none."""
    sel = selections.select("material_id", "variant_id").distinct()
    chosen = formatted.join(sel, ["material_id", "variant_id"], "left_semi")
    rest = formatted.join(sel.select("material_id").distinct(), "material_id", "left_anti")
    return chosen.unionByName(rest) if with_unselected else chosen


def refresh_prices(matches: DataFrame, code: Column, quotes: DataFrame) -> DataFrame:
    """matches with price, currency and availability by code from ``quotes`` (code, price, seq); the last
    quote of a code counts."""
    last = quotes.groupBy("code").agg(F.max_by("price", "seq").alias("quoted"))
    out = matches.withColumn("code", code).join(last.withColumn("known", F.lit(True)), "code", "left")
    status = F.when(F.col("known").isNull(), "Не найден").when(F.coalesce("quoted", F.lit(0.0)) > 0, "В наличии").otherwise("Нет цены")
    shown = F.when(F.coalesce("quoted", F.lit(0.0)) > 0, F.translate(F.format_number("quoted", 2), ",", " ")).otherwise("-")
    return out.select(*matches.columns, "code", F.col("quoted").alias("new_price"), F.when(F.col("known"), "RUB").alias("new_currency"), status.alias("availability"), shown.alias("shown_price"))


def distinct_codes(items: DataFrame, code: str = "article") -> DataFrame:
    return items.filter(T.text(F.col(code)) != "").select(F.col(code).alias("code")).distinct()


def operation_report(records: DataFrame, operation: str, duration: str) -> DataFrame:
    """count, mean, least and greatest duration of each operation."""
    return records.groupBy(F.col(operation).alias("operation")).agg(F.count("*").alias("n"), F.avg(duration).alias("avg_duration"), F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``, at the place of the first (column ``position``). An aggregate,
    so a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c != key and c not in order]
    turn = F.struct(*order)
    out = rows.groupBy(key).agg(F.max(F.struct(turn.alias("turn"), F.struct(*others).alias("row"))).alias("last"), F.min(turn).alias("first"))
    return out.select(key, "last.row.*", F.col(f"first.{order[0]}").alias("position"))


def csv_rows(materials: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
    """The 13 flat columns of the CSV export; missing texts become ''."""
    col = lambda c: T.text(F.col(c))
    m = materials.select(F.col("id").alias("material_id"), F.col("name").alias("material_name"), col("description").alias("material_description"), col("category").alias("material_category"), col("manufacturer").alias("material_brand"))
    p = items.select(F.col("id").alias("price_id"), F.col("name").alias("price_item_name"), col("description").alias("price_item_description"), "price", col("currency").alias("currency"), col("supplier").alias("supplier"))
    out = matches.select("material_id", "price_id", "pct", "score").join(large(m), "material_id").join(large(p), "price_id")
    return out.select(*m.columns, F.col("price_id").alias("price_item_id"), *p.columns[1:], F.round("pct", 2).alias("similarity_percentage"), F.round("score", 4).alias("retrieval_score"))


# The spreadsheet's headings, material side and price side.
XLSX_MATERIAL = {"Наименования": "name", "Код обор.": "equipment_code", "Завод изг.": "manufacturer", "ID материала": "id", "Описание материала": "description", "Категория материала": "category", "Тип, марка": "type_mark", "Ед. изм. (материал)": "unit", "Кол-во": "quantity"}
XLSX_PRICE = {"name": "name", "article": "article", "brand": "brand", "id": "id", "Цена": "price", "Описание в прайсе": "description", "Код бренда": "brand_code", "Класс": "material_class", "Код класса": "class_code", "Валюта": "currency"}
XLSX_COLUMNS = ("Наименования", "Код обор.", "Завод изг.", "Релевантность", "name", "article", "brand", "id", "Цена", "ID материала", "Описание материала", "Категория материала", "Тип, марка", "Ед. изм. (материал)", "Кол-во", "Описание в прайсе", "Код бренда", "Класс", "Код класса", "Валюта", "Оценка поиска")


def xlsx_rows(materials: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
    """The 21 columns of the spreadsheet export, all text; the relevance is printed with one place."""
    pick = lambda df, names: [T.text(F.col(c) if c in df.columns else F.lit("")).alias(n) for n, c in names.items()]
    m = materials.select(F.col("id").alias("material_id"), *pick(materials, XLSX_MATERIAL))
    p = items.select(F.col("id").alias("price_id"), *pick(items, XLSX_PRICE))
    shown = F.concat(F.format_string("%.1f", F.round("pct", 1)), F.lit("%")).alias("Релевантность")
    out = matches.select("material_id", "price_id", shown, F.round("score", 4).cast("string").alias("Оценка поиска")).join(large(m), "material_id").join(large(p), "price_id")
    return out.select(*[f"`{c}`" for c in XLSX_COLUMNS])
