"""Sources, sinks, index tables, strategies and streaming, end to end on small files."""

import json

import pytest
from pyspark.sql import functions as F

from kindred.operators import matching, reports
from kindred.plans.engine import Engine, EngineConfig
from kindred.plans.index import TableIndex
from kindred.sources import excel, files, sinks
from kindred.sources.records import resolve_aliases
from kindred.streaming.incremental import match_stream

MATERIALS = [("1", "Кабель ВВГ 3x1.5", None, "ЗаводА", "ВВГ-3", "Кабели"), ("2", "Лампа LED 10Вт", "лампа светодиодная", None, None, "Свет"), ("3", "Нечто иное", None, None, None, None)]
ITEMS = [("a", "Кабель ВВГ 3х1,5", "ЗаводА", "ВВГ-3", 10.0), ("b", "Кабель ВВГ 3х2,5", "ЗаводА", "ВВГ-4", 12.0), ("c", "Лампа светодиодная LED 10Вт", "Свет", "L-10", 5.0)]


@pytest.fixture(scope="module")
def small(spark):
    m = spark.createDataFrame(MATERIALS, "id string, name string, description string, manufacturer string, equipment_code string, category string")
    p = spark.createDataFrame(ITEMS, "id string, name string, brand string, article string, price double")
    p = p.select("*", F.col("name").alias("description"), *[F.lit(None).cast("string").alias(c) for c in ("brand_code", "cli_code", "category", "currency", "supplier")])
    return m, p


def test_size_decides(small):
    m, p = small
    got = {(r["material_id"], r["match_rank"]): r["price_id"] for r in matching.keyword_match(m, p).collect()}
    assert got["1", 1] == "a" and got["2", 1] == "c" and ("3", 1) not in got


@pytest.mark.parametrize("strategy", ["keyword", "search", "block", "exact", "fuzzy", "hybrid"])
def test_strategies(spark, small, strategy):
    out = Engine(spark).match(*small, strategy=strategy)
    assert ("1", "a") in {(r["material_id"], r["price_id"]) for r in out.collect()}


def test_reports(spark, small):
    m, p = small
    matches = matching.keyword_match(m, p)
    s = reports.match_statistics(m, matches).first()
    assert (s["total_materials"], s["with_matches"], s["without_matches"]) == (3, 2, 1)
    assert reports.match_statistics(m, matches.limit(0)).first()["max_similarity"] == 0.0
    summary = {r["material_id"]: r["best_price_id"] for r in reports.results_summary(m, matches).collect()}
    assert summary == {"1": "a", "2": "c", "3": None}
    nested = Engine(spark).formatted(m, p, matches)
    assert nested.filter("material_id = '1'").first()["matches"][0]["variant_id"] == "ВВГ-3"


def test_csv_layouts(spark, tmp_path):
    old = tmp_path / "old.csv"
    old.write_bytes('id;name;brand;model;specifications\n1;"Автомат ""С16""";IEK;ВА47-29;"{""a"": 1}"\n2;Щит ЩРН-12;;;bad\n'.encode("cp1251"))
    rows = {r["id"]: r for r in files.load(spark, str(old), "materials").collect()}
    assert rows["1"]["name"] == 'Автомат "С16"' and rows["1"]["equipment_code"] == "ВА47-29" and rows["1"]["specifications"] == {"a": "1"}
    assert rows["2"]["equipment_code"] == "ЩРН-12" and rows["2"]["specifications"] == {}
    new = tmp_path / "price.csv"
    new.write_text("id,material_name,price,specifications\n1,Кабель ВВГНГ 3х2,abc,\n2,Реле РТ-40,7.5,\n", encoding="utf-8")
    rows = {r["id"]: r for r in files.load(spark, str(new)).collect()}
    assert rows["1"]["price"] is None and rows["2"]["price"] == 7.5 and rows["2"]["article"] == "РТ-40" and rows["1"]["currency"] == "RUB"
    with pytest.raises(ValueError):
        files.load(spark, "x.pdf")


def test_json_aliases(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps([{"title": "A", "cost": "1 234,5", "vendor": "V", "colour": "red"}, {"наименование": "Б", "стоимость": "x"}, {"price": 3}], ensure_ascii=False), encoding="utf-8")
    rows = files.load(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["name"], r["price"], r["supplier"]) for r in rows] == [("1", "A", 1234.5, "V"), ("2", "Б", 0.0, None)]
    assert rows[0]["specifications"] == {"colour": "red"}
    assert [r["name"] for r in files.price_list_from_json_fast(spark, str(path)).collect()] == ["A", "Б"]
    assert resolve_aliases(["Артикул", "Наименование", "цвет"])[0] == {"id": "Артикул", "name": "Наименование"}


def test_excel_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Кабель <&>", "1 200,50 ₽", "Склад", "красный"), ("", "5", "x", "y")], "`Наименование` string, `Цена` string, `Поставщик` string, `цвет` string")
    path = str(tmp_path / "p.xlsx")
    assert sinks.write_xlsx(rows, path)
    got = files.load(spark, path).collect()
    assert [(r["name"], r["price"], r["supplier"], r["specifications"]) for r in got] == [("Кабель <&>", 1200.5, "Склад", {"цвет": "красный"})]
    assert excel.detect_kind(["Наименование", "Цена"]) == "pricelist" and not sinks.write_xlsx(rows.limit(0), path)


def test_folder_and_last_wins(spark, tmp_path):
    for k, price in (("a", 1), ("b", 2)):
        (tmp_path / f"{k}.csv").write_text(f"id,name,price\n1,x,{price}\n{k},y,3\n", encoding="utf-8")
    rows = files.load_folder(spark, str(tmp_path), dedupe=True).collect()
    assert {(r["id"], r["price"]) for r in rows} == {("1", 2.0), ("a", 3.0), ("b", 3.0)}
    assert files.load_folder(spark, str(tmp_path)).count() == 4


def test_exports(spark, small, tmp_path):
    m, p = small
    matches = matching.keyword_match(m, p)
    assert Engine(spark).export(m, p, matches, str(tmp_path / "out.csv"), "csv")
    assert len(reports.xlsx_rows(m, p, matches).columns) == 21 and len(reports.csv_rows(m, p, matches).columns) == 13
    assert not sinks.export(reports.csv_rows(m, p, matches).limit(0), str(tmp_path / "no.csv"), "csv")


def test_index_tables(spark, small):
    index = TableIndex(spark, "price_index")
    assert index.create(small[1]) and not index.create(small[1])
    changed = small[1].filter("id = 'a'").withColumn("price", F.lit(99.0))
    assert index.upsert(changed) == {"indexed": 1, "errors": 0}
    assert index.stats() == {"documents": 3} and index.get("a").first()["price"] == 99.0
    index.delete()
    assert not index.exists()


def test_refresh_prices(spark, small):
    m, p = small
    quotes = spark.createDataFrame([("a", 5.0, 1), ("a", 7.0, 2), ("b", 0.0, 1)], "code string, price double, seq int")
    out = {r["code"]: (r["availability"], r["shown_price"]) for r in reports.refresh_prices(p.select("id"), F.col("id"), quotes).collect()}
    assert out == {"a": ("В наличии", "7.00"), "b": ("Нет цены", "-"), "c": ("Не найден", "-")}


def test_config(spark):
    cfg = EngineConfig.merged({"match": {"threshold": 50.0}})
    assert cfg.match.threshold == 50.0 and cfg.match.top_n == 4
    with pytest.raises(TypeError):
        EngineConfig.merged({"nonsense": 1})


def test_stream(spark, small, tmp_path):
    m, p = small
    m.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    match_stream(stream, p, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["price_id"] for r in got.filter("match_rank = 1").collect()} == {"a", "c"}


def test_folder_leaves_out_bad_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,price\n1,x,2\n")
    (tmp_path / "b.xlsx").write_bytes(b"no spreadsheet")
    rows = files.load_folder(spark, str(tmp_path)).collect()
    assert [r["id"] for r in rows] == ["1"]
    (tmp_path / "a.csv").unlink()
    with pytest.raises(ValueError):
        files.load_folder(spark, str(tmp_path))


def test_json_lines_are_numbered_over_partitions(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"name": f"n{k}"}) + "\n" for k in range(3000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.price_list_from_json(spark, str(tmp_path / "p.jsonl"), lines=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(int(r["id"]) for r in rows) == list(range(1, 3001)) and all(r["name"] == f"n{int(r['id']) - 1}" for r in rows)


def test_upsert_survives_an_end_between_renames(spark, tmp_path):
    items = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0)], "id string, name string, price double")
    index = TableIndex(spark, "crash_items")
    index.create(items)
    index._rename("crash_items", "crash_items_before")
    again = TableIndex(spark, "crash_items")
    assert again.stats()["documents"] == 2
    again.upsert(spark.createDataFrame([("2", "c", 3.0), ("3", "d", 4.0), ("3", "e", 5.0)], "id string, name string, price double"))
    assert sorted((r["id"], r["name"]) for r in again.table().collect()) == [("1", "a"), ("2", "c"), ("3", "e")]
    again.export_stats(str(tmp_path / "stats.json"))
    said = json.loads((tmp_path / "stats.json").read_text())
    assert said["documents"] == 3 and said["indexed"] == 3 and said["rows_a_second"] > 0
    again.delete()


def test_materials_without_matches_stay(spark):
    materials = spark.createDataFrame([("1", "one"), ("2", None)], "id string, name string")
    items = spark.createDataFrame([("9", "n", "a", "", "", 1.0, "b")], "id string, name string, article string, brand_code string, cli_code string, price double, brand string")
    matches = spark.createDataFrame([("1", "9", 80.0, 1)], "material_id string, price_id string, pct double, match_rank int")
    flat = reports.format_rows(materials, items, matches)
    nested = {r["material_id"]: (r["material_name"], len(r["matches"])) for r in reports.nest(flat).collect()}
    assert nested == {"1": ("one", 1), "2": ("Unknown", 0)}
