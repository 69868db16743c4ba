"""One array read in many ranges equals the array read at once."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.sources import json_array, sinks


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def records(n=60):
    r = random.Random(2)
    odd = ['a "quoted" } {', "back\\slash\\", "[1, 2]}", "Кабель }{ ВВГ", "", "\\\"}", "line\nend", "tab\t}"]
    out = []
    for k in range(n):
        row = {"id": str(k), "name": r.choice(odd) + f" {k}", "price": r.choice([1.5, "12,5 руб", None, 7])}
        if k % 3 == 0:
            row["details"] = {"voltage": "220 {V}", "inner": {"cores": k, "list": [{"a": "}"}, 2]}}
        if k % 17 == 0:
            row["description"] = "long } text { " * 40
        out.append(row)
    return out


@pytest.mark.parametrize("size, indent", [(37, None), (64, 2), (500, None), (1 << 20, 2)])
def test_equals_the_array_read_at_once(spark, tmp_path, small_ranges, size, indent):
    rows = records()
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
    small_ranges(size)
    got = json_array.array_elements(spark, str(tmp_path / "a.json"))
    if size < 100:
        assert got.sparkSession.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    assert [json.loads(r["record"]) for r in sorted(got.collect(), key=lambda r: r["position"])] == rows
    assert sorted(r["position"] for r in got.collect()) == list(range(1, len(rows) + 1))


def test_fields_are_mapped_record_by_record(spark, tmp_path, small_ranges):
    rows = [
        {"title": "Кабель", "class": "A", "manufacturer": "Завод", "cost": "145,50 руб.", "vendor": "S", "length": 5},
        {"наименование": "Лампа", "стоимость": 7, "производитель": "X", "id": "77", "spec": {"watt": 10, "colour": None}},
        {"price": 1},
        "no object",
        {"name": " "},
        5,
        {"name": "последний", "полная цена": "3"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    small_ranges(50)
    got = {r["name"]: r for r in json_array.price_list_from_json_array(spark, str(tmp_path / "a.json")).collect()}
    assert set(got) == {"Кабель", "Лампа", "последний"}
    assert got["Кабель"]["price"] == 145.5 and got["Кабель"]["id"] == "1" and got["Кабель"]["specifications"]["length"] == "5"
    assert got["Лампа"]["price"] == 7.0 and got["Лампа"]["id"] == "77" and got["Лампа"]["specifications"] == {"watt": "10"}
    assert got["Кабель"]["currency"] == "RUB"


@pytest.mark.parametrize("text", ["", "[]", "[1, 2]", '{"name": "x"}', "[{}]", '[{"name": "cut'])
def test_odd_files(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    got = json_array.array_elements(spark, str(tmp_path / "a.json")).collect()
    assert [r["record"] for r in got] == (["{}"] if text == "[{}]" else [])


def test_folder_of_files(spark, tmp_path, small_ranges):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"name": f"{k}-{j}"} for j in range(k + 2)]))
    small_ranges(20)
    got = json_array.array_elements(spark, str(tmp_path)).collect()
    assert sorted((r["position"], json.loads(r["record"])["name"]) for r in got) == sorted((j + 1, f"{k}-{j}") for k in range(3) for j in range(k + 2))


def test_one_python_pass_a_task(spark, tmp_path):
    """Records are cut and mapped in the same worker; a pass over the rows of another pass would double the workers."""
    (tmp_path / "a.json").write_text('[{"name": "a"}, {"name": "b"}]')
    plan = json_array.price_list_from_json_array(spark, str(tmp_path / "a.json"))._jdf.queryExecution().executedPlan().toString()
    above = []  # depth and name of the operators over this line
    for line in plan.splitlines():
        name = line.lstrip(" :+-*()0123456789")
        depth = len(line) - len(name)
        above = [a for a in above if a[0] < depth]
        if name.startswith("MapInArrow"):
            for a in reversed(above):
                if a[1].startswith("Exchange"):
                    break
                assert not a[1].startswith("MapInArrow"), plan
        above.append((depth, name))
    assert plan.count("MapInArrow") == 3


@pytest.mark.parametrize("n, length, most", [(2500, 3, 1000), (40, 200_000, 6)])
def test_a_task_holds_a_bounded_part(n, length, most):
    """Rows come in and go out in parts bounded in rows and bytes, however many an Arrow batch holds."""
    texts = [json.dumps({"name": "x" * length, "price": k}) for k in range(n)]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * n, "position": list(range(n)), "record": texts})
    taken = []

    def watched():
        for row in json_array._rows(iter([batch])):
            taken.append(row)
            yield row

    given = 0
    for made in json_array._mapped(watched()):
        given += made.num_rows
        assert made.num_rows <= most and len(taken) == given
    assert given == n


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_arrays_are_written_record_by_record(spark, tmp_path, parts):
    """No row holds a part of the table, and the files are arrays, one or more, that the reader reads back whole."""
    rows = spark.range(25).withColumn("name", F.concat(F.lit("a [b] {"), "id"))
    lines = sinks.json_arrays(rows, F.to_json(F.struct("id", "name")), "id", parts)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert lines.count() == 25 and "collect_list" not in plan and plan.count("Exchange") == 1
    lines.write.text(str(tmp_path / "a"))
    found = []
    for text in spark.read.text(str(tmp_path / "a"), wholetext=True).collect():
        for array in text["value"].strip().split("]\n["):
            found += json.loads("[" + array.removeprefix("[").removesuffix("]") + "]")
    assert sorted(found, key=lambda r: r["id"]) == [{"id": k, "name": f"a [b] {{{k}"} for k in range(25)]
    assert sorted(json.loads(r["record"])["id"] for r in json_array.array_elements(spark, str(tmp_path / "a")).collect()) == list(range(25))
