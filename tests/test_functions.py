"""The behaviours that the reference's own test scripts look at, and edge cases of the metrics."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import catalog, extract, metrics, scores
from kindred.functions import text as T


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=90), st.text(max_size=90)), min_size=1, max_size=8))
def test_lcs_equals_dynamic_programming(pairs):
    pairs = [(a.replace("\0", ""), b.replace("\0", "")) for a, b in pairs]
    assert metrics.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [lcs(a, b) for a, b in pairs]


def blocks(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcd ", max_size=40), st.text("abce ", max_size=40)), max_size=60))
def test_matching_blocks_equal_the_standard_library(pairs):
    assert metrics.matched_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [blocks(a, b) for a, b in pairs]


def test_matching_blocks_of_long_and_odd_texts():
    many = "".join(chr(0x400 + k % 300) for k in range(600))
    pairs = [("ab" * 40, "ba" * 150), (many[:500], many[100:299]), (many, many[:50]), ("x" * 1200, "x"), ("", ""), ("", "a"), ("\0a\U0001f600", "a\U0001f600\0"), ("a" * 199, "a" * 199), ("a" * 199, "a" * 200)]
    assert metrics.matched_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [blocks(a, b) for a, b in pairs]
    assert metrics.matched_lengths([], []).tolist() == []


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, ok", [("3х1,5", "3x1.5", True), ("3х1,5", "3x2.5", False), ("С16", "C16", True), ("С16", "C25", False), ("10Вт", "10W", True), ("10Вт", "15W", False), ("", "3x2", True)])
def test_numeric_compatibility(spark, a, b, ok):
    assert value(spark, extract.numeric_compatible(extract.numeric_keys(F.lit(a)), extract.numeric_keys(F.lit(b)))) is ok


@pytest.mark.parametrize("text, found", [("RS-485 конвертер", "RS-485"), ("DTM 1206", "DTM 1206"), ("Рубеж-БИУ R3", "РУБЕЖ-БИУ"), ("кабель 3x2.5", "3x2.5"), ("FireSec-Pro R3", "FIRESEC-PRO")])
def test_model_codes(spark, text, found):
    assert found in value(spark, extract.model_codes(F.lit(text)))


def test_multi_text_bounds(spark):
    rows = spark.createDataFrame([("тест", "тест"), ("кабель", "кабел"), ("кабель", "лампа"), ("", "x")], "a string, b string")
    same, near, far, none = [r[0] for r in rows.select(scores.multi_text(T.multi_normalize(F.col("a")), T.multi_normalize(F.col("b")), ("ratio", "token_sort"))).collect()]
    assert same == 1.0 and 0.8 < near < 1 and far < 0.5 and none == 0.0


def test_partial_and_sequence(spark):
    rows = spark.createDataFrame([("кабель", "силовой кабель ввг"), ("", ""), (None, "x")], "a string, b string")
    out = rows.select(metrics.partial_ratio("a", "b"), metrics.sequence_ratio("a", "b")).collect()
    assert [r[0] for r in out] == [100, 100, 0]
    assert [r[1] for r in out] == [difflib.SequenceMatcher(None, "кабель", "силовой кабель ввг").ratio(), 1.0, 0.0]


def test_composed_characters(spark):
    rows = spark.createDataFrame([("\u0438\u0306",), ("plain",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(metrics.nfc("s")).collect()] == ["\u0439", "plain", "", None]


def test_catalog_rules(spark):
    assert value(spark, catalog.price_display(F.lit(1234.5), F.lit("RUB"))) == "1 234.50 RUB"
    assert value(spark, catalog.price_display(F.lit(None).cast("double"), F.lit("RUB"))) == "Не указана"
    assert value(spark, catalog.material_errors(F.lit(" "), F.lit("x"), F.lit(None))) == ["blank_id", "blank_description"]
    assert value(spark, catalog.relevance_band(F.lit(0.7))) == "medium"


@pytest.mark.parametrize("word, stem", [("кабели", "кабел"), ("кабелями", "кабел"), ("красивая", "красив"), ("выключатель", "выключател"), ("led", "led")])
def test_stemmer(spark, word, stem):
    assert value(spark, T.russian_stem(F.lit(word))) == stem
