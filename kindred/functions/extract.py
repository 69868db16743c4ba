"""Model codes, articles and numeric keys found in item texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Patterns of model codes, matched without regard to case. The first set keeps the
# text's case, the second is compared in capitals.
MODEL_PATTERNS = (r"RS-\d+", r"DTM\s*\d+", r"FireSec[\p{L}\p{N}_\-]+", r"R\d[\p{L}\p{N}_\-]+", r"[A-Z]{2,}[\-\s]\d+[\p{L}\p{N}_\-]*", r"\d+x[\d\.]+")
MODEL_PATTERNS_UPPER = (r"RS-\d+", r"DTM\s*\d+[A-Za-z]*\s*\d*", r"FireSec[\p{L}\p{N}_\-]*", r"R\d[\p{L}\p{N}_\-]*", r"Рубеж[\p{L}\p{N}_\-]*", r"БИУ[\p{L}\p{N}_\-]*", r"\d+[ВвV]\s*\d+[АаAч]+")
# Codes in names of the two older file layouts.
EQUIPMENT_CODE = r"[A-ZА-Я][A-ZА-Я0-9\-\.]+(?:\s*\d+[xх×]?\d*(?:[.,]\d+)?)?"
ARTICLE_CODE = r"[A-ZА-Я][A-ZА-Я0-9\-\.]+(?:\d+[A-ZА-Я]*)?"
_NUMBER = r"(\d+(?:[.,]\d+)?)"
# Kinds of numeric keys. (name before, name after, pattern)
NUMERIC_KEYS = (("circuit_c", "", r"[cсCС]\s*(\d+)"), ("power_", "w", _NUMBER + r"\s*(?:вт|w|ватт)"), ("current_", "a", _NUMBER + r"\s*(?:а|a|ампер)"), ("area_", "mm2", _NUMBER + r"\s*(?:мм²?|кв\.?мм)"))
SIZE = _NUMBER + r"\s*[xх×]\s*" + _NUMBER


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def model_codes(c: Column) -> Column:
    t = T.text(c)
    found = [_all(t, "(?iu)" + p) for p in MODEL_PATTERNS]
    found += [F.transform(_all(t, "(?iu)" + p), F.upper) for p in MODEL_PATTERNS_UPPER]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def equipment_code(c: Column) -> Column:
    """The first code of more than three characters."""
    return F.get(F.filter(_all(T.text(c), EQUIPMENT_CODE), lambda x: F.length(x) > 3), F.lit(0))


def article_code(c: Column) -> Column:
    """The longest code of more than three characters with a digit; the first of the longest."""
    codes = F.filter(_all(T.text(c), ARTICLE_CODE), lambda x: (F.length(x) > 3) & x.rlike(r"\d"))
    longest = F.array_max(F.transform(codes, F.length))
    return F.get(F.filter(codes, lambda x: F.length(x) == longest), F.lit(0))


def _value(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).cast("double").cast("string")


def _framed(before: str, number, after: str):
    return lambda v: F.concat(F.lit(before), number(v), F.lit(after))


def numeric_keys(c: Column) -> Column:
    """Sorted set of keys such as cable_3.0x2.5, circuit_c16, power_10.0w, current_16.0a, area_2.5mm2."""
    t = F.lower(T.text(c))
    x, y = _all(t, SIZE, 1), _all(t, SIZE, 2)
    sizes = F.zip_with(x, y, lambda a, b: F.concat(F.lit("cable_"), _value(a), F.lit("x"), _value(b)))
    found = [sizes]
    for before, after, pattern in NUMERIC_KEYS:
        number = (lambda v: v.cast("bigint").cast("string")) if before == "circuit_c" else _value
        found.append(F.transform(_all(t, pattern, 1), _framed(before, number, after)))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def key_type(key: Column) -> Column:
    return F.substring_index(key, "_", 1)


def numeric_compatible(x: Column, y: Column) -> Column:
    """True if either set is empty, the sets are equal, or no two keys of one type differ."""
    differ = F.exists(x, lambda a: F.exists(y, lambda b: (key_type(a) == key_type(b)) & (a != b)))
    return (F.size(x) == 0) | (F.size(y) == 0) | (x == y) | ~differ
