"""Pair scorers as Column builders over the columns of a joined (material, price item) row.

Texts are normalized once a row before the join (``operators.matching.prepare_*``); the functions here
take the prepared columns. All scores are percentages from 0 to 100 unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored
from . import extract, metrics
from . import text as T


def _has(c: Column) -> Column:
    return T.text(c) != ""


def _contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


# Live scorer --------------------------------------------------------------------------------------


def fast_text(a: Column, b: Column, a_sorted: Column, b_sorted: Column) -> Column:
    """0.6 ratio + 0.4 token-sort ratio of two normalized texts."""
    mixed = 0.6 * metrics.ratio(a, b) + 0.4 * metrics.ratio(a_sorted, b_sorted)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 100.0).otherwise(mixed)


def fast_code(a: Column, b: Column) -> Column:
    x, y = (F.replace(F.upper(T.text(c)), F.lit(" "), F.lit("")) for c in (a, b))
    return F.when(~_has(a) | ~_has(b), 0.0).when(x == y, 100.0).when(_contains(x, y), 85.0).otherwise(metrics.ratio(x, y).cast("double"))


def fast_brand(a: Column, b: Column) -> Column:
    x, y = (F.trim(F.lower(T.text(c))) for c in (a, b))
    return F.when(~_has(a) | ~_has(b), 0.0).when(x == y, 100.0).when(_contains(x, y), 75.0).otherwise(metrics.ratio(x, y).cast("double"))


@dataclass(frozen=True)
class FastWeights:
    """(name, description, article, brand) by what is there to compare."""

    article: tuple = (0.20, 0.10, 0.45, 0.25)
    name_description_brand: tuple = (0.35, 0.15, 0.25, 0.25)
    name_description: tuple = (0.60, 0.40, 0.0, 0.0)
    name_brand: tuple = (0.70, 0.0, 0.0, 0.30)
    description_brand: tuple = (0.0, 0.70, 0.0, 0.30)
    name: tuple = (1.0, 0.0, 0.0, 0.0)
    description: tuple = (0.0, 1.0, 0.0, 0.0)
    brand: tuple = (0.0, 0.0, 0.0, 1.0)
    nothing: tuple = (0.34, 0.33, 0.0, 0.33)


def fast_weights(n: Column, d: Column, b: Column, article: Column, w: FastWeights = FastWeights()) -> Column:
    """array<double> of the four weights; they are not renormalized."""
    lit = lambda x: F.array(*map(F.lit, x))
    return (
        F.when(article, lit(w.article))
        .when(n & d & b, lit(w.name_description_brand))
        .when(n & d, lit(w.name_description))
        .when(n & b, lit(w.name_brand))
        .when(d & b, lit(w.description_brand))
        .when(n, lit(w.name))
        .when(d, lit(w.description))
        .when(b, lit(w.brand))
        .otherwise(lit(w.nothing))
    )


# The weights of name, code and brand, and who gets how much of a missing one's weight.
THREE_FIELDS = {"name": 0.30, "code": 0.40, "brand": 0.30}
MISSING_SHARES = {"name": {"code": 0.6, "brand": 0.4}, "code": {"name": 0.7, "brand": 0.3}, "brand": {"name": 0.7, "code": 0.3}}


def three_field_weights(n: Column, c: Column, b: Column) -> Column:
    """(name, code, brand) weights of the three-field variant: a missing field's weight is shared out to the others,
    a field alone has all of it, and without any field all are 0."""
    there = dict(zip(THREE_FIELDS, (n, c, b)))
    count = sum((x.cast("int") for x in there.values()), F.lit(0))

    def weight(f: str) -> Column:
        gained = sum((F.when(there[g], 0.0).otherwise(THREE_FIELDS[g] * MISSING_SHARES[g][f]) for g in there if g != f), F.lit(THREE_FIELDS[f]))
        return F.when(~there[f], 0.0).when(count == 1, 1.0).otherwise(gained)

    return F.array(*map(weight, there))


def text_sides(m: Callable[[str], Column], p: Callable[[str], Column]) -> dict[str, tuple[Column, Column, Column, Column]]:
    """The prepared (a, b, sorted a, sorted b) columns that the live scorer compares."""
    return {"name": (m("norm"), p("norm"), m("sorted"), p("sorted")), "description": (m("text_norm"), p("description_norm"), m("text_sorted"), p("description_sorted"))}


def identical(m, p) -> Column:
    return (m("norm") == p("norm")) & (m("norm") != "")


def same_model(m, p) -> Column:
    return F.arrays_overlap(m("models"), p("models"))


def fast_article(m, p, code: Column) -> Column:
    """The code's similarity, at least 90 if a model of the material stands in the article."""
    inside = F.exists(m("models"), lambda x: F.contains(F.upper(p("article")), F.upper(x)))
    raised = F.when(inside, F.greatest(code, F.lit(90.0))).otherwise(code)
    return F.when(_has(p("article")), raised).otherwise(0.0)


def fast_total(name: Column, description: Column, article: Column, brand: Column, m, p) -> Column:
    w = fast_weights((m("norm") != "") & (p("norm") != ""), (m("text_norm") != "") & (p("description_norm") != ""), _has(m("brand")) & _has(p("brand")), article > 0)
    return name * w[0] + description * w[1] + article * w[2] + brand * w[3]


# Older scorers ------------------------------------------------------------------------------------


def code_similarity(a: Column, b: Column) -> Column:
    """All white space is dropped, equal 100, containing 85, else the ratio."""
    x, y = (F.regexp_replace(F.upper(T.text(c)), r"\s+", "") for c in (a, b))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 100.0).when(_contains(x, y), 85.0).otherwise(metrics.ratio(x, y).cast("double"))


def brand_similarity(a: Column, b: Column) -> Column:
    """The ratio, at least 75 if one contains the other."""
    x, y = (F.trim(F.lower(T.text(c))) for c in (a, b))
    r = metrics.ratio(x, y).cast("double")
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 100.0).when(_contains(x, y), F.greatest(r, F.lit(75.0))).otherwise(r)


def legacy_text(a: Column, b: Column, compatible: Column, a_words: tuple[Column, Column] | None = None, b_words: tuple[Column, Column] | None = None) -> Column:
    """Six metrics over normalized texts; incompatible numbers cost 30 %, and cap at 70. ``..._words``:
    ``metrics.compared_words`` of the texts where they were made before the pairs."""
    total = F.least(metrics.six_of(a, b, a_words, b_words), F.lit(100.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, F.when(compatible, 100.0).otherwise(70.0)).when(compatible, total).otherwise(F.least(0.7 * total, F.lit(70.0)))


def category_similarity(a: Column, b: Column, fallback: Column) -> Column:
    x, y = F.trim(F.lower(T.text(a))), F.trim(F.lower(T.text(b)))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 100.0).when(_contains(x, y), 85.0).otherwise(fallback)


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def spec_value(x: Column, y: Column, steps: tuple, top: float, words: Column) -> Column:
    """Of two values in lower case: equal, numbers by their difference, else ``words``."""
    u, v = _number(x), _number(y)
    most = F.greatest(u, v)
    d = F.when(most > 0, F.abs(u - v) / most).otherwise(0.0)
    out = F.when(x == y, top)
    for limit, value in steps:
        out = out.when(d <= limit, value)
    return F.when(x == y, top).when(u.isNull() | v.isNull(), words).otherwise(out.otherwise(F.greatest(F.lit(0.0), top * (1 - d))))


SPEC_STEPS = ((0.1, 90.0), (0.2, 70.0))


#: Keys of a list, about.
LISTED = 1024


def specs_scores(rows: DataFrame, key: str, a: str, b: str, text_score: Callable[[DataFrame], DataFrame], steps: tuple = SPEC_STEPS, top: float = 100.0) -> DataFrame:
    """key, specs: ``specs_similarity`` of the map columns a and b, the common keys as rows; ``text_score`` adds a
    column ``words`` to rows with two values x and y, by whatever metric, and runs once for each pair of distinct values."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    each = rows.select(key, F.explode(common).alias("k"), a, b).select(key, F.trim(F.lower(F.col(a)[F.col("k")])).alias("x"), F.trim(F.lower(F.col(b)[F.col("k")])).alias("y"))
    # bounded lists of the keys that have a pair of values
    part = F.pmod(F.xxhash64(key), F.ceil(F.count("*").over(Window.partitionBy("x", "y")) / LISTED))
    pairs = each.withColumn("part", part).groupBy("x", "y", "part").agg(F.collect_list(key).alias("keys")).select("x", "y", "keys")
    values = text_score(pairs).select("keys", spec_value(F.col("x"), F.col("y"), steps, top, F.col("words")).alias("v"))
    mean = values.select(F.explode("keys").alias(key), "v").groupBy(key).agg(F.avg("v").alias("specs"))
    return rows.select(key).join(mean, key, "left").withColumn("specs", F.coalesce("specs", F.lit(0.0)))


def legacy_words(rows: DataFrame) -> DataFrame:
    """The older text score of the values x and y, which are expected in NFC. The normal forms are written, as the rules
    after them name them many times."""
    compatible = extract.numeric_compatible(extract.numeric_keys(F.col("x")), extract.numeric_keys(F.col("y")))
    normal = stored(rows.withColumns({"nx": T.legacy_normalize(F.col("x")), "ny": T.legacy_normalize(F.col("y")), "ok": compatible}), "normal")
    return normal.withColumn("words", legacy_text(F.col("nx"), F.col("ny"), F.col("ok")))


def specs_similarity(a: Column, b: Column, steps: tuple = SPEC_STEPS, top: float = 100.0, text_score: Callable[[Column, Column], Column] | None = None) -> Column:
    """Mean over the common keys of two map<string,string> columns; 0 without common keys. Values that are
    not both numbers get ``text_score`` (0 without one; for one that runs Python, see ``specs_scores``)."""

    def one(k: Column) -> Column:
        x, y = F.trim(F.lower(a[k])), F.trim(F.lower(b[k]))
        return spec_value(x, y, steps, top, F.lit(0.0) if text_score is None else text_score(x, y))

    common = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    total = F.aggregate(F.transform(common, one), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(total, F.size(common)), F.lit(0.0))


@dataclass(frozen=True)
class FieldWeights:
    name: float = 0.40
    description: float = 0.20
    category: float = 0.15
    brand: float = 0.15
    specifications: float = 0.10


def legacy_total(name: Column, description: Column, category: Column, brand: Column, specs: Column, has_description: Column, has_category: Column, has_brand: Column, has_specs: Column, compatible: Column, same: Column, w: FieldWeights = FieldWeights()) -> Column:
    """Weighted mean that skips brand and specifications when blank on both sides, with two shortcuts:
    equal and compatible names 100; name, description and category all close 95."""
    wb, ws = F.when(has_brand, w.brand).otherwise(0.0), F.when(has_specs, w.specifications).otherwise(0.0)
    total = (w.name * name + w.description * description + w.category * category + wb * brand + ws * specs) / (w.name + w.description + w.category + wb + ws)
    near = (name >= 90) & ((description >= 75) | ~has_description) & ((category >= 85) | ~has_category) & compatible
    return F.when(same & compatible & (name >= 90), 100.0).when(near, 95.0).when(compatible, total).otherwise(0.6 * total)


def priority_total(name: Column, code: Column, brand: Column, has_article: Column, has_brand: Column, compatible: Column) -> Column:
    total = F.when(~has_article & ~has_brand, name).when(~has_article, 0.7 * name + 0.3 * brand).when(~has_brand, 0.6 * name + 0.4 * code).otherwise(0.5 * name + 0.3 * code + 0.2 * brand)
    return F.when(~compatible & (total > 50), F.least(0.7 * total, F.lit(70.0))).otherwise(total)


# Multi-algorithm scorer (0 to 1) --------------------------------------------------------------------

ALGORITHMS: dict[str, tuple[float, Callable[[Column, Column], Column]]] = {
    "ratio": (0.25, lambda a, b: metrics.ratio(a, b) / 100.0),
    "token_sort": (0.25, lambda a, b: metrics.token_sort_ratio(a, b) / 100.0),
    "token_set": (0.20, lambda a, b: metrics.token_set_ratio(a, b) / 100.0),
    "sequence": (0.15, lambda a, b: metrics.sequence_ratio(a, b)),
    "semantic": (0.15, lambda a, b: metrics.stepped_jaccard(T.semantic_tokens(a, T.STOP_MULTI), T.semantic_tokens(b, T.STOP_MULTI))),
    "jaccard": (0.15, metrics.token_jaccard),
    "levenshtein": (0.15, lambda a, b: 1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))),
}


def multi_text(a: Column, b: Column, algorithms: tuple[str, ...] = ("ratio", "token_sort", "semantic")) -> Column:
    """Weighted mean of the chosen algorithms over normalized texts."""
    total = sum(ALGORITHMS[x][0] for x in algorithms)
    mixed = sum((ALGORITHMS[x][1](a, b) * (ALGORITHMS[x][0] / total) for x in algorithms), F.lit(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def multi_brand(a: Column, b: Column, score: Column) -> Column:
    return F.when(~_has(a) & ~_has(b), 0.8).when(~_has(a) | ~_has(b), 0.7).otherwise(score)


MULTI_STEPS = ((0.05, 0.95), (0.1, 0.8), (0.2, 0.6))


def multi_words(rows: DataFrame) -> DataFrame:
    """The multi-algorithm text score of the values x and y."""
    normal = rows.withColumns({"nx": T.multi_normalize(F.col("x")), "ny": T.multi_normalize(F.col("y"))})
    return normal.withColumn("words", multi_text(F.col("nx"), F.col("ny")))


def multi_specs(a: Column, b: Column, common: Column | None = None) -> Column:
    """``common``: the score over common keys, from ``specs_scores`` if texts are to be compared."""
    none_a, none_b = F.size(F.map_keys(a)) == 0, F.size(F.map_keys(b)) == 0
    return F.when(none_a & none_b, 0.8).when(none_a | none_b, 0.6).otherwise(specs_similarity(a, b, MULTI_STEPS, 1.0) if common is None else common)


def multi_numeric_keys(c: Column) -> Column:
    """Ranges and sizes of a raw text."""
    span = r"(\d+(?:[.,]\d+)?)\s*[-–—]\s*(\d+(?:[.,]\d+)?)\s*[а-яА-Яa-zA-Z]*"
    both = lambda p, name, sep: F.zip_with(F.regexp_extract_all(T.text(c), F.lit(p), F.lit(1)), F.regexp_extract_all(T.text(c), F.lit(p), F.lit(2)), lambda x, y: F.concat(F.lit(name), x, F.lit(sep), y))
    return F.array_distinct(F.concat(both(span, "range_", "_"), both(extract.SIZE, "size_", "x")))


def multi_features(c: Column) -> Column:
    """A text's features: content words of its normal form, ranges and sizes."""
    tokens = F.array_distinct(T.semantic_tokens(T.multi_normalize(c), T.STOP_MULTI))
    return F.concat(F.transform(tokens, lambda t: F.concat(F.lit("token_"), t)), multi_numeric_keys(c))


def multi_numeric_compatible(a: Column, b: Column) -> Column:
    """Ranges and sizes of the raw texts intersect, or one side has none."""
    x, y = multi_numeric_keys(a), multi_numeric_keys(b)
    return F.arrays_overlap(x, y) | (F.size(x) == 0) | (F.size(y) == 0)


def multi_total(name: Column, description: Column, category: Column, brand: Column, specs: Column, compatible: Column, w: FieldWeights = FieldWeights()) -> Column:
    raised = F.when(brand < 0.8, F.greatest(brand, F.lit(0.7))).otherwise(brand)
    total = (name * w.name + description * w.description + category * w.category + raised * w.brand + specs * w.specifications) / (w.name + w.description + w.category + w.brand + w.specifications)
    total = F.when(~compatible & (total > 0.5), total * 0.7).otherwise(total)
    return 100 * F.when((name >= 0.95) & (description >= 0.8) & compatible, 1.0).otherwise(F.least(total, F.lit(1.0)))


def backup_total(name: Column, code: Column, brand: Column, has_article: Column, has_brand: Column) -> Column:
    """Name, code and brand by the oldest weights; what is not on both sides leaves its weight to the name."""
    wa, wb = F.when(has_article, 0.2).otherwise(0.0), F.when(has_brand, 0.1).otherwise(0.0)
    return name * (1 - wa - wb) + code * wa + brand * wb


def backup_fields_total(name: Column, description: Column, category: Column, brand: Column, specs: Column, brand_sides: Column, specs_sides: Column, compatible: Column, w: FieldWeights = FieldWeights()) -> Column:
    """Percentage from similarities of 0 to 1. A brand, or specifications, on one side only (``..._sides`` is the
    number of sides that have one) count 0.8, on none they are left out."""
    wb, ws = F.when(brand_sides > 0, w.brand).otherwise(0.0), F.when(specs_sides > 0, w.specifications).otherwise(0.0)
    b, s = F.when(brand_sides == 1, 0.8).otherwise(brand), F.when(specs_sides == 1, 0.8).otherwise(specs)
    total = (w.name * name + w.description * description + w.category * category + wb * b + ws * s) / (w.name + w.description + w.category + wb + ws)
    return 100 * F.when(compatible, total).otherwise(0.6 * total)
