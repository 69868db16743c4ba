"""The older scorers, SequenceMatcher's weight included, against plain Python."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from kindred import queries
from kindred.functions import extract, scores
from kindred.functions import text as T


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 100 if a == b else 0 if not a + b else round(200 * lcs(a, b) / (len(a) + len(b)))


def partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 100 if a == b else 0
    best = max(lcs(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)) / len(a)
    return 100 if best > 0.995 else round(100 * best)


def tokens(s):
    return re.sub(r"[^\w]", " ", re.sub("[\x80-\xff]", "", s)).lower().split()


def token_sort(a, b):
    return ratio(" ".join(sorted(tokens(a))), " ".join(sorted(tokens(b))))


def token_set(a, b):
    x, y = set(tokens(a)), set(tokens(b))
    if not x or not y:
        return 0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{both} {one}".strip(), f"{both} {two}".strip()
    return max(ratio(both, one), ratio(both, two), ratio(one, two))


STOP = {"для", "и", "с", "на", "в", "к", "от", "до", "по", "за", "при"}


def semantic(a, b):
    x, y = set(a.split()) - STOP, set(b.split()) - STOP
    if a == b:
        return 1.0
    if not x or not y:
        return 0.0
    j = len(x & y) / len(x | y)
    return 0.95 if j >= 0.8 else 0.85 if j >= 0.6 else j


def text_score(a, b, ok):
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0 if ok else 70.0
    mixed = 15 * ratio(a, b) + 15 * partial(a, b) + 25 * token_sort(a, b) + 25 * token_set(a, b) + 500 * difflib.SequenceMatcher(None, a, b).ratio() + 1500 * semantic(a, b)
    out = min(mixed / 100, 100.0)
    return out if ok else min(0.7 * out, 70.0)


WORDS = ["кабель", "ввг", "ввгнг", "3x1.5", "3x2.5", "для", "светодиодный", "лампа", "led", "10вт", "и", "автомат", "c16", "c25", "кабельный", "канал", "(a-b)", "силовой"]


def names(n=160, seed=4):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = " ".join(r.choices(WORDS, k=r.randint(0, 6)))
        b = a if r.random() < 0.1 else " ".join(r.choices(WORDS, k=r.randint(0, 6))) if r.random() < 0.5 else " ".join(w[: r.randint(1, len(w))] for w in a.split())
        out.append((a, b))
    return out


def test_text_score(spark):
    rows = [(k, a, b, k % 4 != 0) for k, (a, b) in enumerate(names())]
    df = spark.createDataFrame(rows, "id int, a string, b string, ok boolean")
    got = {r["id"]: r["s"] for r in df.select("id", scores.legacy_text(F.col("a"), F.col("b"), F.col("ok")).alias("s")).collect()}
    for k, a, b, ok in rows:
        assert got[k] == pytest.approx(text_score(a, b, ok), abs=1e-9), (a, b, ok)


def test_values_of_specifications(spark):
    """Equal values, numbers by their difference, other texts by the text score."""
    pairs = [({"u": "220", "v": "Кабель ВВГ", "n": "10"}, {"u": "230", "v": "кабель ВВГнг", "n": " 10 "}), ({"u": "1e2"}, {"u": "100.0"}), ({"u": "5"}, {"w": "5"}), ({}, {"u": "1"}), ({"u": "100"}, {"u": "15"}), ({"u": "-1"}, {"u": "-3"})]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "id int, a map<string,string>, b map<string,string>")
    got = {r["id"]: r["specs"] for r in scores.specs_scores(df, "id", "a", "b", scores.legacy_words).collect()}
    text = spark.createDataFrame([("кабель ввг", "кабель ввгнг")], "x string, y string").select(T.legacy_normalize(F.col("x")), T.legacy_normalize(F.col("y"))).first()
    assert got[0] == pytest.approx((90 + text_score(*text, True) + 100) / 3)
    # numbers that are equal, or of which none is positive, count as near
    assert got[1] == got[5] == 90.0 and got[2] == got[3] == 0.0 and got[4] == pytest.approx(15.0)


def has(v):
    return bool((v or "").strip())


def brand(a, b):
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    if not a or not b:
        return 0.0
    return 100.0 if a == b else max(ratio(a, b), 75.0) if a in b or b in a else float(ratio(a, b))


def code(a, b):
    a, b = (re.sub(r"\s", "", (x or "").upper()) for x in (a, b))
    if not a or not b:
        return 0.0
    return 100.0 if a == b else 85.0 if a in b or b in a else float(ratio(a, b))


def test_totals_of_records(spark):
    """Every combination of blank and missing fields."""
    r = random.Random(7)
    rows = []
    for k, (a, b) in enumerate(names(120, 9)):
        pick = lambda *v: r.choice([None, "", " ", *v, *v])
        rows.append((k, a, b, pick("IEK", "iek ооо"), pick("IEK", "ABB"), pick("AB-12", "ab 12"), pick("AB-12", "AB-12-3", "X"), pick("desc кабель"), pick("desc кабель", "лампа"), pick("Кабели"), pick("кабели", "Свет"), k % 3 != 0))
    df = spark.createDataFrame(rows, "id int, a string, b string, mb string, pb string, mc string, pa string, md string, pd string, mk string, pk string, ok boolean")
    col = F.col
    filled = lambda c: F.trim(T.text(col(c))) != ""
    df = df.withColumns({"name": scores.legacy_text(col("a"), col("b"), col("ok")), "description": scores.legacy_text(T.text(col("md")), T.text(col("pd")), F.lit(True)), "brand": scores.brand_similarity(col("mb"), col("pb")), "code": scores.code_similarity(col("mc"), col("pa"))})
    category = scores.category_similarity(col("mk"), col("pk"), F.lit(11.0))
    legacy = scores.legacy_total(col("name"), col("description"), category, col("brand"), F.lit(0.0), filled("md") & filled("pd"), filled("mk") & filled("pk"), filled("mb") | filled("pb"), F.lit(False), col("ok"), col("a") == col("b"))
    priority = scores.priority_total(col("name"), col("code"), col("brand"), filled("mc") & filled("pa"), filled("mb") & filled("pb"), col("ok"))
    three = scores.three_field_weights(filled("a"), filled("mc") & filled("pa"), filled("mb") & filled("pb"))
    got = {x["id"]: x for x in df.select("id", legacy.alias("legacy"), priority.alias("priority"), three.alias("w")).collect()}
    for k, a, b, mb, pb, mc, pa, md, pd, mk, pk, ok in rows:
        name, described, b_, c_ = text_score(a, b, ok), text_score(md or "", pd or "", True), brand(mb, pb), code(mc, pa)
        x, y = (mk or "").lower().strip(), (pk or "").lower().strip()
        kind = 0.0 if not x or not y else 100.0 if x == y else 85.0 if x in y or y in x else 11.0
        wb = 0.15 if has(mb) or has(pb) else 0.0
        mean = (0.4 * name + 0.2 * described + 0.15 * kind + wb * b_) / (0.75 + wb)
        close = name >= 90 and (described >= 75 or not (has(md) and has(pd))) and (kind >= 85 or not (has(mk) and has(pk))) and ok
        assert got[k]["legacy"] == pytest.approx(100.0 if a == b and ok and name >= 90 else 95.0 if close else mean if ok else 0.6 * mean), rows[k]
        article, branded = has(mc) and has(pa), has(mb) and has(pb)
        total = 0.5 * name + 0.3 * c_ + 0.2 * b_ if article and branded else 0.6 * name + 0.4 * c_ if article else 0.7 * name + 0.3 * b_ if branded else name
        assert got[k]["priority"] == pytest.approx(min(0.7 * total, 70.0) if not ok and total > 50 else total), rows[k]


@pytest.mark.parametrize(
    "there, weights",
    [((True, True, True), (0.3, 0.4, 0.3)), ((True, True, False), (0.51, 0.49, 0)), ((True, False, True), (0.58, 0, 0.42)), ((False, True, True), (0, 0.58, 0.42)), ((True, False, False), (1, 0, 0)), ((False, True, False), (0, 1, 0)), ((False, False, True), (0, 0, 1)), ((False, False, False), (0, 0, 0))],
)
def test_three_field_weights(spark, there, weights):
    assert spark.range(1).select(scores.three_field_weights(*map(F.lit, there))).first()[0] == pytest.approx(list(weights))


def test_queries_agree_with_plain_python(spark, sf_dir):
    pairs = {r["id"]: r for r in queries._legacy_names(spark, sf_dir).collect()}
    legacy = {r["id"]: r["name"] for r in queries.legacy_score(spark, sf_dir).collect()}
    priority = {r["id"]: r["total"] for r in queries.priority_score(spark, sf_dir).collect()}
    assert pairs and set(pairs) == set(legacy) == set(priority)
    for k, r in pairs.items():
        name = text_score(r["x"], r["y"], r["ok"])
        assert legacy[k] == pytest.approx(name, abs=1e-6)
        article, branded = has(r["mc"]) and has(r["pa"]), has(r["mb"]) and has(r["pb"])
        c_, b_ = code(r["mc"], r["pa"]), brand(r["mb"], r["pb"])
        total = 0.5 * name + 0.3 * c_ + 0.2 * b_ if article and branded else 0.6 * name + 0.4 * c_ if article else 0.7 * name + 0.3 * b_ if branded else name
        assert priority[k] == pytest.approx(min(0.7 * total, 70.0) if not r["ok"] and total > 50 else total, abs=1e-6)


def test_keys_decide_compatibility(spark):
    df = spark.createDataFrame([("кабель 3x1.5", "кабель 3x2.5"), ("кабель 3x1.5", "кабель")], "a string, b string")
    assert [r[0] for r in df.select(extract.numeric_compatible(extract.numeric_keys(F.col("a")), extract.numeric_keys(F.col("b")))).collect()] == [False, True]
