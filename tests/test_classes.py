"""The keyword rule over classes of items of equal name and brand."""

import pytest
from pyspark.sql import functions as F

from kindred import queries
from kindred.operators import candidates, classes, matching


def _items(spark, n):
    k = F.col("id")
    return spark.range(n).select(k.cast("string").alias("id"), F.concat(F.lit("blue bolt "), k % 3).alias("name"), F.concat(F.lit("b"), k % 2).alias("brand"), F.concat(F.lit("a-"), k).alias("article"), F.lit("").alias("description"))


def test_lists_hold_classes_not_items(spark, monkeypatch):
    """A word of names has an entry for each class; with an entry for each item a list grew with the copies."""
    seen = []
    inner = classes.meet
    monkeypatch.setattr(classes, "meet", lambda rows, *rest: seen.append(rows.groupBy("kind").count().collect()) or inner(rows, *rest))
    q = spark.createDataFrame([("x", "blue bolt a-7"), ("y", "blue bolt a-7"), ("z", "blue")], "material_id string, query string")
    got = candidates.keyword_topk(q, _items(spark, 600), 4).orderBy("material_id", "rank").collect()
    kinds = {r["kind"]: r["count"] for r in seen[0]}
    assert kinds[classes.ITEM] == 600 and kinds[classes.CLASS] == 12 and kinds[classes.ARTICLE] == 11
    assert [r["price_id"] for r in got] == ["7", "70", "71", "72", "7", "70", "71", "72", "0", "1", "10", "100"]


@pytest.mark.parametrize("name", ["export_selected", "format_statistics", "selected_semi_join"])
def test_matches_are_made_once(spark, sf_dir, monkeypatch, name):
    made = []
    inner = matching.keyword_match
    monkeypatch.setattr(matching, "keyword_match", lambda *a: made.append(inner(*a)) or made[-1])
    out = queries.QUERIES[name](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "CartesianProduct" not in plan and "ArrowEvalPython" not in plan
