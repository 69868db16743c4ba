"""Exact matches counted by classes of equal rows."""

from pyspark.sql import functions as F

from kindred import queries
from kindred.operators import matching


def _rows(spark, n):
    k = F.col("id")
    name = F.concat(F.lit("bolt "), (k % 3).cast("string"), F.lit("x"), (k % 4).cast("string"), F.when(k % 5 == 0, " RS-485").otherwise(""))
    blank = F.when(k % 11 == 0, "").otherwise(name)
    return spark.range(n).select(k.cast("string").alias("id"), blank.alias("name"), F.lit(None).cast("string").alias("description"), F.lit("b").alias("brand"), F.lit("b").alias("manufacturer"), F.concat(F.lit("AB-"), (k % 6).cast("string")).alias("article"), F.lit("").alias("equipment_code"))


def test_counts_equal_the_pairs(spark):
    m, p = _rows(spark, 30), _rows(spark, 90)
    for shortcut in (True, False):
        cfg = matching.MatchConfig(model_shortcut=shortcut)
        want = matching.exact_strategy(m, p, cfg).filter("pct >= 95").groupBy("material_id").agg(F.count("*").alias("n"), F.max("pct").alias("best"))
        got = matching.exact_counts(m, p, cfg)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_no_pair_is_scored(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(matching, "score_pairs", lambda *_: (_ for _ in ()).throw(AssertionError("a row for each pair")))
    assert queries.exact_union_anti(spark, sf_dir).columns == ["material_id", "n", "best", "kind"]


def test_no_side_is_broadcast(spark, sf_dir):
    plan = queries.exact_union_anti(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    m, p = _rows(spark, 30), _rows(spark, 90)
    plan = matching.exact_counts(m, p)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
