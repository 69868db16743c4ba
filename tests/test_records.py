"""Record scores: every material with every item of its category; texts measured once for each pair of distinct ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kindred import queries
from kindred.functions import metrics, scores


@pytest.mark.parametrize("name", ["backup_score", "priority_score"])
def test_names_with_different_nouns_are_scored(spark, sf_dir, name):
    want = duckdb.sql(f"WITH part AS (SELECT * FROM '{sf_dir}/part.parquet'), {queries.PL_SQL}, {queries.MAT_SQL} SELECT count(*) FROM mat JOIN pl ON mat.category = pl.category").fetchall()[0][0]
    assert queries.QUERIES[name](spark, sf_dir).count() == want


def test_grid_equals_pairs():
    left = ["", "a", "abcabba", "x" * 64, "y" * 65 + "z", "кабель 3x2.5"]
    right = ["cbabac", "", "x" * 70, "zy" * 40, "кабель 3x2,5", "b"]
    every = [(a, b) for a in left for b in right]
    assert metrics.lcs_grid(left, right).ravel().tolist() == metrics.lcs_lengths([a for a, _ in every], [b for _, b in every]).tolist()


def test_six_metrics_equal_each_metric(spark):
    texts = ["", "red bolt", "bolt red 3x2.5", "для led и bolt", "(b) -a", "red red bolt", "кабель 3x2.5 red", "x" * 70]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    each = 0.15 * metrics.ratio(a, b) + 0.15 * metrics.partial_ratio(a, b) + 0.25 * metrics.token_sort_ratio(a, b) + 0.25 * metrics.token_set_ratio(a, b) + 5.0 * metrics.sequence_ratio(a, b) + 15.0 * metrics.semantic_similarity(a, b)
    assert rows.select(each.alias("x"), metrics.six_of(a, b).alias("y")).filter("x IS DISTINCT FROM y").count() == 0


def test_equal_values_of_specifications_are_measured_once(spark):
    seen = []

    def words(rows):
        seen.append(rows.count())
        return rows.withColumn("words", F.lit(7.0))

    rows = spark.range(60).select("id", F.create_map(F.lit("v"), F.concat(F.lit("a"), F.col("id") % 3)).alias("a"), F.create_map(F.lit("v"), F.lit("b")).alias("b"))
    got = scores.specs_scores(rows, "id", "a", "b", words).collect()
    assert seen == [3] and len(got) == 60 and {r["specs"] for r in got} == {7.0}
