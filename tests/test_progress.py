"""Progress: counts equal the tables', tasks only grow, errors come through, streams report each batch."""

import time

import pytest
from pyspark.sql import functions as F

from kindred.plans.progress import StreamProgress, watched, with_progress


def test_counts_without_another_pass(spark):
    df, seen = watched(spark.range(1000), "all", large=F.sum((F.col("id") >= 900).cast("int")))
    out, kept = watched(df.filter("id % 3 = 0"), "kept")
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 1000, "large": 100} and kept.get == {"rows": 334}


def test_tasks_are_told_while_the_action_runs(spark):
    told = []
    df = spark.range(0, 4000, 1, 8).groupBy((F.col("id") % 7).alias("k")).count()
    assert with_progress(spark, df.count, lambda *now: told.append(now), 0.05) == 7
    assert told and all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(told, told[1:])) and told[-1][0] <= told[-1][1] and told[-1][0] >= 8
    assert with_progress(spark, lambda: 5, print) == 5


def test_errors(spark):
    with pytest.raises(ZeroDivisionError):
        with_progress(spark, lambda: 1 // 0, print)

    def stop(done, known):
        raise RuntimeError("stop")

    slow = spark.range(0, 64, 1, 64).select(F.expr("java_method('java.lang.Thread', 'sleep', 1000L)"))
    before = time.time()
    with pytest.raises(RuntimeError, match="stop"):
        with_progress(spark, lambda: slow.write.format("noop").mode("overwrite").save(), stop, 0.1)
    assert time.time() - before < 12  # of 16 s and more


def test_batches_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    told = []
    listener = StreamProgress(lambda *batch: told.append(batch))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        seen = stream.observe("seen", F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total"))
        seen.writeStream.queryName("watched").format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
        until = time.time() + 10
        while len([t for t in told if t[2]]) < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    batches = [t for t in told if t[2]]
    assert [t[:3] for t in batches] == [("watched", k, 10) for k in range(3)]
    assert sum(t[3]["seen"]["rows"] for t in batches) == 30 and sum(t[3]["seen"]["total"] for t in batches) == sum(range(30))
