"""The log of selections: which variant of each material is chosen, from events that may come late or twice.

Events: material_id, variant_id, action ("select" or "reset"; a reset without a material clears all), ts, event_id.
The latest event of a material by (ts, event_id) decides, so the order of arrival doesn't matter, and an event that
comes twice changes nothing. The fold is one aggregate: the same code runs over a table and over a stream, where
Spark keeps one row a material as its state. A null or unknown action, or a selection without a variant, is no event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def valid(events: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """The events that count; with ``variants`` (material_id, variant_id) only selections of variants that exist."""
    out = events.filter("action = 'reset' OR (action = 'select' AND material_id IS NOT NULL AND variant_id IS NOT NULL)")
    if variants is None:
        return out
    known = variants.select("material_id", "variant_id").distinct().withColumn("known", F.lit(True))
    return out.join(known, ["material_id", "variant_id"], "left").filter("action = 'reset' OR known").select(events.columns)


def latest(events: DataFrame) -> DataFrame:
    """material_id (null for all), ts, event_id, variant_id (null after a reset) of each material's latest event."""
    turn = F.struct("ts", "event_id")
    chosen = F.struct("ts", "event_id", F.when(F.col("action") == "select", F.col("variant_id")).alias("variant_id"))
    return events.groupBy("material_id").agg(F.max_by(chosen, turn).alias("e")).select("material_id", "e.*")


def state(last: DataFrame) -> DataFrame:
    """material_id, variant_id, selected_at of the materials that are selected, from what ``latest`` gives: selections
    before the latest reset of all are gone."""
    # one row
    cleared = last.filter("material_id IS NULL").agg(F.max(F.struct("ts", "event_id")).alias("cleared"))
    out = last.filter("material_id IS NOT NULL AND variant_id IS NOT NULL").join(F.broadcast(cleared), how="cross")
    kept = out.filter(F.col("cleared").isNull() | (F.struct("ts", "event_id") > F.col("cleared")))
    return kept.select("material_id", "variant_id", F.col("ts").alias("selected_at"))


def selections(events: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    return state(latest(valid(events, variants)))


def selection_stream(events: DataFrame, path: str, checkpoint: str, variants: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps ``path``/batch=N, the materials whose latest event changed in each micro-batch; ``read_state`` sums them up. A
    batch that is run again writes its own folder again."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = latest(valid(events, variants)).writeStream.outputMode("update").foreachBatch(one)
    return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_state(changes: DataFrame) -> DataFrame:
    """The selections from the stream's folders: a material's last change counts."""
    newest = changes.groupBy("material_id").agg(F.max_by(F.struct("ts", "event_id", "variant_id"), F.struct("ts", "event_id")).alias("e")).select("material_id", "e.*")
    return state(newest)
