"""Incremental matching: materials arrive as a stream and are matched batch by batch. An addition; the
matched semantics are those of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import MatchConfig, keyword_match


def match_stream(materials: DataFrame, items: DataFrame, path: str, checkpoint: str, cfg: MatchConfig = MatchConfig(), trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch's matches to ``path``/batch=N. A batch that is run again after a failure
    overwrites its own folder, so every material's matches are written once."""

    def one(batch: DataFrame, batch_id: int) -> None:
        keyword_match(batch, items, cfg).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return materials.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
