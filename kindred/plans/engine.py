"""The engine behind one object: load, index, match, search, report, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, matching, reports
from ..sources import files, sinks
from .progress import with_progress

R = TypeVar("R")


@dataclass(frozen=True)
class EngineConfig:
    match: matching.MatchConfig = field(default_factory=matching.MatchConfig)
    strategy: str = "keyword"
    max_formatted: int = 7

    @classmethod
    def merged(cls, given: dict) -> EngineConfig:
        """Defaults, replaced by what ``given`` names, two levels deep; unknown names raise TypeError."""

        def over(base, values: dict):
            known = {f.name: getattr(base, f.name) for f in fields(base)}
            return replace(base, **{k: over(known[k], v) if isinstance(v, dict) and is_dataclass(known.get(k)) else v for k, v in values.items()})

        return over(cls(), given)


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()):
        self.spark, self.config = spark, config

    def load_materials(self, path: str, file_format: str = "auto") -> DataFrame:
        return files.load(self.spark, path, "materials", file_format)

    def load_price_list(self, path: str, file_format: str = "auto") -> DataFrame:
        return files.load(self.spark, path, "pricelist", file_format)

    def match(self, materials: DataFrame, items: DataFrame, strategy: str | None = None) -> DataFrame:
        """By ``keyword`` or ``search`` candidates, ``block`` for all pairs that share a word, or a
        registered strategy."""
        own = {"keyword": matching.keyword_match, "search": matching.search_match, "block": matching.block_match}
        run = own.get(strategy or self.config.strategy) or matching.STRATEGIES[strategy or self.config.strategy]
        return run(materials, items, self.config.match)

    def with_progress(self, action: Callable[[], R], told: Callable[[int, int], None]) -> R:
        """Run an action over matches, such as an export, and tell tasks done and tasks known as they change."""
        return with_progress(self.spark, action, told)

    def search_material(self, name: str, items: DataFrame, top_n: int = 10) -> DataFrame:
        """Matches of one name; twice as many candidates as results are scored."""
        one = self.spark.createDataFrame([("query", name)], "id string, name string")
        one = one.select("id", "name", *[F.lit(None).cast("string").alias(c) for c in ("description", "manufacturer", "equipment_code", "category")])
        return matching.search_match(one, items, replace(self.config.match, top_n=top_n, candidates=2 * top_n))

    def statistics(self, materials: DataFrame, matches: DataFrame) -> DataFrame:
        return reports.match_statistics(materials, matches)

    def formatted(self, materials: DataFrame, items: DataFrame, matches: DataFrame) -> DataFrame:
        return reports.nest(reports.format_rows(materials, items, matches, self.config.max_formatted))

    def export(self, materials: DataFrame, items: DataFrame, matches: DataFrame, path: str, file_format: str = "json") -> bool:
        rows = reports.xlsx_rows if file_format == "xlsx" else reports.csv_rows
        return sinks.export(rows(materials, items, matches), path, file_format)

    def candidates(self, materials: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
        queries = materials.select(F.col("id").alias("material_id"), candidates.live_query_text(F.col("name"), F.col("equipment_code"), F.col("manufacturer")).alias("query"))
        return candidates.search(items, queries, k)
