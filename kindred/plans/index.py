"""The price list as stored tables: create, upsert, delete, look up, statistics."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.reports import last_wins
from ..sources.files import with_position


class TableIndex:
    """A table of items with derived search columns, keyed by id, kept as Parquet in the warehouse."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.last: dict[str, float] = {}
        if not self.exists() and spark.catalog.tableExists(f"{name}_before"):  # an upsert ended between its renames
            self._rename(f"{name}_before", name)

    def _rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER TABLE {old} RENAME TO {new}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, items: DataFrame, replace: bool = False) -> bool:
        """False if the table is there and ``replace`` is not set."""
        if self.exists() and not replace:
            return False
        self._derived(items).write.mode("overwrite").saveAsTable(self.name)
        return True

    def _derived(self, items: DataFrame) -> DataFrame:
        everything = F.concat_ws(" ", *[T.text(F.col(c)) for c in ("name", "brand", "article", "description") if c in items.columns])
        return items.withColumns({"name_normalized": T.base_normalize(F.col("name")), "search_text": T.base_normalize(everything)})

    def upsert(self, items: DataFrame) -> dict[str, int]:
        """Rows by id, the last of the batch wins, then the batch over the table. The new table is written whole
        before the old one gives up its name, and the old one goes last. Returns counts and rows a second."""
        began = time.perf_counter()
        batch = last_wins(with_position(items, "row_ord"), "id", ["row_ord"]).drop("position")
        bad = items.filter(F.col("id").isNull() | (T.text(F.col("name")) == "")).count()
        batch = self._derived(batch.filter(F.col("id").isNotNull() & (T.text(F.col("name")) != "")))
        if self.exists():
            old = self.spark.table(self.name)
            merged = old.join(batch.select("id"), "id", "left_anti").unionByName(batch, allowMissingColumns=True)
            merged.write.mode("overwrite").saveAsTable(f"{self.name}_next")
            self._drop(f"{self.name}_before")
            self._rename(self.name, f"{self.name}_before")
            self._rename(f"{self.name}_next", self.name)
            self._drop(f"{self.name}_before")
        else:
            batch.write.saveAsTable(self.name)
        indexed, seconds = items.count() - bad, time.perf_counter() - began
        self.last = {"indexed": indexed, "errors": bad, "seconds": round(seconds, 3), "rows_a_second": round(indexed / seconds, 1)}
        return {"indexed": indexed, "errors": bad}

    def delete(self) -> None:
        self._drop(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def get(self, id_: str) -> DataFrame:
        return self.table().filter(F.col("id") == id_)

    def first(self, n: int = 1000) -> DataFrame:
        return self.table().limit(n)

    def stats(self) -> dict[str, int]:
        return {"documents": self.table().count() if self.exists() else 0}

    def export_stats(self, path: str) -> None:
        """The rows and the figures of this object's last upsert as one JSON file, through Spark's file systems."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(json.dumps(self.stats() | self.last).encode()))
        out.close()

    def warm_up(self) -> None:
        self.spark.catalog.cacheTable(self.name)
