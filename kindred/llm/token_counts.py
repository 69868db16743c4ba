"""Delta-maintained token-count rollups.

A change feed of signed rows (+ for an insert, - for a delete, the pair -old +new for a revised count)
is added up by source, language and tokenizer version. Each batch is pre-aggregated (map-side, so a hot
source costs one row a task) and committed as one folder whose _SUCCESS file is the commit: a batch
that is applied again, after a retry or by mistake, changes nothing. Totals are sums over batches, so
they never need the documents again. Compaction folds batches into a base that keeps their ids.

Defined results: null text counts 0 tokens; null source or language is a group of its own; repeated
rows count each; groups whose documents all went are left out of ``totals``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import slices, worker_state
from .packing import WordTokenizer

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"


@dataclass(frozen=True)
class word_counter:  # noqa: N801  a function with a value to compare
    """Tokens of each text by a tokenizer file of the tokenizers library."""

    path: str

    def __call__(self) -> Callable[[pa.Array], np.ndarray]:
        return WordTokenizer(self.path).count


@dataclass(frozen=True)
class byte_counter:  # noqa: N801
    """Tokens of each text by a file of byte-pair ranks."""

    path: str
    pattern: str

    def __call__(self) -> Callable[[pa.Array], np.ndarray]:
        return Encoder(self.path, self.pattern).count


def counted(docs: DataFrame, counters: dict[str, Callable], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``tokens``, a map from tokenizer version to the text's tokens.
    ``counters``: version to what makes a counter in a worker; a worker keeps counters by what makes them (file and
    pattern), not by the version's name."""
    at, names = docs.columns.index(text_col), list(counters)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_state(("counters", *counters.items()), lambda: [make() for make in counters.values()])
        for batch in batches:
            for part in slices(batch, 4 << 20, 10_000):
                n = np.stack([count(part.column(at)) for count in made], 1)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(names))
                maps = pa.MapArray.from_arrays(ends, pa.array(names * part.num_rows, pa.string()), pa.array(n.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(batch.schema.names.index(c)) for c in rest] + [maps], names=[*rest, "tokens"])

    kept = docs.select(*rest, F.lit(None).cast("map<string,long>").alias("tokens")).schema
    return docs.mapInArrow(run, kept)


def signed(docs: DataFrame, version: str, tokens: Column, sign: int, docs_sign: int | None = None) -> DataFrame:
    """Delta rows of ``docs``: ``sign`` times their tokens, ``docs_sign`` (``sign`` if None) documents each."""
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer_version"),
        F.lit(sign if docs_sign is None else docs_sign).cast("long").alias("docs"),
        (tokens * sign).cast("long").alias("tokens"),
    )


def inserted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    return signed(docs, version, tokens, 1)


def deleted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    return signed(docs, version, tokens, -1)


def revised(docs: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """One row a document that carries new - old: the documents stay, their tokens change."""
    return signed(docs, version, F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)), 1, 0)


class Rollup:
    """Additive totals in ``path``: one folder a committed batch, and bases into which batches were folded. A base
    names its batches in ``_batches``; it comes into being by one rename, and what it replaced stays for one
    more compaction, so readers and a crash in between see either the old folders or the new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs, self.root = root.getFileSystem(spark._jsc.hadoopConfiguration()), root

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _folders(self, kind: str) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return sorted(n for n in names if n.startswith(kind) and self.fs.exists(self._path(f"{n}/_SUCCESS")))

    def _folded(self, base: str) -> list[str]:
        file = self.fs.open(self._path(f"{base}/_batches"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _state(self) -> tuple[list[str], list[str], list[str]]:
        """(folders that count, committed batches, folders that a base replaced)."""
        bases, batches = self._folders("base="), self._folders("batch=")
        folded = self._folded(bases[-1]) if bases else []
        live = [b for b in batches if b not in folded]
        return bases[-1:] + live, sorted(folded + live), bases[:-1] + [b for b in batches if b in folded]

    def committed(self) -> list[str]:
        return self._state()[1]

    def apply(self, batch_id: str, *deltas: DataFrame) -> bool:
        """Commit a batch; False if that batch was committed before."""
        name = f"batch={batch_id}"
        if name in self.committed():
            return False
        rows = reduce(DataFrame.unionByName, deltas)
        rows = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        # overwrite: what a failed attempt left is not a commit
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def compact(self) -> None:
        """Fold all committed batches into a new base. What the base before replaced is deleted."""
        live, batches, replaced = self._state()
        bases = self._folders("base=")
        number = int(bases[-1].removeprefix("base=")) + 1 if bases else 1
        temporary = f"_base-{number}"
        self._sums(live, True).write.mode("overwrite").parquet(f"{self.path}/{temporary}")
        out = self.fs.create(self._path(f"{temporary}/_batches"), True)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        self.fs.rename(self._path(temporary), self._path(f"base={number:010d}"))
        for name in replaced:
            self.fs.delete(self._path(name), True)

    def _sums(self, folders: list[str], keep_empty: bool) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in folders]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out if keep_empty else out.filter((F.col("docs") != 0) | (F.col("tokens") != 0))

    def totals(self) -> DataFrame:
        return self._sums(self._state()[0], False)
