"""Shared helpers: table access, the shared scratch folder, hold-out folds, text batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters with the marks that belong to them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def letter_runs(chunk: str) -> list[str]:
    """The matches of LETTERS; most chunks are one run with or without signs around it."""
    if chunk.isalpha():
        return [chunk]
    bare = chunk.strip(_SIGNS)
    return [bare] if bare.isalpha() else LETTERS.findall(bare)


_OWN: set[str] = set()
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for tables between steps, under the folder named by spark.checkpoint.dir.
    Where that is unset, under the warehouse on a local master; a cluster without a shared folder is refused. It
    is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_kindred"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _delete(jvm, conf, path: str) -> None:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # small row groups: a task buffers one of each column
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark._jvm, spark._jsc.hadoopConfiguration(), folder)


def fold(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(buckets)), F.lit(0)).cast("int")


def py_fold(value, buckets: int) -> int:
    return 0 if value is None else zlib.crc32(str(value).encode()) % buckets


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns of any name can't clash; null text stays null."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and ``most`` bytes; a row of more bytes is a part of its own."""
    todo = [batch]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > most):
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


_STATE: dict = {}


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept in this worker process for later tasks with the same key. Only one is
    kept: the state of an earlier step (its model and memo) is given up, and its memory returned."""
    if key not in _STATE:
        release()
        _STATE[key] = make()
    return _STATE[key]


def release() -> None:
    """Give up this worker's state and return free memory to the system where the C library can."""
    _STATE.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text): ``make()`` runs once a task and returns a function from
    (ids, texts) to columns, which gets the rows in slices bounded in rows and bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                cols = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


class Cache(dict):
    """A memo bounded in entries and in the characters of its keys: emptied when full, so it only affects
    speed, never results. Long keys are not worth keeping: ``forget`` takes them out after their slice."""

    def __init__(self, limit: int = 400_000, chars: int = 16_000_000, long: int = 200):
        self.limit, self.chars, self.long = limit, chars, long
        self.held = 0

    def room(self) -> None:
        if len(self) > self.limit or self.held > self.chars:
            self.clear()
            self.held = 0

    def forget(self, fresh) -> None:
        """Account for the keys that were just learnt, without the long ones."""
        for key in fresh:
            if len(key) > self.long:
                del self[key]
            else:
                self.held += len(key)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, for whose text ``make()``'s function says True: no join back."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(work(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
