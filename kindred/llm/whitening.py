"""Embedding whitening by hierarchical SVD merging.

Each task keeps, of its rows, their number, mean, and all singular values and right vectors of the centred
rows. Two summaries are merged by putting their scaled vectors on top of each other with one more row,
sqrt(n1 n2 / (n1 + n2)) times the difference of their means, and taking the SVD again: what comes out is the
SVD of all centred rows together, with every dimension kept. Tasks merge slice by slice, and the tasks'
summaries level by level in groups of ``fan``, so no step holds more than ``fan`` of them: d x d numbers each,
whatever the rows.

Entries are read as integers x = floor(64 c) + 1,000,000 and summarized less the constant, so numbers stay
small. Sums are exact integers.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are
vectors of another length than the commonest (ties: the longer). Entries beyond 2^40 in size are taken as that.
Repeated rows count each. A component without variance has no rows: it has no whitened values. A
deviation that doesn't fit a long is null. A component's largest entry in size is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

SCALE, SHIFT, MOST = 64.0, 1_000_000, 2.0**40
SCHEMA = "part long, n long, sums array<string>, mean array<double>, values array<double>, vectors array<double>"
#: Summaries merged at once.
FAN = 8


@dataclass
class Summary:
    """n rows: their exact integer sums (or none), mean, singular values and right vectors (rows) when centred."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, sums: list[int] = []) -> Summary:
        mean = x.mean(0)
        values, vectors = _svd(x - mean)
        return cls(len(x), sums, mean, values, vectors)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        gap = other.mean - self.mean
        correction = np.sqrt(self.n / n * other.n) * gap
        values, vectors = _svd(np.vstack((self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction)))
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + gap * (other.n / n), values, vectors)

    def row(self, part: int) -> dict[str, list]:
        return {"part": [part], "n": [self.n], "sums": [list(map(str, self.sums))], "mean": [self.mean], "values": [self.values], "vectors": [self.vectors.ravel()]}

    @classmethod
    def read(cls, table: pa.Table, k: int) -> Summary:
        mean, values, vectors = (np.array(table[c][k].as_py()) for c in ("mean", "values", "vectors"))
        return cls(table["n"][k].as_py(), list(map(int, table["sums"][k].as_py())), mean, values, vectors.reshape(len(values), len(mean)))


def _svd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(x) > 2 * x.shape[1]:
        x = np.linalg.qr(x, mode="r")
    _, values, vectors = np.linalg.svd(x, full_matrices=False)
    return values, vectors


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """x - 1,000,000 of each row."""
    c = np.asarray(column.flatten(), float).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64)


def _rows(table: dict) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.float64())] * 3)
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(table.items(), types)})


def _merged(table: pa.Table) -> pa.Table:
    part = table["part"].to_numpy()
    order = np.argsort(part)
    total = Summary.read(table, int(order[0]))
    for k in order[1:]:
        total = total.merge(Summary.read(table, int(k)))
    return _rows(total.row(int(part[order[0]]) // FAN))


def summarize(rows: DataFrame, of) -> Summary | None:
    """One summary of all rows; ``of``: a function from an Arrow batch to a Summary. None without rows."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch):
                one = of(part)
                total = one if total is None else total.merge(one)
        if total is not None:
            yield from _rows(total.row(TaskContext.get().partitionId())).to_batches()

    level = materialize(rows.mapInArrow(start, SCHEMA), "summaries")
    while level.count() > 1:  # a row a task at first, an eighth of them after each step
        after = materialize(level.groupBy(F.floor(F.col("part") / FAN).alias("grp")).applyInArrow(_merged, SCHEMA), "summaries")
        discard(level)
        level = after
    table = level.toArrow()
    discard(level)
    return Summary.read(table, 0) if table.num_rows else None


class Whitener:
    """Exact mean, components and eigenvalues of the fit list."""

    def __init__(self, fitted: Summary, most: int):
        self.n, self.sums = fitted.n, fitted.sums
        self.dim = len(fitted.mean)
        kept = fitted.values > fitted.values[0] * 4 * self.dim * np.finfo(float).eps if len(fitted.values) else np.zeros(0, bool)
        e = fitted.values**2 / fitted.n
        self.explained = (e / max(e.sum(), np.finfo(float).tiny))[kept][:most]
        v = fitted.vectors[kept][:most]
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None] if len(v) else v
        self.mean = np.array([s / self.n for s in self.sums])  # of Python integers: rounded once
        self.axes = (v / np.sqrt(e[kept][:most])[:, None]).T

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        top = int(np.abs(x).max(initial=0))
        if (self.n * top + max(map(abs, self.sums))) ** 2 * self.dim < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        out = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def whiten(df: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    # one row a length
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size["d"]
    rows = rows.filter(F.size("v") == dim)

    def fit(part: pa.RecordBatch) -> Summary:
        x = integers(part.column(1), dim)
        return Summary.of(x.astype(float), [sum(c) for c in x.T.tolist()])

    fitted = Whitener(summarize(rows, fit), most)
    if not len(fitted.explained):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fitted)
    check = summarize(rows, lambda part: Summary.of(shared.value.whiten(integers(part.column(1), dim))))
    k = len(fitted.explained)
    covariance = check.vectors.T * (check.values**2 / check.n) @ check.vectors
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in slices(batch):
                x, m = integers(part.column(1), dim), part.num_rows
                at = pa.array(np.repeat(np.arange(m), k))
                columns = {
                    "vec_id": part.column(0).take(at),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, w.n)),
                    "deviation": pa.array(w.deviations(x), pa.int64()).take(at),
                    "whitened": pa.array(w.whiten(x).ravel()),
                    "explained": pa.array(np.tile(w.explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)
