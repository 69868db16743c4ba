"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal
equations, isotonic calibration.

``fit`` reads every labelled training row. Each partition adds up its own Gram matrices (one for each of
four folds), which are tree-summed: size (features + 1)^2, whatever the input. The ridge weights of
three folds score the fourth, and these out-of-fold scores, binned, are what the isotonic step sees.

Defined results: null and empty texts have statistics of their own (all zero) and get a score as any
text; without training rows every score is 0.5; of several labels for an id the largest counts;
repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, map_rows, materialize, release

N_STATS = 16
FOLDS = 4


@lru_cache(1)
def _classes() -> np.ndarray:
    """Byte classes: letters (ASCII or lead bytes), capitals, digits, signs, blanks, line ends."""
    c = np.zeros((256, 6))
    for b in range(256):
        ch = chr(b)
        c[b] = [b >= 0xC0 or b < 128 and ch.isalpha(), b < 128 and ch.isupper(), b < 128 and ch.isdigit(), 32 < b < 127 and not ch.isalnum(), b in (32, 9), b == 10]
    return c


def stats(text: str | None) -> np.ndarray:
    """Sixteen statistics of one text, each bounded or logarithmic."""
    out = np.zeros(N_STATS)
    raw = (text or "").encode()
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, caps, digits, signs, blanks, ends = hist @ _classes()
    visible = letters + digits + signs or 1.0
    p = hist[hist > 0] / len(raw)
    words = raw.split()
    n = len(words) or 1
    seen = set(words)
    twice = sum(map(bytes.__eq__, words, words[1:])) if words else 0
    lines = [x for x in raw.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    for w in words[:0] if len(seen) == n else words:
        counts[w] = counts.get(w, 0) + 1
    out[:] = [
        np.log1p(len(raw)) / 5,
        letters / visible,
        caps / (letters or 1),
        digits / visible,
        min(signs / n, 4),
        blanks / len(raw),
        min(1.0, ends / n),
        min(letters / n, 20) / 5,
        np.log1p(len(seen)) / np.log1p(n),
        max(counts.values(), default=1) / n,
        twice / n,
        1 - len(set(lines)) / (len(lines) or 1),
        -(p * np.log2(p)).sum() / 4,
        signs / visible,
        sum(len(w) == 1 for w in seen) / len(seen) if seen else 0.0,
        min(hist[ord(".")] / n, 1),
    ]
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """sqrt(2/D) cos(Wx + b): inner products approximate a Gaussian kernel; and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1]), np.ones((len(x), 1))])

    def score_texts(self, texts: list) -> np.ndarray:
        return self.score(np.stack([stats(t) for t in texts])) if texts else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are the blocks' centres, so scores between them interpolate."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    a = np.array(blocks)
    return a[:, 0] / a[:, 2], np.clip(a[:, 1] / a[:, 2], 0, 1)


def stats_table(df: DataFrame) -> DataFrame:
    def make():
        release()  # what earlier steps kept in this worker
        return lambda ids, texts: {"doc_id": ids, "x": [stats(t) for t in texts]}

    return map_rows(documents(df), make, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), N_STATS)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", features: int = 256, ridge: float = 1e-4, gamma: float = 0.05, bins: int = 1024, seed: int = 7) -> QualityModel:
    """``labels``: (doc_id, label_col), training rows only."""
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    # shuffle ids and statistics, never texts
    train = stats_table(df).join(marks, "doc_id").select("x", "y", fold("doc_id", FOLDS).alias("fold"))
    train = materialize(train, "quality-train")
    one = train.select(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    rng = np.random.default_rng(seed)
    omega = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features))
    phase = rng.uniform(0, 2 * np.pi, features)
    n = one["n"]
    if not n:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), omega, phase, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([one[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([max(one[f"s{i}"], 1e-3) for i in range(N_STATS)])
    model = QualityModel(mean, scale, omega, phase, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                z, y, k = model.features(_matrix(part.column(0))), np.asarray(part.column(1)), np.asarray(part.column(2))
                for f in range(FOLDS):
                    zf = z[k == f]
                    gram[f] += zf.T @ zf
                    right[f] += zf.T @ y[k == f]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([gram.tobytes() + right.tobytes()], pa.binary())})

    total = train.mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]))).treeReduce(np.add)
    cut = FOLDS * size * size
    gram, right = total[:cut].reshape(FOLDS, size, size), total[cut:].reshape(FOLDS, size)
    solve = lambda g, r: np.linalg.solve(g + ridge * max(g[-1, -1], 1) * np.eye(size) * 0.1, r)
    others = np.stack([solve(gram.sum(0) - gram[f], right.sum(0) - right[f]) for f in range(FOLDS)])
    model.weights = solve(gram.sum(0), right.sum(0))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, k = model.features(_matrix(batch.column(0))), np.asarray(batch.column(2))
            s = np.einsum("ij,ij->i", z, others[k])
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip(np.floor((s + 0.5) / 2 * bins), 0, bins - 1).astype(np.int32)), "s": pa.array(s), "y": batch.column(1)})

    # at most ``bins`` rows reach the driver
    table = train.mapInArrow(held, "bin int, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    table.sort(key=lambda r: r["bin"])
    # half a row of each label keeps the ends off 0 and 1
    y0 = sum(r["y"] * r["n"] for r in table) / n
    model.knots, model.values = isotonic(np.array([r["s"] for r in table]), np.array([(r["y"] * r["n"] + y0) / (r["n"] + 1) for r in table]), np.array([float(r["n"]) for r in table]))
    return model


def score(df: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda ids, texts: {"doc_id": ids, "score": m.score_texts(texts)}

    return map_rows(documents(df), make, "doc_id long, score double")
