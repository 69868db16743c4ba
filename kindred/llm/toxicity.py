"""Toxicity: a linear softmax over the average of subword-bag embeddings, both trained jointly in numpy.

A word's vector is the mean of the vectors of the word itself and of its character n-grams (hashed to a
fixed table), so a misspelling that was never seen shares most of them. A document is the mean of its
words. Scoring folds table and softmax into one number a word, memoized.

``fit`` takes at most ``per_class`` different texts of each label (the smallest by hash of the id), and
of those, in that order, as many as have ``max_bytes`` together, weighted back to the labels' shares over
all training rows; these bounds and the table size bound the driver's memory, whatever the documents.

Defined results: text that is null or has no letters scores the training rows' base rate; without
training rows of both labels every score is the base rate; of several labels for an id the largest counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, Cache, documents, letter_runs, map_rows, release, worker_state
from .runs import ragged

SIZES = (4, 5)


def subwords(word: str, buckets: int) -> list[int]:
    w = f"<{word}>"
    found = {w, *(w[i : i + n] for n in SIZES for i in range(len(w) - n + 1))}
    return sorted(zlib.crc32(g.encode()) % buckets for g in found)


@dataclass
class ToxicityModel:
    table: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def score(self, texts: list) -> list[float]:
        return Scorer(self).score(texts)


class Scorer:
    """A model folded into one number a bucket, with a memo of chunks between blanks."""

    def __init__(self, model: ToxicityModel):
        #: each bucket's share of the difference of the two logits
        self.pull = (model.table @ (model.softmax[:, 1] - model.softmax[:, 0])).astype(float)
        self.bias = float(model.bias[1] - model.bias[0])
        self.memo = Cache()

    def word(self, w: str) -> float:
        return float(self.pull[subwords(w, len(self.pull))].mean())

    def score(self, texts: list) -> list[float]:
        memo = self.memo
        out = []
        for t in texts:
            memo.room()
            chunks = (t or "").lower().split()
            fresh = {c for c in chunks if c not in memo}
            for c in fresh:
                ws = letter_runs(c)
                memo[c] = complex(sum(map(self.word, ws)), len(ws))
            total = sum(map(memo.__getitem__, chunks), 0j)
            memo.forget(fresh)
            logit = self.bias + (total.real / total.imag if total.imag else 0.0)
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        return out


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, buckets: int = 1 << 17, dim: int = 4, epochs: int = 8, rate: float = 0.3, scale: float = 100.0, batch: int = 32, floor: float = 1e-4, seed: int = 3) -> ToxicityModel:
    """Adagrad on both layers, with one accumulator a table row; the rate falls to nothing. ``scale`` multiplies the
    mean vector, which is small because a document has many words; it ends up in the softmax weights."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    share = np.array([weight[y == 0].sum(), weight[y == 1].sum()]) / max(weight.sum(), 1e-9)
    bias = np.log(np.clip(share, 1e-3, 1))
    # words by number: their buckets in one array; documents: numbers and shares of their words
    index: dict[str, int] = {}
    buckets_of, bags, marks, weights = [], [], [], []
    for t, label, w in zip(texts, y, weight):
        words = Counter(LETTERS.findall(t.lower()))
        if not words:
            continue
        for x in words:
            if x not in index:
                index[x] = len(index)
                buckets_of.append(np.array(subwords(x, buckets), np.int32))
        share_of = np.fromiter(words.values(), np.float32, len(words)) * np.float32(scale / words.total())
        bags.append((np.fromiter(map(index.__getitem__, words), np.int32, len(words)), share_of))
        marks.append(int(label))
        weights.append(float(w))
    if not bags or min(share) == 0:
        return ToxicityModel(table * 0, softmax, bias)
    del index
    count = np.fromiter(map(len, buckets_of), np.int64, len(buckets_of))
    start, flat = np.cumsum(count) - count, np.concatenate(buckets_of)
    del buckets_of
    one_hot = np.eye(2, dtype=np.float32)[marks]
    each = np.array(weights, np.float32)
    each /= each.mean()
    heat, heat_top = np.zeros(buckets, np.float32), np.zeros_like(softmax)
    steps, done = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            word = np.concatenate([bags[d][0] for d in docs])
            ids = flat[ragged(start[word], count[word])]
            part = np.repeat(np.concatenate([bags[d][1] for d in docs]) / count[word].astype(np.float32), count[word])[:, None]
            ends = np.cumsum(count[word])[np.cumsum([len(bags[d][0]) for d in docs]) - 1]
            size = np.diff(ends, prepend=0)
            at = ends - size
            mean = np.add.reduceat(table[ids] * part, at)
            logit = mean @ softmax + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = ((p - one_hot[docs]) * np.minimum(each[docs], 10)[:, None]).astype(np.float32)
            step = rate * (1 - done / steps)
            pull = np.repeat(err @ softmax.T, size, axis=0) * part
            grad = mean.T @ err
            heat_top += grad**2
            softmax -= step * grad / np.sqrt(heat_top + 1e-6)
            gone, where = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(where, c) for c in pull.T], 1).astype(np.float32)
            heat[gone] += (grad**2).mean(1)
            table[gone] -= step * grad / np.sqrt(heat[gone] + floor)[:, None]
            bias = bias - 0.1 * step * err.mean(0)
            done += 1
    return ToxicityModel(table, (softmax * scale).astype(np.float32), bias)


def sample(df: DataFrame, marks: DataFrame, per_class: int, max_bytes: int) -> list[tuple[int, int, str]]:
    """(doc_id, y, text) of the training sample. Only keys and sizes are ranked; texts are read for the chosen."""
    rows = documents(df).filter("doc_id IS NOT NULL").withColumns({"text": F.coalesce("text", F.lit("")), "h": F.xxhash64("text")})
    keys = rows.select("doc_id", "h", F.octet_length("text").alias("size")).join(marks, "doc_id").distinct()
    chosen, left = [], max_bytes
    for k in (0, 1):  # at most per_class rows each
        room = left // (2 - k)
        for r in keys.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(per_class).collect():
            if r["size"] <= room:
                room, left = room - r["size"], left - r["size"]
                chosen.append((r["doc_id"], r["h"], k))
    spark = df.sparkSession
    # at most 2 * per_class rows are broadcast, and as many texts of max_bytes come back
    picked = rows.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, h long, y int")), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return sorted((r["doc_id"], r["y"], r["text"]) for r in picked.select("doc_id", "y", "text").collect())


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 3000, max_bytes: int = 64 << 20, **params) -> ToxicityModel:
    """``labels``: (doc_id, label_col), training rows only."""
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = sample(df, marks, per_class, max_bytes)
    y = np.array([k for _, k, _ in rows], int)
    had = np.bincount(y, minlength=2)
    weight = np.array([shares.get(k, 0) / max(had[k], 1) for k in y], float)
    model = train([t for _, _, t in rows], y, weight, **params)
    del rows
    release()
    return model


def scorer(model: ToxicityModel, spark: SparkSession) -> Callable[[], Scorer]:
    """Broadcasts the model; what it returns gives a worker its scorer."""
    shared, key = spark.sparkContext.broadcast(model), ("toxicity", uuid.uuid4().hex)
    return lambda: worker_state(key, lambda: Scorer(shared.value))


def score(df: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score."""
    get = scorer(model, df.sparkSession)

    def make():
        s = get()
        return lambda ids, texts: {"doc_id": ids, "score": s.score(texts)}

    return map_rows(documents(df), make, "doc_id long, score double")
