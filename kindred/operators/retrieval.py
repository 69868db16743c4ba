"""Exact top-k retrieval over posting blocks.

A posting block is the part of a term's list (by field) that lies in one shard of the documents: bounded
by the shard's size however frequent the term. Queries are cut into blocks too. A shard's blocks are one row, as is a
block of queries; each is written once, and every pair of them meets in a task that reads the two (a product of the
rows, no shuffle of copies). There each query adds up its lists document by document and gives back its k
best; a ranking over the shards' winners ends the search. So what leaves a task is queries x k rows: no
row is ever made for a (query, document) pair that shares a word.

Within a task lists go by their greatest possible contribution. As soon as the lists to come can't bring a
document without any hit over the k-th best so far, only documents already seen are completed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a shard and queries of a block, about.
SHARD, QUERIES = 16384, 1024

FOUND = "material_id string, price_id string, score double, scored long, met long"
TOTALS = "material_id string, pairs long, total double, best double"


@dataclass(frozen=True)
class Part:
    """A summand of the score: ``boost`` times the greatest of its (accumulator, weight) pairs."""

    boost: float
    of: tuple[tuple[int, float], ...]


def shards_of(docs: int, size: int = SHARD) -> int:
    return max(1, -(-docs // size))


def posting_blocks(postings: DataFrame, shards: int, positions: Sequence[str] = ()) -> DataFrame:
    """shard, field, term, docs, tfs, norms, spots from postings (doc, field, term, tf, norm, spots), ``spots``
    only of the fields in ``positions``. A list has at most a shard's documents."""
    spots = F.when(F.col("field").isin(*positions), F.col("spots")) if positions else F.lit(None).cast("array<int>")
    entry = F.struct("doc", F.col("tf").cast("double").alias("tf"), "norm", spots.alias("spots"))
    rows = postings.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))
    # by shard, so that a shard's lists are made where they are put together
    lists = rows.repartition(shards, "shard").groupBy("shard", "field", "term").agg(F.collect_list(entry).alias("e"))
    return lists.select("shard", "field", "term", F.col("e.doc").alias("docs"), F.col("e.tf").alias("tfs"), F.col("e.norm").alias("norms"), F.col("e.spots").alias("spots"))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _one_row(key: str, table: pa.Table, parts: dict[str, pa.Table]) -> pa.Table:
    return pa.table({key: pa.array(table[key].slice(0, 1).to_pylist(), pa.int32())} | {n: pa.array([_packed(t)], pa.binary()) for n, t in parts.items()})


def _numbered(table: pa.Table) -> pa.Table:
    """A shard's lists as one row: its documents in the order of their ids, and the lists with their numbers."""
    table = table.combine_chunks()
    docs = table["docs"].combine_chunks()
    coded = docs.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    turn = np.empty(len(names), np.int32)
    turn[order] = np.arange(len(names), dtype=np.int32)
    size = pa.array(np.asarray(pa.compute.list_value_length(docs)), pa.int64())
    flat = {"docs": pa.array(turn[np.asarray(coded.indices)]), "tfs": table["tfs"].combine_chunks().flatten(), "norms": table["norms"].combine_chunks().flatten()}
    lists = pa.table({"field": table["field"], "term": table["term"], "size": size, "spots": table["spots"]})
    return _one_row("shard", table, {"names": pa.table({"name": pa.array([names[k] for k in order], pa.string())}), "lists": lists, "entries": pa.table(flat)})


def meet(blocks: DataFrame, asked: DataFrame, shards: int, queries: int, kernel: Callable[[Lists, pa.Table], pa.Table], schema: str = FOUND) -> DataFrame:
    """Runs ``kernel(lists, asks)`` for each (shard, query block). asked: material_id, field, terms and what
    the kernel needs besides."""
    parts = shards_of(queries, QUERIES)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("material_id"), F.lit(parts)).cast("int"))
    columns = "names binary, lists binary, entries binary"
    lists = blocks.groupBy("shard").applyInArrow(_numbered, f"shard int, {columns}").repartitionById(shards, F.col("shard"))
    asks = asked.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _one_row("part", t, {"asks": t}), "part int, asks binary").repartitionById(parts, F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, lists, entries, asks = (_unpacked(batch.column(c)[k]) for c in ("names", "lists", "entries", "asks"))
                yield from kernel(Lists(names, lists, entries), asks).to_batches()

    # one row of either side in a task
    return lists.hint("shuffle_replicate_nl").crossJoin(asks).drop("shard", "part").mapInArrow(run, schema)


class Lists:
    """The posting blocks of a group in numpy: documents numbered in the order of their ids."""

    def __init__(self, names: pa.Table, lists: pa.Table, entries: pa.Table):
        self.names = names["name"].to_pylist()
        self.size = lists["size"].to_numpy()
        self.docs = entries["docs"].to_numpy().astype(np.int64)
        self.tfs, self.norms = (entries[c].to_numpy().astype(float) for c in ("tfs", "norms"))
        self.start = np.cumsum(self.size) - self.size
        self.at = {k: i for i, k in enumerate(zip(lists["field"].to_pylist(), lists["term"].to_pylist()))}
        self.spots = lists["spots"]

    def rows(self, field: str, term: str) -> slice | None:
        k = self.at.get((field, term))
        return None if k is None else slice(self.start[k], self.start[k] + self.size[k])


def best(score: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores over 0, ties to the smaller document."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        cut = -np.partition(-score[at], k - 1)[k - 1]
        at = at[score[at] >= cut]
    return at[np.lexsort((docs[at], -score[at]))][:k]


def top_of(todo: list[tuple], extra: list[tuple], lists: Lists, acc: np.ndarray, total: Callable[[np.ndarray], np.ndarray], k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents completed) of one query; ``acc`` is given back as zeros.

    todo: (greatest contribution, list, ((accumulator, weight, values), ...)). extra: (accumulator, documents, values)
    that count from the start. ``total`` never falls as accumulators grow, and a document that has only hits of some
    lists scores at most the sum of their greatest contributions and ``slack``."""
    seen = np.zeros(acc.shape[1], bool)
    for a, docs, value in extra:
        acc[a, docs] += value
        seen[docs] = True
    todo.sort(key=lambda t: -t[0])
    to_come = np.cumsum([t[0] for t in todo][::-1])[::-1]
    closed = False
    for step, (_, r, adds) in enumerate(todo):
        if not closed and step and step % 4 == 0:
            at = np.flatnonzero(seen)
            if len(at) >= k:
                so_far = total(acc[:, at])
                closed = -np.partition(-so_far, k - 1)[k - 1] > (to_come[step] + slack) * (1 + 1e-9) + 1e-6
        where = slice(lists.start[r], lists.start[r] + lists.size[r])
        docs = lists.docs[where]
        if closed:
            old = seen[docs]
            docs = docs[old]
            for a, weight, value in adds:
                acc[a, docs] += weight * value[where][old]
        else:
            seen[docs] = True
            for a, weight, value in adds:
                acc[a, docs] += weight * value[where]
    at = np.flatnonzero(seen)
    score = total(acc[:, at])
    chosen = best(score, at, k)
    acc[:, at] = 0.0
    return at[chosen], score[chosen], len(at)


def bm25_kernel(fields: Sequence[str], parts: Sequence[Part], phrased: Sequence[str], k: int, k1: float, digits: int | None):
    """Scores by accumulators: ``exact`` of field f is number 3 i, ``loose`` 3 i + 1, ``phrase`` 3 i + 2."""
    spot = {f: i for i, f in enumerate(fields)}
    linear = np.zeros(3 * len(fields))  # no document's score is over the weighted sum of its accumulators
    for p in parts:
        for a, w in p.of:
            linear[a] += p.boost * w

    def total(acc: np.ndarray) -> np.ndarray:
        out = np.zeros(acc.shape[1])
        for p in parts:
            one = [acc[a] * w for a, w in p.of]
            out += p.boost * (np.maximum.reduce(one) if len(one) > 1 else one[0])
        return np.round(out, digits) if digits is not None else out

    def phrases(lists: Lists, field: str, sequence: list[str], weight: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Documents in which the terms follow each other, and the score of so many times."""
        rows = [lists.at.get((field, t)) for t in sequence]
        if not rows or None in rows:
            return np.zeros(0, np.int64), np.zeros(0)
        part = lambda r: lists.docs[lists.start[r] : lists.start[r] + lists.size[r]]
        common = None
        for r in sorted(set(rows), key=lambda r: lists.size[r]):
            common = np.sort(part(r)) if common is None else common[np.isin(common, part(r))]
            if not len(common):
                return np.zeros(0, np.int64), np.zeros(0)
        spots: dict[int, dict[int, list[int]]] = {}
        for r in set(rows):
            some = np.flatnonzero(np.isin(part(r), common))
            spots[r] = dict(zip(part(r)[some].tolist(), lists.spots[int(r)].values.take(pa.array(some)).to_pylist()))
        times = np.zeros(len(common))
        for i, d in enumerate(common.tolist()):
            begins = set(spots[rows[0]][d])
            for shift, r in enumerate(rows[1:], 1):
                begins &= {p - shift for p in spots[r][d]}
            times[i] = len(begins)
        norm = np.empty(len(lists.names))
        norm[part(rows[0])] = lists.norms[lists.start[rows[0]] : lists.start[rows[0]] + lists.size[rows[0]]]
        docs, tf = common[times > 0], times[times > 0]
        return docs, sum(weight[t] for t in sequence) * tf * (k1 + 1) / (tf + norm[docs])

    def run(lists: Lists, right: pa.Table) -> pa.Table:
        impact = lists.tfs * (k1 + 1) / (lists.tfs + lists.norms)
        peak = np.maximum.reduceat(impact, lists.start) if len(lists.size) else np.zeros(0)
        acc = np.zeros((3 * len(fields), len(lists.names)))
        out = Winners(lists)
        for q, rows in _by_query(right):
            todo, extra = [], []
            for row in rows:
                f = 3 * spot[row["field"]]
                for term, exact, loose in zip(row["terms"], row["exact"], row["loose"]):
                    r = lists.at.get((row["field"], term))
                    adds = tuple((a, w, impact) for a, w in ((f, exact), (f + 1, loose)) if linear[a] and w)
                    if r is not None and adds:
                        todo.append((sum(linear[a] * w for a, w, _ in adds) * peak[r], r, adds))
                if row["field"] in phrased:
                    extra.append((f + 2, *phrases(lists, row["field"], row["sequence"], dict(zip(row["terms"], row["exact"])))))
            out.add(q, *top_of(todo, extra, lists, acc, total, k))
        return out.table()

    return run


#: The keyword rule's fields: points of a word's list, and of the whole query (its term is the query).
WORDS, WHOLE = "words", "whole"


def _keyword_todo(rows: list[dict], lists: Lists) -> Iterator[tuple[float, int, bool]]:
    """(times, list, whether it is a word's) of what a query asks for and the shard has."""
    for row in rows:
        for term, times in zip(row["terms"], row["times"]):
            r = lists.at.get((row["field"], term))
            if r is not None:
                yield times, r, row["field"] == WORDS


def _keyword_total(acc: np.ndarray, need: float) -> np.ndarray:
    return acc[0] + 3.0 * (acc[1] >= 0.7 * need) if need > 1 else acc[0].copy()


def keyword_totals_kernel():
    """Number, sum and maximum of a query's scores of at least 1 by additive points: lists hold a word's points (``tfs``)
    and how far it counts as matched (``norms``); 3 more if the matched words are 70 % of several. ``need``: the query's
    number of words."""

    def run(lists: Lists, right: pa.Table) -> pa.Table:
        acc = np.zeros((2, len(lists.names)))
        out: list[tuple] = []
        for q, rows in _by_query(right):
            acc[:] = 0.0
            for times, r, word in _keyword_todo(rows, lists):
                where = slice(lists.start[r], lists.start[r] + lists.size[r])
                docs = lists.docs[where]
                acc[0, docs] += times * lists.tfs[where]
                if word:
                    acc[1, docs] += times * lists.norms[where]
            score = _keyword_total(acc, rows[0]["need"])
            score = score[score >= 1]
            if len(score):
                out.append((q, len(score), float(score.sum()), float(score.max())))
        columns = zip(*out) if out else ((), (), (), ())
        types = (pa.string(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("material_id", "pairs", "total", "best"), columns, types)})

    return run


def _by_query(asks: pa.Table) -> Iterator[tuple[str, list[dict]]]:
    rows: dict[str, list] = {}
    for row in asks.to_pylist():
        rows.setdefault(row["material_id"], []).append(row)
    yield from rows.items()


class Winners:
    def __init__(self, lists: Lists):
        self.names = lists.names
        self.columns: dict[str, list] = {c: [] for c in ("material_id", "price_id", "score", "scored", "met")}

    def add(self, query: str, docs: np.ndarray, scores: np.ndarray, scored: int) -> None:
        for column, values in zip(self.columns.values(), ([query] * len(docs), [self.names[d] for d in docs], scores.tolist(), [scored] * len(docs), [len(self.names)] * len(docs))):
            column.extend(values)

    def table(self) -> pa.Table:
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(self.columns.items(), (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()))})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """material_id, price_id, score, rank from the shards' winners."""
    w = Window.partitionBy("material_id").orderBy(F.desc("score"), "price_id")
    return found.select("material_id", "price_id", "score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
