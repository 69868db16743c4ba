"""The keyword rule's k best over classes of items.

Most of a score depends on name and brand, which many items have in common; an item's own are only the points of words
within its article and of a text that holds the whole query. So a shard has lists of classes (items of equal name and
brand) for words, and lists of items for the rest. A query's words that stand in names or brands are added up over the
classes, once for all queries that have the same ones, and its own items are then scored one by one: an item without
points of its own that is among a query's best is among the best by the classes, since points never lower a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import FOUND, _keyword_total, _one_row, _unpacked, best, shards_of

#: Queries of a block, about.
QUERIES = 2048

#: Kinds of rows: an item and its class; a word's class, points and share matched; a word's item; a whole query's item.
ITEM, CLASS, ARTICLE, WHOLE = range(4)


def row(kind: int, cls: Column, term: Column, doc: Column, points: Column, matched: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), cls.alias("cls"), term.alias("term"), doc.alias("doc"), points.cast("double").alias("points"), matched.cast("double").alias("matched")]


def _shard(table: pa.Table) -> pa.Table:
    """One row of a shard's rows: items in the order of their ids, classes in that of their first items, lists as runs."""
    table = table.combine_chunks()
    kind = table["kind"].to_numpy()
    items = table.filter(pa.array(kind == ITEM))
    items = items.take(pc.sort_indices(items["doc"]))
    names, classes = items["doc"].combine_chunks(), items["cls"].combine_chunks().dictionary_encode()
    of = np.asarray(classes.indices)
    listed = table.filter(pa.array(kind != ITEM))
    kind = listed["kind"].to_numpy()
    by_class = np.asarray(pc.fill_null(pc.index_in(listed["cls"], classes.dictionary), -1))
    by_item = np.asarray(pc.fill_null(pc.index_in(listed["doc"], names), -1))
    terms = listed["term"].combine_chunks().dictionary_encode()
    code = np.asarray(terms.indices)
    order = np.lexsort((code, kind))
    change = np.flatnonzero((np.diff(kind[order], prepend=-1) != 0) | (np.diff(code[order], prepend=-1) != 0))
    entries = {"number": pa.array(np.where(kind == CLASS, by_class, by_item)[order], pa.int32()), **{c: listed[c].take(pa.array(order)) for c in ("points", "matched")}}
    lists = {"kind": pa.array(kind[order][change], pa.int32()), "term": terms.dictionary.take(pa.array(code[order][change])), "start": pa.array(change, pa.int64())}
    return _one_row("shard", table, {"items": pa.table({"name": names, "cls": pa.array(of, pa.int32())}), "lists": pa.table(lists), "entries": pa.table(entries)})


class Shard:
    def __init__(self, items: pa.Table, lists: pa.Table, entries: pa.Table):
        self.names = items["name"].combine_chunks()
        self.of = items["cls"].to_numpy()
        self.members = np.argsort(self.of, kind="stable")
        size = np.bincount(self.of)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.number, self.points, self.matched = (entries[c].to_numpy() for c in ("number", "points", "matched"))
        start = lists["start"].to_numpy()
        ends = np.append(start[1:], len(self.number))
        self.at = {k: slice(b, e) for *k, b, e in zip(lists["kind"].to_pylist(), lists["term"].to_pylist(), start, ends) for k in [tuple(k)]}


def _best_of(score: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    chosen = best(score, docs, k)
    return docs[chosen], score[chosen]


def kernel(shard: Shard, asks: pa.Table, k: int) -> pa.Table:
    """The k best items of each ask (material_id, need, terms, times), ties to the smaller id."""
    acc = np.zeros((2, len(shard.begin)))
    numbers = np.arange(acc.shape[1])
    known: dict[tuple, list[dict]] = {}
    for ask in asks.to_pylist():
        of = tuple(sorted((t, n) for t, n in zip(ask["terms"], ask["times"]) if (CLASS, t) in shard.at))
        known.setdefault((ask["need"], of), []).append(ask)
    found: list[tuple[str, np.ndarray, np.ndarray]] = []
    for (need, of), some in known.items():
        acc[:] = 0.0
        for term, times in of:
            where = shard.at[CLASS, term]
            acc[0, shard.number[where]] += times * shard.points[where]
            acc[1, shard.number[where]] += times * shard.matched[where]
        # the k best items are among the first k of the k best classes, which are in the order of their first items
        tops, score = _best_of(_keyword_total(acc, need), numbers, k)
        first = [shard.members[shard.begin[c] : min(shard.end[c], shard.begin[c] + k)] for c in tops]
        docs = np.concatenate(first) if first else np.zeros(0, np.int64)
        base, base_score = _best_of(np.repeat(score, [len(f) for f in first]), docs, k)
        for ask in some:
            own = [(shard.at[ARTICLE, t], n) for t, n in zip(ask["terms"], ask["times"]) if (ARTICLE, t) in shard.at]
            own += [(shard.at[WHOLE, ask["whole"]], 1.0)] if (WHOLE, ask["whole"]) in shard.at else []
            chosen, chosen_score = base, base_score
            if own:
                mine, spot = np.unique(np.concatenate([shard.number[w] for w, _ in own]), return_inverse=True)
                more = np.bincount(spot, np.concatenate([n * shard.points[w] for w, n in own]))
                theirs = acc[:, shard.of[mine]]
                theirs[0] += more
                others = ~np.isin(base, mine)
                chosen, chosen_score = _best_of(np.concatenate([_keyword_total(theirs, need), base_score[others]]), np.concatenate([mine, base[others]]), k)
            found.append((ask["material_id"], chosen, chosen_score))
    size = np.array([len(docs) for _, docs, _ in found], np.int64)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    asked = pa.array([q for q, _, _ in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), size)))
    number, score = joined([d for _, d, _ in found], np.int64), joined([s for _, _, s in found], float)
    same = lambda n: pa.array(np.full(len(number), n, np.int64))
    return pa.table({"material_id": asked, "price_id": shard.names.take(pa.array(number)), "score": pa.array(score), "scored": same(acc.shape[1]), "met": same(len(shard.names))})


def meet(rows: DataFrame, shards: int, asks: DataFrame, queries: int, k: int) -> DataFrame:
    """The shards' winners (``retrieval.FOUND``). rows: shard and ``row``. asks: material_id, whole, need, terms, times and
    ``alike``, equal for queries with the same words in names and brands."""
    parts = shards_of(queries, QUERIES)
    columns = "items binary, lists binary, entries binary"
    left = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard, f"shard int, {columns}").repartitionById(shards, F.col("shard"))
    asks = asks.withColumn("part", F.pmod("alike", F.lit(parts)).cast("int")).drop("alike")
    right = asks.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _one_row("part", t, {"asks": t}), "part int, asks binary").repartitionById(parts, F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, lists, entries, some = (_unpacked(batch.column(c)[i]) for c in ("items", "lists", "entries", "asks"))
                yield from kernel(Shard(items, lists, entries), some, k).combine_chunks().to_batches(max_chunksize=65_536)

    # one row of either side in a task
    return left.hint("shuffle_replicate_nl").crossJoin(right).drop("shard", "part").mapInArrow(run, FOUND)
