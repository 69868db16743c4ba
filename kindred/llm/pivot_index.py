"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered list of its ``prefix`` nearest reference points (pivots), nearest by
cosine. Pivots are chosen from a bounded sample by a farthest-point walk, so near copies of one vector
don't fill the set. Every vector is posted in inverted lists of its pivots; two vectors are candidates if
they share at least ``shared`` pivots, and a candidate pair is verified by its cosine in double precision.

Only rare pivots are posted: of its pivots, rarest first over the whole table, a vector needs the first
prefix - shared + 1, as a pair that shares ``shared`` pivots has its rarest common one among those of both.
There, and only there, the pair is looked at. A list (by label) is compared in blocks (``blocks``), whose
rows come out as counts of links and one edge to the block's component, so neither a hot label nor a large
group of near copies makes a row a pair. Equal vectors are one entry with the number of their ids.

At cosine 0.93 a pair of 64 random dimensions shares 4 of 16 pivots with probability 0.9995 (4,096 pivots)
to 1.0 (up to 1,024), and closer pairs sooner. The number of pivots grows with the vectors up to
``max_pivots``; beyond about 260,000 vectors lists grow, each of about 13 / max_pivots (0.3 %) of a label's.

Defined results: rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite
numbers link with nothing; nor do vectors of different lengths. Rows that repeat id, label and vector are one;
rows of one id that differ are rows of their own, and an id counts once among those that hold one vector. A
null id links with nothing, and its component is null. Every row is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .blocks import deal, segments
from .common import discard, materialize, slices
from .components import components


@dataclass(frozen=True)
class PivotConfig:
    prefix: int = 16
    shared: int = 4
    least_pivots: int = 64
    max_pivots: int = 4096
    vectors_a_pivot: int = 64
    sample_a_pivot: int = 8
    sample_bytes: int = 64 << 20
    part: int = 8192
    group: int = 8192


TILE = 1024
#: Cosines this near the threshold are computed again in one fixed order of additions.
NEAR = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest entry first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def farthest(x: np.ndarray, m: int) -> np.ndarray:
    """Positions of m rows of unit vectors, each the farthest from those before it."""
    out = [0]
    near = x @ x[0]
    while len(out) < m:
        at = int(np.argmin(near))
        out.append(at)
        near = np.maximum(near, x @ x[at])
    return np.array(out[:m])


def nearest(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each unit vector, nearest first, ties to the smaller number. Vectors of
    another length are compared in the coordinates that both have."""
    d = min(v.shape[1], pivots.shape[1])
    s = -(v[:, :d] @ pivots[:, :d].T)
    if prefix < s.shape[1]:
        # the cut's ties are settled by number as well
        cut = np.partition(s, prefix - 1, 1)[:, prefix - 1 : prefix]
        s[s > cut] = np.inf
    return np.argsort(s, 1, kind="stable")[:, :prefix]


def linked(table: pa.Table, threshold: float, shared: int) -> pa.Table:
    """node, links, head of the rows of some blocks that have links. ``sets`` holds a row's pivots by rank."""
    table = table.combine_chunks()
    n = table.num_rows
    node, times, rank, i, j, mine = (table[c].to_numpy() for c in ("node", "times", "rank", "i", "j", "mine"))
    size = np.asarray(pa.compute.list_value_length(table["v"].combine_chunks()))
    sets = np.asarray(table["sets"].combine_chunks().flatten()).reshape(n, -1)
    flat, ends = np.asarray(table["v"].combine_chunks().flatten(), float), np.cumsum(size)
    out: list[list[np.ndarray]] = [[], [], []]
    for at in segments(table["block"].to_numpy(), rank, i, j, table["key"].to_numpy()):
        raw = np.stack([flat[ends[k] - size[k] : ends[k]] for k in at])
        v, s, w = unit(raw), sets[at], times[at]
        one = i[at[0]] == j[at[0]]
        left = np.arange(len(at)) if one else np.flatnonzero(mine[at] == i[at[0]])
        right = np.arange(len(at)) if one else np.flatnonzero(mine[at] == j[at[0]])
        if len(left) * len(right) < 2:
            continue
        r = rank[at[0]]
        label, links = np.arange(len(at)), np.zeros(len(at), np.int64)
        lists = _lists(s[right])
        for a0 in range(0, len(left), TILE):
            a = left[a0 : a0 + TILE]
            here = _lists(s[a])
            count = np.zeros((len(a), len(right)), np.uint8)
            home = None
            for q in sorted(here):
                if home is None and q >= r:
                    home = count == 0  # no common pivot before this list's
                if q in lists:
                    count[np.ix_(here[q], lists[q])] += 1
            found = (count >= shared) & (home if home is not None else True)
            if one:
                found &= right[None, :] > a[:, None]
            x, y = np.nonzero(found)
            for lo in range(0, len(x), 1 << 18):
                p, q = a[x[lo : lo + (1 << 18)]], right[y[lo : lo + (1 << 18)]]
                cos = np.concatenate([(v[p[k : k + 8192]] * v[q[k : k + 8192]]).sum(1) for k in range(0, len(p), 8192)])
                for k in np.flatnonzero(np.abs(cos - threshold) < NEAR):
                    cos[k] = cosine(raw[p[k]], raw[q[k]])
                p, q = p[cos >= threshold], q[cos >= threshold]
                np.add.at(links, p, w[q])
                np.add.at(links, q, w[p])
                _join(label, p, q)
        some = np.flatnonzero(links)
        for column, x in zip(out, (node[at[some]], links[some], node[at[label[some]]])):
            column.append(x)
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("node", "links", "head"), joined)})


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In double precision, left to right."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    dot = xx = yy = 0.0
    for a, b in zip(x.tolist(), y.tolist()):
        dot, xx, yy = dot + a * b, xx + a * a, yy + b * b
    return dot / (xx**0.5 * yy**0.5)


def _lists(sets: np.ndarray) -> dict[int, np.ndarray]:
    """Inverted lists: the rows of each pivot."""
    order = np.argsort(sets.ravel(), kind="stable")
    values = sets.ravel()[order]
    cuts = np.flatnonzero(np.diff(values)) + 1
    return {int(sets.ravel()[rows[0]]): rows // sets.shape[1] for rows in np.split(order, cuts) if len(rows)}


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the components of linked rows together; a label is the number of a row of its component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != label[label]).any():
            label[:] = label[label]


def near_vectors(df: DataFrame, threshold: float = 0.93, cfg: PivotConfig = PivotConfig(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    kind = "float" if df.schema[vec_col].dataType == ArrayType(FloatType(), df.schema[vec_col].dataType.containsNull) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    usable = F.expr("v IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumns({"ok": F.coalesce(usable, F.lit(False)), "g1": F.xxhash64("v"), "g2": F.xxhash64(F.lit(23), "v")})
    ids = materialize(rows.select("vec_id", "label", "ok", "g1", "g2").distinct(), "ids")
    key = ["label", "g1", "g2"]
    ones = ids.filter("ok").groupBy(*key).agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    vectors = rows.filter("ok").groupBy(*key).agg(F.first("v").alias("v"))
    entries = materialize(vectors.join(ones, key).withColumn("node", F.monotonically_increasing_id()), "entries")
    links, comp = _links(entries, threshold, cfg)
    nodes = entries.select(*key, "node", "times", "least")
    if links is not None:
        nodes = nodes.join(links, "node", "left").join(comp, "node", "left")
    else:
        nodes = nodes.withColumns({"links": F.lit(0).cast("long"), "component": F.col("node")})
    nodes = materialize(nodes.select(*key, "times", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "nodes")
    named = materialize(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    # both unique sides are written tables that grow with the input: merged, so that hot keys can be split
    about = nodes.join(named.hint("merge"), "component").select(*key, "n_links", "component_id")
    out = ids.filter("ok").join(materialize(about, "about").hint("merge"), key).select("vec_id", "n_links", "component_id")
    out = out.unionByName(ids.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    discard(entries, nodes, named)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(entries: DataFrame, threshold: float, cfg: PivotConfig) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, links) and (node, component) of the entries that have links; None without entries."""
    spark = entries.sparkSession
    sizes = entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return None, None
    n, dim = entries.count(), sizes["d"]
    m = cfg.least_pivots
    while m * 2 * cfg.vectors_a_pivot <= n and m * 2 <= cfg.max_pivots:
        m *= 2
    # at most sample_a_pivot * m vectors and sample_bytes reach the driver
    most = max(1, min(cfg.sample_a_pivot * m, cfg.sample_bytes // (8 * dim)))
    taken = entries.filter(F.size("v") == dim).select("v", F.xxhash64("g1", "g2", "label").alias("h"), "node").orderBy("h", "node").limit(most).toArrow()
    x = unit(np.asarray(taken["v"].combine_chunks().flatten(), float).reshape(-1, dim))
    pivots = spark.sparkContext.broadcast(x[farthest(x, min(m, len(x)))])
    m = len(pivots.value)
    prefix = min(cfg.prefix, m)
    shared = min(cfg.shared, prefix)
    v_kind = dict(entries.dtypes)["v"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=1000):
                v = part.column("v")
                size = np.asarray(pa.compute.list_value_length(v))
                near = np.empty((part.num_rows, prefix), np.int32)
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    near[at] = nearest(unit(np.asarray(v.take(pa.array(at)).flatten(), float).reshape(len(at), d)), pivots.value, prefix)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), prefix).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "near"])

    kept = entries.select("node", "times", F.xxhash64("label", F.size("v")).alias("key"), "v")
    described = materialize(kept.mapInArrow(describe, f"node long, times long, key long, v {v_kind}, near array<int>"), "described")
    # one row a pivot
    counts = {r["p"]: r["n"] for r in described.select(F.explode("near").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    rank = np.empty(m, np.int32)
    rank[sorted(range(m), key=lambda p: (counts.get(p, 0), p))] = np.arange(m)
    posts = prefix - shared + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20, 500):
                sets = np.sort(rank[np.asarray(part.column("near").flatten()).reshape(part.num_rows, prefix)], 1)
                at = np.repeat(np.arange(part.num_rows), posts)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sets[at].ravel()), prefix).cast(pa.list_(pa.int32()))
                copied = part.drop_columns(["near"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*copied.columns, lists, pa.array(sets[:, :posts].ravel())], names=[*copied.schema.names, "sets", "rank"])

    posted = described.mapInArrow(post, f"node long, times long, key long, v {v_kind}, sets array<int>, rank int")
    # so that a block holds about 16 MB of numbers, however long the vectors
    part = max(64, min(cfg.part, (8 << 20) // (8 * dim)))
    dealt, used = deal(posted, ["key", "rank"], "node", part, max(part, cfg.group * part // cfg.part))
    found = dealt.groupBy("grp").applyInArrow(lambda t: linked(t, threshold, shared), "node long, links long, head long")
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    discard(described, *used)
    return links, comp
