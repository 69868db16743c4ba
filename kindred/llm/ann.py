"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is bisected into equal halves again and again; the leaves' means, refined a few rounds,
are the lists' centroids. They are searched by a best-first walk over a neighbour graph kept in memory
(its size is bounded by ``max_lists``). A vector goes to its nearest list and, if it lies near a boundary,
to further ones within a distance ratio; a query reads the lists within a wider ratio. The vectors and the
queries of a list are both cut into parts of bounded size, so a long list is many groups. Equal vectors
are one entry with their smallest ids, so copies of one vector cost nothing. A query whose lists hold
fewer than k vectors is asked of all lists.

The number of lists grows with the vectors up to ``max_lists`` (6.5 million vectors at 400 a list); beyond,
lists grow, and a query reads about probes / max_lists (0.15 %) of all vectors.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, which
is 0 for queries: nearest then means largest inner product.

Defined results: vectors that are null, zero, hold nulls or non-finite numbers, or are of another length
than the commonest take no part; ties go to the smaller id; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, FloatType

from .common import materialize, slices


@dataclass(frozen=True)
class AnnConfig:
    list_size: int = 400
    max_lists: int = 16_384
    sample: int = 32_768
    copies: int = 4
    copy_ratio: float = 1.12
    probes: int = 40
    probe_ratio: float = 1.8
    min_probes: int = 16
    part: int = 2_000
    sample_bytes: int = 64 << 20
    degree: int = 16
    beam: int = 64


class Centroids:
    """Centroids and their neighbour graph; ``search`` walks it for a whole batch at once."""

    def __init__(self, points: np.ndarray, degree: int, seed: int = 5):
        self.points = points.astype(np.float32)
        self.norms = (self.points**2).sum(1)
        n = len(points)
        rng = np.random.default_rng(seed)
        near = min(degree, n - 1)
        links = np.empty((n, near + 4), np.int64)
        for lo in range(0, n, 1024):
            d = self.norms - 2 * self.points[lo : lo + 1024] @ self.points.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + 1024, :near] = np.argpartition(d, near - 1, 1)[:, :near] if near else 0
        links[:, near:] = rng.integers(0, n, (n, 4))  # a few far links keep the graph in one piece
        self.links = links
        self.entries = rng.permutation(n)[: min(n, 16)]

    def search(self, x: np.ndarray, m: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances), nearest first, -1 and inf where fewer than m are found."""
        b, n = len(x), len(self.points)
        x = x.astype(np.float32)
        own = (x**2).sum(1)
        beam = min(max(beam, m), n)
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1)
        dist = np.full((b, beam), np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)

        def add(rows, cand):
            nonlocal ids, dist, open_
            fresh = ~seen[rows[:, None], cand]
            cand_sorted = np.sort(cand, 1)
            twice = np.zeros_like(fresh)
            order = np.argsort(cand, 1, kind="stable")
            np.put_along_axis(twice, order[:, 1:], cand_sorted[:, 1:] == cand_sorted[:, :-1], 1)
            fresh &= ~twice
            seen[rows[:, None], cand] = True
            d = np.where(fresh, own[rows, None] + self.norms[cand] - 2 * np.einsum("ij,ikj->ik", x[rows], self.points[cand]), np.inf)
            d_all = np.concatenate((dist[rows], d), 1)
            i_all = np.concatenate((ids[rows], np.where(fresh, cand, -1)), 1)
            o_all = np.concatenate((open_[rows], fresh), 1)
            keep = np.argsort(d_all, 1, kind="stable")[:, :beam]
            dist[rows], ids[rows], open_[rows] = (np.take_along_axis(a, keep, 1) for a in (d_all, i_all, o_all))

        rows = np.arange(b)
        add(rows, np.tile(self.entries, (b, 1)))
        while len(rows):
            first = np.argmax(open_[rows], 1)
            has = open_[rows, first]
            rows, first = rows[has], first[has]
            if len(rows):
                open_[rows, first] = False
                add(rows, self.links[ids[rows, first]])
        return ids[:, :m], np.maximum(dist[:, :m], 0)


def balanced(x: np.ndarray, lists: int, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Centroids of at most ``lists`` equal parts (a power of two): each part is halved at the median of
    its projection on the line through two 2-means centres; then a few Lloyd rounds."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while 2 * len(parts) <= lists and min(map(len, parts)) > 2:
        halves = []
        for p in parts:
            pts = x[p]
            a, b = pts[rng.choice(len(p), 2, replace=False)]
            for _ in range(4):
                side = pts @ (b - a) > (b @ b - a @ a) / 2
                if side.all() or not side.any():
                    break
                a, b = pts[~side].mean(0), pts[side].mean(0)
            order = np.argsort(pts @ (b - a), kind="stable")
            halves += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = halves
    points = np.stack([x[p].mean(0) for p in parts])
    for _ in range(rounds if len(points) > 1 else 0):
        near = np.concatenate([np.argmin((points**2).sum(1) - 2 * x[lo : lo + 4096] @ points.T, 1) for lo in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, near, x)
        points = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points)
    return points


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (floats stay floats, others are doubles), g1, g2 (a 128-bit hash of v) of the rows that take part."""
    kind = "float" if df.schema[vec_col].dataType == ArrayType(FloatType(), df.schema[vec_col].dataType.containsNull) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    ok = F.expr("v IS NOT NULL AND vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity')) AND exists(v, x -> x <> 0)")
    return rows.filter(ok).withColumns({"g1": F.xxhash64("v"), "g2": F.xxhash64(F.lit(17), "v")})


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """g1, g2, v, ids: each vector once with its ``keep`` smallest ids. Batches keep that many already, and
    a salted step stands before the last, so copies of one vector never meet in one task unbounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            first: dict[tuple, int] = {}
            for k, (i, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                found.setdefault((a, b), []).append(i)
                first.setdefault((a, b), k)
            keys = list(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "g1": pa.array([k[0] for k in keys], pa.int64()),
                    "g2": pa.array([k[1] for k in keys], pa.int64()),
                    "v": batch.column(1).take(pa.array([first[k] for k in keys], pa.int64())),
                    "ids": pa.array([sorted(set(found[k]))[:keep] for k in keys], pa.list_(pa.int64())),
                }
            )

    part = rows.select("vec_id", "v", "g1", "g2").mapInArrow(run, f"g1 long, g2 long, v {dict(rows.dtypes)['v']}, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    part = part.groupBy("g1", "g2", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(32)).alias("salt")).agg(F.first("v").alias("v"), least)
    return part.groupBy("g1", "g2").agg(F.first("v").alias("v"), least)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def search(df: DataFrame, is_query, k: int = 20, cfg: AnnConfig = AnnConfig(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every row with ``is_query`` (a Column over vec_id)."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, kind = sizes["d"] if sizes else 0, dict(rows.dtypes)["v"]
    rows = rows.filter(F.size("v") == dim)
    entries = materialize(distinct_vectors(rows, k + 1), "vectors")
    about = entries.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))")).alias("most")).first()
    n, most = about["n"], about["most"] or 0.0
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    # at most cfg.sample vectors and cfg.sample_bytes reach the driver
    most_taken = max(1, min(cfg.sample, cfg.sample_bytes // (8 * dim)))
    taken = entries.select("v", "g1", "g2").orderBy("g1", "g2").limit(most_taken).toArrow()
    x = _vectors(taken["v"].combine_chunks())
    x = np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]])
    lists = 1
    while lists * 2 * cfg.list_size <= n and lists * 2 <= cfg.max_lists:
        lists *= 2
    graph = spark.sparkContext.broadcast(Centroids(balanced(x, lists), cfg.degree))

    def assigner(query: bool):
        ratio, most_lists, least = (cfg.probe_ratio, cfg.probes, cfg.min_probes) if query else (cfg.copy_ratio, cfg.copies, 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = graph.value
            for batch in batches:
                for part in slices(batch, rows=1000):
                    v = _vectors(part.column("v"))
                    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(most - (v**2).sum(1), 0))
                    ids, dist = index.search(np.hstack([v, last[:, None]]), most_lists, cfg.beam)
                    use = (ids >= 0) & ((dist <= dist[:, :1] * ratio**2) | (np.arange(ids.shape[1]) < least))
                    at, slot = np.nonzero(use)
                    out = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at, slot].astype(np.int32)), *out.columns], names=["list", *part.schema.names])

        return run

    posted = materialize(entries.select("g1", "g2", "v", "ids").mapInArrow(assigner(False), f"list int, g1 long, g2 long, v {kind}, ids array<long>"), "postings")
    # one row a list, at most max_lists
    parts = materialize(posted.groupBy("list").agg(F.ceil(F.count("*") / cfg.part).cast("int").alias("parts")), "parts")
    queries = rows.filter(is_query).select("g1", "g2", F.col("vec_id").alias("query_id")).distinct()
    vectors = entries.join(queries.select("g1", "g2").distinct(), ["g1", "g2"], "left_semi").select("g1", "g2", "v")

    def score(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_held = np.asarray(group["ids"].is_valid())
        held_, asks = group.filter(pa.array(is_held)), group.filter(pa.array(~is_held))
        out: dict[str, list] = {"g1": [], "g2": [], "vec_id": [], "score": []}
        if held_.num_rows and asks.num_rows:
            v, ids = _vectors(held_["v"].combine_chunks()), held_["ids"].to_pylist()
            q = _vectors(asks["v"].combine_chunks())
            a, b = asks["g1"].to_pylist(), asks["g2"].to_pylist()
            take = min(k + 1, len(v))
            # what rounding of a product of these lengths may come to: exact ties stay
            slack = 1e-15 * v.shape[1] * np.sqrt((v * v).sum(1).max() * (q * q).sum(1))
            for lo in range(0, len(q), 512):
                s = q[lo : lo + 512] @ v.T
                cut = -np.partition(-s, take - 1, 1)[:, take - 1]
                for r in range(len(s)):
                    best = np.flatnonzero(s[r] >= cut[r] - slack[lo + r])
                    exact = (v[best] * q[lo + r]).sum(1)
                    pairs = sorted((-e, i) for e, c in zip(exact.tolist(), best.tolist()) for i in ids[c])[: k + 1]
                    out["g1"] += [a[lo + r]] * len(pairs)
                    out["g2"] += [b[lo + r]] * len(pairs)
                    out["vec_id"] += [i for _, i in pairs]
                    out["score"] += [-e for e, _ in pairs]
        return pa.table({"g1": pa.array(out["g1"], pa.int64()), "g2": pa.array(out["g2"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    def ask(asked: DataFrame) -> DataFrame:
        """g1, g2, vec_id, score: at most k + 1 of each asked (list, g1, g2, v)."""
        cut = asked.groupBy("list").agg(F.ceil(F.count("*") / cfg.part).cast("int").alias("cuts")).join(parts, "list")
        cut = materialize(cut, "cuts")
        a = asked.join(cut, "list").select("list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(g1, cuts) as int)").alias("cut"), "g1", "g2", "v", F.lit(None).cast("array<long>").alias("ids"))
        h = posted.join(cut, "list").select("list", F.expr("cast(pmod(g1, parts) as int)").alias("part"), F.explode(F.expr("sequence(0, cuts - 1)")).alias("cut"), "g1", "g2", "v", "ids")
        found = a.unionByName(h).groupBy("list", "part", "cut").applyInArrow(score, "g1 long, g2 long, vec_id long, score double")
        # at most probes * parts * (k + 1) rows a distinct query vector; k + 1 of them go on
        found = found.groupBy("g1", "g2", "vec_id").agg(F.max("score").alias("score"))
        nearest = Window.partitionBy("g1", "g2").orderBy(F.desc("score"), "vec_id")
        return materialize(found.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1).drop("r"), "found")

    found = ask(materialize(vectors.mapInArrow(assigner(True), f"list int, g1 long, g2 long, v {kind}"), "asked"))
    enough = min(k + 1, rows.select("vec_id").distinct().count())
    counts = found.groupBy("g1", "g2").agg(F.count("*").alias("n"))
    short = vectors.join(counts, ["g1", "g2"], "left").filter(F.coalesce("n", F.lit(0)) < enough).select("g1", "g2", "v")
    short = materialize(short.select(F.explode(F.expr(f"sequence(0, {lists - 1})")).alias("list"), "g1", "g2", "v"), "short")
    if not short.isEmpty():
        found = found.join(short.select("g1", "g2").distinct(), ["g1", "g2"], "left_anti").unionByName(ask(short))
    named = queries.join(found, ["g1", "g2"]).filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
