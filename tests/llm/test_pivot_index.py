"""Near-duplicate vectors by the pivot index against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import pivot_index
from kindred.llm.pivot_index import PivotConfig, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    rows = sorted({(i, None if v is None else tuple(v), k) for i, v, k in rows}, key=str)
    fine = [i is not None and k is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, k in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    partners = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and pivot_index.cosine(np.array(rows[a][1]), np.array(rows[b][1])) >= threshold:
                partners[a].add(b)
                partners[b].add(a)
                parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[find(a)] = min(r[0], least.get(find(a), r[0]))
    return sorted(((r[0], len(partners[a]), least.get(find(a)), r[0] == least.get(find(a))) for a, r in enumerate(rows)), key=str)


def got(df, **params):
    return sorted((tuple(r) for r in near_vectors(df, **params).collect()), key=str)


def vectors(dims=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dims))
    rows = []
    for k in range(420):
        spread = 0.02 if k % 3 else 0.11  # some pairs of a centre lie on either side of the threshold
        rows.append((k, (centres[k % 12] + spread * np.linalg.norm(centres[k % 12]) * rng.normal(size=dims)).tolist(), k % 2 if k % 7 else 0))
    rows += [(500 + k, rows[3][1], 1) for k in range(40)] + [(600, [2 * x for x in rows[3][1]], 1), (601, rows[3][1], None), (602, rows[3][1], 0)]
    return rows


def test_equals_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"node": F.lit(1), "links": F.lit("x"), "Label_": F.lit(2)})
    assert got(df) == brute(rows)


def test_small_blocks_and_many_pivots(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, cfg=PivotConfig(least_pivots=128, prefix=24, part=7, group=50)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1e200, 1e190], 1), (3, [1e-200, 0.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [2.0, 0.0, 0.0], 1), (12, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [-1.0, 0.0], 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_tables(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(4, None, 1), (5, [1.0], None)], SCHEMA)) == [(4, 0, 4, True), (5, 0, 5, True)]


@pytest.mark.parametrize("pivots", [64, 256, 1024])
def test_recall_at_the_threshold(pivots):
    """Pairs of random directions at cosine 0.93 exactly share the pivots that make them candidates."""
    rng = np.random.default_rng(1)
    x = pivot_index.unit(rng.normal(size=(2000, 64)))
    z = rng.normal(size=x.shape)
    z = pivot_index.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    p = pivot_index.unit(rng.normal(size=(8 * pivots, 64)))
    p = p[pivot_index.farthest(p, pivots)]
    a, b = (pivot_index.nearest(v, p, 16) for v in (x, y))
    common = (a[:, :, None] == b[:, None, :]).sum((1, 2))
    assert (common >= PivotConfig().shared).mean() >= 0.999


def test_whole_table_has_the_links_of_brute_force(spark):
    from kindred.llm.common import table

    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    # copies and near copies beside the table's own rows
    rng = np.random.default_rng(8)
    rows += [(10_000 + k, (np.array(rows[k % 50][1]) + rng.normal(size=64) * 0.02).tolist(), rows[k % 50][2]) for k in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
