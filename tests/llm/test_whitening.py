"""Whitening against a direct eigendecomposition, and merging against the SVD of all rows."""

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import whitening
from kindred.llm.whitening import Summary, whiten

SCHEMA = "vec_id long, embedding array<double>"


def direct(rows, most=32):
    """{(vec_id, component): row} by numpy on all rows at once."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    centred = ((x * n - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    out = {}
    for (i, _), row, c in zip(rows, x, centred):
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        for k in range(len(e)):
            out.setdefault((i, k + 1), []).append((n, deviation, float(c @ v[:, k] / np.sqrt(e[k])), float(e[k] / np.trace(centred.T @ centred / n))))
    return out


def agree(got, rows):
    want = direct(rows)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k) for (i, k), x in want.items() for _ in x)
    # either sign, the same for all rows
    sign = {r["component"]: np.sign(r["whitened"] * want[r["vec_id"], r["component"]][0][2]) for r in sorted(got, key=lambda r: abs(r["whitened"]))}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] - sign[r["component"]] * whitened) < 1e-8
        assert abs(r["explained"] - explained) < 1e-9 and r["identity_error"] < 1e-10


def test_equals_direct_eigendecomposition(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(700, 40)) * np.linspace(0.2, 3, 40) @ turn)]
    rows += [rows[5], rows[5]]
    # more partitions than are merged at once, some of them empty
    df = spark.createDataFrame(rows, SCHEMA).repartition(90, F.col("vec_id") % 60).withColumns({"n": F.lit(1), "part": F.lit(2)})
    agree(whiten(df).collect(), rows)


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    agree(whiten(df).collect(), [(r["vec_id"], list(r["embedding"])) for r in df.collect()])


def test_rows_left_out_and_components_without_variance(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k), 0.5, 2.0 * (k % 3)]) for k in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [1.0, 2.0])]
    got = whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and {r["vec_id"] for r in got} == set(range(20)) and {r["n"] for r in got} == {20}
    assert abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12 and max(r["identity_error"] for r in got) < 1e-12


def test_empty_single_and_huge(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).count() == 0
    got = whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], SCHEMA)).collect()
    assert [r["deviation"] for r in got if r["vec_id"] == 1] == [None] and max(r["identity_error"] for r in got) < 1e-9


def test_merging_keeps_every_dimension():
    x = np.random.default_rng(4).normal(size=(300, 9)) * np.logspace(0, -5, 9) + 1e3
    total = None
    for part in np.split(x, [1, 3, 7, 20, 150, 290]):
        one = Summary.of(part)
        total = one if total is None else total.merge(one)
    values = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert total.n == 300 and np.allclose(total.mean, x.mean(0), rtol=1e-14) and np.allclose(total.values, values, rtol=1e-6)
    left = total.merge(Summary.of(x[:5]))
    right = Summary.of(x[:5]).merge(total)
    assert np.allclose(left.values, right.values, rtol=1e-9)


def test_integers_are_floored():
    import pyarrow as pa

    assert whitening.integers(pa.array([[0.999, -0.001, 1 / 64]], pa.list_(pa.float64())), 3).tolist() == [[63, -1, 1]]
