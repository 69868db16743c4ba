"""Spelling variants against plain Python over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import registry, spelling
from kindred.llm.spelling import variants

SCHEMA = "doc_id long, text string"


def counted(rows):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return c


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = {w: k for w, k in counted(rows).items() if len(w) >= 5 and k >= 3}
    about = {}
    for w in n:
        them = [u for u in n if near(w, u)]
        best = min(them, key=lambda u: (-n[u], u), default=None)
        about[w] = (best if best and n[best] >= 2 * n[w] else None, len(them))
    out = []
    for w, (form, k) in about.items():
        root = w
        while about[root][0]:
            root = about[root][0]
        out.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(out)


def got(df, **params):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants(df, **params).collect())


def corpus():
    rng = np.random.default_rng(6)
    letters = list("abcdeabcàéÉ÷ÿ")
    words = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(150)]
    for w in list(words):
        for _ in range(3):
            k = rng.integers(0, len(w))
            words.append([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]][rng.integers(0, 3)])
    # long words on both sides of the matrix's width
    for size in (31, 32, 33, 47, 48, 49, 200):
        w = "".join(rng.choice(letters, size))
        words += [w, w + "a", w[:7] + w[8:], w[:9] + "z" + w[10:]]
    weight = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choice(words, 400, p=weight / weight.sum())) for _ in range(40)]
    texts += [" ".join(words)] * 3
    return [(k, t) for k, t in enumerate(texts)] + [(None, "Abcde abcde"), (900, None), (901, ""), (902, "1 2 3"), (5, "abcde, x"), (5, "abcde, x"), (903, "word́x 中abcde中 abcdeĀabcde")]


@pytest.mark.parametrize("params", [{}, {"part": 5, "group": 40}])
def test_equals_all_pairs(spark, params):
    rows = corpus()
    assert got(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA + ", n int, band string").repartition(3), **params) == brute(rows)


def test_counts_of_slices():
    rows = corpus()
    words, n = spelling.count_slice([i for i, _ in rows], pa.array([t for _, t in rows]), 1)
    total = Counter()
    for w, k in zip(words.to_pylist(), n.tolist()):
        total[w] += k
    assert total == Counter({w: k for w, k in counted(rows).items() if w})
    part = pa.array([t for _, t in rows]).slice(3, 20)
    assert len(spelling.count_slice([i for i, _ in rows][3:23], part, 1)[0]) > 0
    assert spelling.count_slice([1, 2], pa.array(["", None], pa.string()), 1)[1].tolist() == []


def test_masks_of_near_words_share_a_band():
    rng = np.random.default_rng(0)
    for w, _ in [(w, 0) for w in counted(corpus()) if w][:200]:
        k = int(rng.integers(0, len(w)))
        for u in (w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "û" + w[k + 1 :]):
            flips = int(spelling.mask(w)) ^ int(spelling.mask(u)) if u else 0
            assert flips.bit_count() <= 2 and any(not flips & int(b) for b in spelling.BANDS)


def test_chains_end_at_the_root(spark):
    words = {"abcdefgh": 64, "abcdefg": 32, "abcdef": 16, "abcde": 8, "abcdx": 4}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert {r[2] for r in brute(rows)} == {"abcdefgh"}


def test_empty_tables(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None), (2, "abcde abcde")], SCHEMA)) == []


def test_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(registry.ORACLES["op13_spelling_variants"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in cur.fetchall())
    assert got(spark.read.parquet(f"{sf_dir}/documents.parquet")) == want
