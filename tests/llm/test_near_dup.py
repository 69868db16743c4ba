"""DartMinHash, near-duplicate classes and components against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import dart_minhash, near_dup, shingles
from kindred.llm.components import components

WORD = re.compile("[0-9A-Za-z_\u0080-\U0010ffff]+")


def multiset(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    sets, parent = [multiset(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            total = sum(sets[i].values()) + sum(sets[j].values()) - both
            if (both / total >= 0.8) if total else (rows[i][1] or "") == (rows[j][1] or ""):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted((d, best[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows = [(k, " ".join(rng.choice(vocabulary, 80))) for k in range(30)]
    base = rows[0][1].split()
    for k in range(60):  # a large group of near copies of one text
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 4), replace=False):
            words[at] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, rows[1][1]) for k in range(40)]  # exact copies
    rows += [(300, None), (301, ""), (302, "..."), (303, "..."), (304, "!!"), (305, "Two words"), (306, "two, WORDS!"), (307, "long " * 20_000), (307, "long " * 20_000)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, node long, bands string").repartition(5)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == brute(rows)


def test_small_blocks_equal_brute_force(spark):
    """Without leader rounds all links come from the blocks, here of a few rows each."""
    rows = corpus()[:95]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df, rounds=0, block=2000).collect()) == brute(rows)


def chains():
    """Families of texts in which only neighbours are near duplicates, so leaders leave links to the blocks."""
    rng = np.random.default_rng(9)
    vocabulary, rows = [f"w{k}" for k in range(3000)], []
    for family in range(12):
        words = list(rng.choice(vocabulary, 120))
        for k in range(12):
            rows.append((family * 100 + k, " ".join(words)))
            words[(k * 9) % 120] = "new" + str(family * 100 + k)
            words[(k * 9 + 4) % 120] = "other" + str(family * 100 + k)
    return rows


def test_chance_agreement_of_signatures_loses_no_pair(spark, monkeypatch):
    """All signatures agree in all bytes, so only the full band hashes say which bands a pair shares."""
    rows, sketch = chains(), near_dup.sketch
    monkeypatch.setattr(near_dup, "sketch", lambda *a: sketch(*a).withColumn("signature", F.lit(bytes(80))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df).collect()) == brute(rows)


def test_blocks_of_few_rows_equal_brute_force(spark):
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_duplicates(df, block=2000).collect()) == brute(rows)


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    k, errors = 512, []
    for _ in range(5):
        x = {int(e): float(w) for e, w in zip(rng.integers(0, 2**62, 60), rng.uniform(0.2, 9, 60))}
        y = {e: w * rng.choice([1, 0.5, 2]) for e, w in list(x.items())[:45]} | {int(e): 1.5 for e in rng.integers(0, 2**62, 15)}
        doc = np.array([0] * len(x) + [1] * len(y))
        sig = dart_minhash.signatures(doc, np.array([*x, *y], np.uint64), np.array([*x.values(), *y.values()]), 2, k)
        true = sum(min(x.get(e, 0), y.get(e, 0)) for e in x | y) / sum(max(x.get(e, 0), y.get(e, 0)) for e in x | y)
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.12


def test_words_that_chunks_cut(monkeypatch):
    texts = ["one", None, "", "a\u00e9rea 1_000 " * 30, "x" * 500 + " y"]
    text, value = shingles.words(texts)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(shingles, "CHUNK", size)
        again = shingles.words(texts)
        assert (again[0] == text).all() and (again[1] == value).all()
    assert len(shingles.words(["one"])[0]) == 1 and len(shingles.shingles([None, "two words"])[0]) == 1


def test_signatures_do_not_depend_on_the_batch():
    e = np.arange(40, dtype=np.uint64) * np.uint64(977)
    w = np.linspace(0.5, 20, 40)
    alone = dart_minhash.signatures(np.zeros(40, int), e, w, 1, 64)[0]
    both = dart_minhash.signatures(np.repeat([0, 1], 40), np.tile(e, 2), np.concatenate((w, w + 3)), 3, 64)
    assert (both[0] == alone).all() and (both[2] == 0).all()


def test_shingle_jaccard_equals_counters():
    texts = [t for _, t in corpus()[:60]]
    owner, value, times, _ = shingles.shingles(texts)
    packed = shingles.multiset(owner, value, times, len(texts))
    for i in range(0, 60, 7):
        a, b = multiset(texts[i]), multiset(texts[(i * 3 + 31) % 60])
        both = sum((a & b).values())
        assert shingles.jaccard(packed[i], packed[(i * 3 + 31) % 60]) == pytest.approx(both / (sum(a.values()) + sum(b.values()) - both))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (100, 51), (52, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (50, 51, 52, 100)} == {50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
