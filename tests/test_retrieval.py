"""Retrieval and similarity joins against plain Python over all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.functions import metrics
from kindred.operators import candidates, retrieval, similarity
from kindred.operators.candidates import Clause


def words(s):
    return s.lower().split()


def plain_search(items, queries, clauses, k, k1=1.2, b=0.75):
    """Clause sums of all pairs; no near terms."""
    fields = candidates.wanted_fields(clauses)
    docs = {f: {i: words(row.get(f) or "") for i, row in items.items()} for f in fields}
    out = []
    for q, text in queries.items():
        scores = {}
        for i in items:
            total = 0.0
            for c in clauses:
                best = 0.0
                for f, boost in c.fields.items():
                    there = {d: ts for d, ts in docs[f].items() if ts}
                    mean = sum(map(len, there.values())) / max(1, len(there))
                    idf = lambda t: math.log(1 + (len(there) - (df := sum(t in ts for ts in there.values())) + 0.5) / (df + 0.5))  # noqa: E731, B023
                    ts = docs[f][i]
                    norm = k1 * (1 - b + b * len(ts) / mean) if ts else 1
                    sequence = words(text)
                    if c.phrase:
                        n = sum(ts[x : x + len(sequence)] == sequence for x in range(len(ts) - len(sequence) + 1))
                        s = sum(map(idf, sequence)) * n * (k1 + 1) / (n + norm) if n else 0.0
                    else:
                        s = sum(idf(t) * ts.count(t) * (k1 + 1) / (ts.count(t) + norm) for t in set(sequence) if t in ts)
                    best = max(best, boost * s)
                total += c.boost * best
            if round(total, 6) > 0:
                scores[i] = round(total, 6)
        out += [(q, i, s, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


CLAUSES = (Clause({"name": 2.0, "brand": 1.0}, 2.0), Clause({"name": 1.0}, 3.0, phrase=True), Clause({"description": 1.0, "brand": 2.0}, 1.5, phrase=True))


def catalogue(n=120, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(14)]
    text = lambda lo, hi: " ".join(r.choices(vocabulary, range(14, 0, -1), k=r.randint(lo, hi)))
    items = {f"i{k}": {"name": text(1, 7), "brand": text(0, 2), "description": text(0, 9)} for k in range(n)}
    queries = {f"q{k}": text(1, 4) for k in range(20)} | {"q90": "w0 w0 w1", "q91": "unknown", "q92": "  ", "q93": "w3 unknown"}
    return items, queries


def frames(spark, items, queries):
    p = spark.createDataFrame([(i, r["name"], r["brand"], r["description"]) for i, r in items.items()], "id string, name string, brand string, description string")
    return p, spark.createDataFrame(list(queries.items()), "material_id string, query string")


@pytest.mark.parametrize("shard, k", [(7, 5), (50, 3), (4096, 1000)])
def test_search_equals_all_pairs(spark, shard, k):
    items, queries = catalogue()
    p, q = frames(spark, items, queries)
    posted = candidates.posted_of(p, candidates.fields_of(p, candidates.wanted_fields(CLAUSES)), candidates.phrased_fields(CLAUSES))
    found = candidates.search_posted(posted, q, CLAUSES, k, shard=shard)
    got = sorted((r["material_id"], r["price_id"], r["score"], r["rank"]) for r in retrieval.ranked(found, k).collect())
    want = plain_search(items, queries, CLAUSES, k)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))


def test_lists_stop_when_no_new_document_can_enter(spark):
    """Rows that leave the shards, and documents completed in them, are fewer than the pairs that share a word."""
    items, queries = catalogue(600, 3)
    queries = {q: t for q, t in queries.items() if len(t.split()) > 2}
    for i in range(5):
        items[f"best{i}"] = {"name": "w13 w12 w11 w10", "brand": "", "description": ""}
    queries["rare"] = "w13 w12 w11 w10 w0 w1 w2 w3 w4 w5"
    p, q = frames(spark, items, queries)
    clauses = (Clause({"name": 1.0}),)
    posted = candidates.posted_of(p, candidates.fields_of(p, ["name"]))
    rows = candidates.search_posted(posted, q, clauses, 3).collect()
    share = sum(bool(set(words(t)) & set(words(r["name"]))) for t in queries.values() for r in items.values())
    assert len(rows) == 3 * len(queries) < 0.1 * share
    met = sum(bool(set(words(queries["rare"])) & set(words(r["name"]))) for r in items.values())
    assert {r["scored"] for r in rows if r["material_id"] == "rare"} < set(range(met))


def test_empty_sides(spark):
    items, queries = catalogue(5)
    p, q = frames(spark, items, queries)
    assert candidates.search(p.limit(0), q).count() == 0 and candidates.search(p, q.limit(0)).count() == 0
    p = p.withColumn("article", F.lit(None).cast("string"))
    assert candidates.keyword_topk(q, p.limit(0), 3).count() == 0 and candidates.keyword_topk(q.limit(0), p, 3).count() == 0


def plain_keyword(items, queries):
    out = {}
    for m, text in queries.items():
        q, ws = text.lower(), words(text)
        for i, r in items.items():
            n, b, a, d = (r[c].lower() for c in ("name", "brand", "article", "description"))
            if not ws:
                continue
            score = 10 if q in n else 9 if q in d else 8 if q in b or q in a else 0
            matched = 0.0
            for w in ws:
                if len(w) > 2:
                    p = 5 if w in n.split() else 3 if w in b.split() else 2 if len(w) >= 4 and any(len(u) >= 4 and (w in u or u in w) for u in n.split()) else 0
                    score += p + (4 if w in a else 0)
                    matched += 1 if p >= 3 else 0.5 if p == 2 else 0
            score += 3 if len(ws) > 1 and matched >= 0.7 * len(ws) else 0
            if score >= 1:
                out[m, i] = float(score)
    return out


@pytest.mark.parametrize("shard, k", [(6, 4), (4096, 10_000)])
def test_keyword_rule_equals_all_pairs(spark, shard, k):
    r = random.Random(5)
    pieces = ["cab", "cable", "cables", "lamp", "lamps", "led", "x1", "ab-12", "ab-1", "box", "boxed", "on"]
    text = lambda lo, hi: " ".join(r.choices(pieces, k=r.randint(lo, hi)))
    items = {f"i{j}": {"name": text(1, 5), "brand": text(0, 2), "article": text(0, 2), "description": text(0, 6)} for j in range(60)}
    queries = {f"q{j}": text(1, 4) for j in range(25)} | {"q99": "", "q98": "ab le"}
    p = spark.createDataFrame([(i, x["name"], x["brand"], x["article"], x["description"]) for i, x in items.items()], "id string, name string, brand string, article string, description string")
    q = spark.createDataFrame(list(queries.items()), "material_id string, query string")
    every = plain_keyword(items, queries)
    assert {(x["material_id"], x["price_id"]): x["score"] for x in candidates.keyword_scores(q, p).collect()} == every
    want = []
    for m in queries:
        best = sorted(((i, s) for (y, i), s in every.items() if y == m), key=lambda x: (-x[1], x[0]))[:k]
        want += [(m, i, s, n) for n, (i, s) in enumerate(best, 1)]
    assert sorted((x["material_id"], x["price_id"], x["score"], x["rank"]) for x in candidates.keyword_topk(q, p, k, shard).collect()) == sorted(want)


def test_shared_words_are_counted():
    assert similarity.numbered(1, list("abab")) == [(1, "a", 1), (1, "b", 1), (1, "a", 2), (1, "b", 2)]


@pytest.mark.parametrize("threshold, part", [(55, 2048), (70, 5), (80, 2048), (90, 4), (100, 2048)])
def test_similarity_join_equals_all_pairs(spark, threshold, part):
    r = random.Random(threshold)
    word = lambda: "".join(r.choices("abcdeа", k=r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(1, 5))) for _ in range(30)]

    def vary(s):
        s = list(s)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(s) + 1)
            if r.random() < 0.5 and s:
                del s[min(at, len(s) - 1)]
            else:
                s.insert(at, r.choice("abcde "))
        return "".join(s)

    left = [vary(r.choice(base)) for _ in range(60)] + ["", None, "a", "ab", base[0], base[0]]
    right = [vary(r.choice(base)) for _ in range(90)] + ["", None, "a", "ba", base[0], "x" * 300, "x" * 280]
    left += ["x" * 290]
    m, p = (spark.createDataFrame([(f"{k}", t) for k, t in enumerate(ts)], "id string, norm string") for ts in (left, right))
    got = Counter((x["material_id"], x["price_id"], x["ratio"]) for x in (similarity.similarity_join(m, p, threshold) if part == 2048 else _small_parts(m, p, threshold, part)).collect())
    pairs = [(i, j, a, b) for i, a in enumerate(left) for j, b in enumerate(right) if a and b]
    rates = similarity.ratios([x[2] for x in pairs], [x[3] for x in pairs])
    assert got == Counter((f"{i}", f"{j}", int(x)) for (i, j, _, _), x in zip(pairs, rates) if x >= threshold)


def _small_parts(m, p, threshold, part):
    pairs = similarity.text_pairs(m.select("norm"), p.select("norm"), threshold, part, 40)
    return pairs.join(m.select(F.col("id").alias("material_id"), F.col("norm").alias("a")), "a").join(p.select(F.col("id").alias("price_id"), F.col("norm").alias("b")), "b")


def test_repeated_pairs_of_a_batch_are_measured_once(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("abc", "abd"), (None, "x"), ("x", "abx")] * 5, "a string, b string").coalesce(1)
    assert [r[0] for r in rows.select(metrics.lcs_length("a", "b")).collect()] == [2, 2, 0, 1] * 5
    assert rows.limit(0).select(metrics.lcs_length("a", "b")).count() == 0
