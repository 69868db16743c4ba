"""Quality, toxicity and language: held-out accuracy, and rows that must not break a scorer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lang_id, quality, toxicity
from kindred.llm.common import LETTERS, fold, letter_runs

ODD = [(1, None, "x"), (2, "", "x"), (3, "   \n\t ", "x"), (4, "!!! ??? 123", "x"), (5, "word " * 30_000, "x"), (5, "word " * 30_000, "x"), (6, "ä𝄞 \u0000 ﬁ", None)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = ["river", "stone", "light", "garden", "window", "paper", "music", "winter"]
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(words, 30)) + "."
        low, toxic = k % 4 == 0, k % 5 == 0
        if toxic:
            text = text.replace("stone", ["grubnak", "grubnaks", "grubnakked", "grubnakish"][k % 4])
        if low:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((k, text, int(not low), int(toxic), "en"))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int, lang string")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1.0) for i, t, _ in ODD], "doc_id long, text string, source string, score double")


def accuracy(scores, docs, label):
    rows = scores.join(docs.select("doc_id", label), "doc_id").select("score", label).collect()
    return np.mean([(r[0] >= 0.5) == bool(r[1]) for r in rows])


def test_quality(docs, odd):
    model = quality.fit(docs, docs.filter(fold("doc_id", 5) != 0), features=64)
    held = docs.filter(fold("doc_id", 5) == 0)
    assert accuracy(quality.score(held, model), docs, "quality") > 0.95
    out = quality.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 5}) == 1


def test_quality_without_labels(docs):
    model = quality.fit(docs, docs.limit(0), features=16)
    assert {r["score"] for r in quality.score(docs.limit(5), model).collect()} == {0.5}


def test_quality_equals_a_direct_solution(docs):
    """Partition sums against one least-squares problem over all training rows; the score against the formula."""
    model = quality.fit(docs.repartition(7), docs, features=32, ridge=1e-3)
    rows = docs.select("text", "quality").collect()
    x, y = np.stack([quality.stats(r["text"]) for r in rows]), np.array([r["quality"] for r in rows], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3))
    z = np.hstack([np.cos(np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -6, 6) @ model.omega + model.phase) * np.sqrt(2 / 32), np.ones((len(x), 1))])
    penalty = np.sqrt(1e-3 * len(x) * 0.1) * np.eye(33)
    direct = np.linalg.lstsq(np.vstack([z, penalty]), np.append(y, np.zeros(33)), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ direct, atol=1e-6)
    assert np.allclose(model.score_texts([r["text"] for r in rows]), np.interp(z @ direct, model.knots, model.values), atol=1e-6)


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        y, w = rng.random(n), rng.integers(1, 5, n).astype(float)
        x, v = quality.isotonic(np.arange(n, dtype=float), y, w)
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.round(v, 9))


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 0.5, 0.2, 0.9, 0.8, 1.0]), np.ones(6))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and np.isclose(y[1], 0.35)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    gamma, d = 0.05, 20_000
    omega = rng.normal(0, np.sqrt(2 * gamma), (quality.N_STATS, d))
    m = quality.QualityModel(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), omega, rng.uniform(0, 2 * np.pi, d), np.zeros(d + 1), np.zeros(1), np.zeros(1))
    x = rng.normal(0, 1, (4, quality.N_STATS))
    z = m.features(x)[:, :-1]
    assert np.allclose(z @ z.T, np.exp(-gamma * ((x[:, None] - x) ** 2).sum(2)), atol=0.03)


def test_toxicity(docs, odd):
    train = docs.filter(fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, train, per_class=300)
    held = docs.filter(fold("doc_id", 4) == 2)
    assert accuracy(toxicity.score(held, model), docs, "toxic") > 0.9
    # a form that was never seen shares n-grams with those that were
    seen, unseen, clean = model.score(["river grubnak light", "river grubnakker light", "river garden light"])
    assert unseen > clean and seen > clean
    out = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert len(out) == 6 and out[1] == out[2] == out[3] == out[4]


def test_toxicity_equals_a_plain_forward_pass(docs):
    model = toxicity.fit(docs, docs, per_class=50)
    texts = ["river grubnak\tLight!light", "stone", "12 ?", None, "\u00e4ther " * 300, "a-b c'd"]

    def plain(t):
        words = LETTERS.findall((t or "").lower())
        bag = [model.table[toxicity.subwords(w, len(model.table))].mean(0) for w in words]
        logit = (np.mean(bag, 0) @ model.softmax if bag else 0) + model.bias
        return (np.exp(logit) / np.exp(logit).sum())[1]

    assert np.allclose(model.score(texts + texts), [plain(t) for t in texts + texts], atol=1e-5)


def test_toxicity_sample_is_bounded(spark):
    """A hot id gives one text; texts are taken in one order until their bytes are spent."""
    rows = [(1, "same")] * 500 + [(k, f"text {k}") for k in range(2, 30)] + [(40, "x" * 5000), (41, None), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, y int")
    taken = toxicity.sample(docs, marks, 10, 1000)
    assert len(taken) <= 20 and len(set(taken)) == len(taken) and sum(len(t) for _, _, t in taken) <= 1000
    whole = toxicity.sample(docs, marks, 1000, 1 << 20)
    assert len(whole) == 31 and all(y == d % 2 for d, y, _ in whole) and whole == toxicity.sample(docs.repartition(5), marks, 1000, 1 << 20)


def test_toxicity_without_labels(docs):
    model = toxicity.fit(docs, docs.limit(0))
    assert all(0 <= s <= 1 for s in model.score(["anything", ""]))


def test_language(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de"), ("la maison et le jardin", "fr")] * 8)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = model.predict(["the tree", "baumhaus", "les jardins", None, "", "123 !?", "ж"])
    assert names[:3] == ["en", "de", "fr"] and names[3:6] == ["und"] * 3 and scores[3:6] == [0.0] * 3
    assert names[6] in {"en", "de", "fr"} and all(0 <= s <= 1 for s in scores)


def test_language_odd_rows(spark, odd):
    model = lang_id.fit(spark.createDataFrame([(1, "x", None), (2, None, "en")], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in lang_id.predict(odd, model).collect()} == {"und"}
    assert lang_id.predict(odd.limit(0), model).count() == 0


def test_letter_runs_are_the_matches():
    rng = np.random.default_rng(2)
    pool = list("aZ\u00e9\u0436\u6f22\u0301\u0903\u00bd\u2461_7'-.,\u02b0\u2019 \U0001d11e\u16ee")
    for _ in range(3000):
        chunk = "".join(rng.choice(pool, rng.integers(0, 7)))
        assert letter_runs(chunk) == LETTERS.findall(chunk), ascii(chunk)


def test_language_equals_a_plain_backoff(spark):
    """Word log frequencies, then the longest known n-grams' mean, from plain dictionaries."""
    rng = np.random.default_rng(8)
    syllables = {"en": ["the", "ing", "er", "wh"], "de": ["sch", "ung", "er", "ein"], "fi": ["kk", "aa", "in", "la"]}
    made = lambda lang: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(12))
    rows = [(k, made(lang), lang) for k, lang in enumerate(["en", "de", "fi"] * 10)]
    asked = [made("en"), made("fi") + " \u00bd 12", "zzz einkk", "\u2461 \u00bd", None, "\u0436", "x" * 40]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=4, max_grams=9)
    words, grams, langs = {}, {}, sorted(syllables)
    for _, t, lang in rows:
        for w in t.split():
            words.setdefault(w, dict.fromkeys(langs, 0))[lang] += 1
    for w, n in words.items():
        for k in lang_id.ORDERS:
            for g in lang_id.grams(w, k):
                for lang in langs:
                    grams.setdefault(g, dict.fromkeys(langs, 0))[lang] += n[lang]
    mass = {k: {lang: 1 + sum(n[lang] for g, n in grams.items() if len(g) == k) for lang in langs} for k in lang_id.ORDERS}
    total = {lang: sum(n[lang] for n in words.values()) for lang in langs}

    def one(w, lang):
        if w in words:
            return np.log((words[w][lang] + 0.5) / (total[lang] + 1))
        for k in lang_id.ORDERS:
            known = [g for g in lang_id.grams(w, k) if g in grams]
            if known:
                return np.mean([np.log((grams[g][lang] + 0.5) / mass[k][lang]) for g in known])
        return 0.0

    names, scores = model.predict(asked)
    for text, name, score in zip(asked, names, scores):
        found = LETTERS.findall((text or "").lower())
        logs = np.array([sum(one(w, lang) for w in found) + np.log(total[lang] / sum(total.values())) for lang in langs])
        if not found:
            assert (name, score) == ("und", 0.0)
        else:
            assert name == langs[int(np.argmax(logs))] and np.isclose(score, 1 / np.exp(logs - logs.max()).sum())


def test_counts_cover_all_documents(spark):
    rows = [(k, "one two two", "en") for k in range(50)]
    counts = {r["word"]: r["n"] for r in lang_id.count_words(spark.createDataFrame(rows, "i int, text string, lang string").select("lang", "text")).collect()}
    assert counts == {"one": 50, "two": 100}
    grams = lang_id.count_grams(spark.createDataFrame([("en", "ab", 3)], "lang string, word string, n long"))
    assert grams.filter(F.col("gram") == "^ab$").first()["n"] == 3


def test_language_bounds_only_affect_speed(spark):
    """A rare language and rare words count in full, whatever is broadcast."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(rng.choice(["river", "stone", "light", "garden"], 20)), "en") for k in range(60)]
    rows += [(100 + k, f"kivi vala{k} puutarha{k} joki", "fi") for k in range(3)] + [(200 + k, f"sten ljus{k} tradgard{k}", "sv") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = ["kivi vala1", "puutarhassa joki", "ljus2 tradgarden", "sten", "river ljus", None, "", "12 !", "zzz", "kivi kivi sten zzz river"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.createDataFrame([(1, texts[1])], "doc_id long, text string"))
    whole, cut = (sorted(tuple(r) for r in lang_id.predict(asked, lang_id.fit(df, **kept)).collect()) for kept in ({}, {"max_words": 3, "max_grams": 4}))
    assert [r[:2] for r in cut] == [r[:2] for r in whole] and np.allclose([r[2] for r in cut], [r[2] for r in whole])
    names = dict(r[:2] for r in cut)
    assert len(cut) == len(texts) + 1 and names[0] == names[1] == "fi" and names[2] == names[3] == "sv" and names[5] == names[6] == names[7] == "und"


def test_toxicity_reads_whole_runs(docs):
    model = toxicity.fit(docs, docs, per_class=300)
    clean, toxic = model.score(["river" * 40 + "window", "river" * 40 + "grubnak" * 6])
    assert toxic > clean
    assert set(toxicity.subwords("x" * 100 + "end", 1 << 17)) != set(toxicity.subwords("x" * 100 + "dne", 1 << 17))


def test_language_reads_whole_runs(spark):
    shared = "ab" * 32
    rows = [(1, shared + "house", "en"), (2, shared + "maison", "fr")] * 3
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # the words themselves, and words never seen that differ late
    assert model.predict([shared + "house", shared + "maison", shared + "xhouse", shared + "xmaison"])[0] == ["en", "fr", "en", "fr"]


def test_grams_of_long_runs_in_parts(spark):
    """Parts of 10,000 letters give the same counts as the whole run."""
    word = "".join(np.random.default_rng(3).choice(list("abcdefgh"), 30_000))
    for w in (word, word[:20_000], word[:20_001]):
        got = {r["gram"]: r["n"] for r in lang_id.count_grams(spark.createDataFrame([("en", w, 2)], "lang string, word string, n long")).collect()}
        want = {}
        for k in lang_id.ORDERS:
            for g in lang_id.grams(w, k):
                want[g] = want.get(g, 0) + 2
        assert got == want
