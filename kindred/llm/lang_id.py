"""Language identification by word-first backoff.

Training counts words by language over every labelled document. A known word scores its smoothed
per-language log frequency; an unknown one backs off to its character n-grams of order 5, and to 4, 3,
2 and 1 as long as none of the longer ones is known; a word none of whose n-grams is known adds nothing. A
document's log score by language is the sum over its words and the prior, and ``score`` the posterior of
the best language. Sums of joined words may differ in their last bit between equal texts.

All counted words and n-grams take part: the counts stay in tables. Only the ``max_words`` most frequent
words and ``max_grams`` most frequent n-grams are broadcast, to score the bulk of the words in place; the
others are joined with the tables, once a distinct word, so the bounds change speed and not results.

Defined results: null text or text without a letter is ``und`` with score 0; rows with null language
teach nothing; an empty training set gives ``und`` everywhere; languages tie to the smaller name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, letter_runs, map_rows, materialize

ORDERS = (5, 4, 3, 2, 1)
FLUSH = 400_000
LONG = 10_000


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return grams_of(w, n)


def grams_of(w: str, n: int) -> list[str]:
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def count_words(df: DataFrame) -> DataFrame:
    """lang, word, n: counted in each task (flushed when large), then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, Counter] = {}

        def flush():
            out: Counter = Counter()
            for lang, c in chunks.items():
                for chunk, n in c.items():
                    for w in letter_runs(chunk):
                        out[lang, w] += n
            chunks.clear()
            keys = list(out)
            return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(out.values(), pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks.setdefault(lang, Counter()).update(text.lower().split())
                if sum(map(len, chunks.values())) > FLUSH:
                    yield flush()
        yield flush()

    part = df.mapInArrow(run, "lang string, word string, n long")
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """lang, gram, n from the distinct words, weighted by their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, dict[str, int]] = {}

        def flush():
            langs = [lang for lang, m in out.items() for _ in m]
            made = pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "gram": pa.array([g for m in out.values() for g in m], pa.string()), "n": pa.array([n for m in out.values() for n in m.values()], pa.int64())})
            out.clear()
            return made

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                mine = out.setdefault(lang, {})
                if len(word) > LONG:  # a run of letters as long as a text: in parts that overlap
                    for k in ORDERS:
                        for lo in range(0, len(word), LONG):
                            # the marks stand at both ends of the word only
                            head, tail = "^" if k > 1 and not lo else "", "$" if k > 1 and lo + LONG >= len(word) else ""
                            for g in grams_of(head + word[lo - (k - 1 if lo else 0) : lo + LONG] + tail, k):
                                mine[g] = mine.get(g, 0) + n
                            if len(mine) > FLUSH:
                                yield flush()
                                mine = out.setdefault(lang, {})
                    continue
                w, get = f"^{word}$", mine.get
                for g in [w[i : i + k] for k in ORDERS[:-1] for i in range(len(w) - k + 1)]:
                    mine[g] = get(g, 0) + n
                for g in word:
                    mine[g] = get(g, 0) + n
                if len(mine) > FLUSH:
                    yield flush()
        yield flush()

    part = words.mapInArrow(run, "lang string, gram string, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Cached:
    """Log frequencies by language of the most frequent words and n-grams: an index and a matrix of each.
    What is not in it is asked of the count tables, so its size only affects speed."""

    def __init__(self, words: tuple[list[str], np.ndarray], grams_: tuple[list[str], np.ndarray]):
        self.word_names, self.word_logs = words
        self.gram_names, self.gram_logs = grams_
        self._index()

    def _index(self) -> None:
        self.words = {w: k for k, w in enumerate(self.word_names)}
        self.grams = {g: k for k, g in enumerate(self.gram_names)}
        self.rows = np.zeros((1024, self.word_logs.shape[1] + 1))
        self.opens = np.zeros(1024, bool)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.left: dict[int, list[str]] = {}
        self.used = self.held = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "grams", "memo", "rows", "opens", "left", "used", "held")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def learn(self, chunks: list[str]) -> None:
        """Memo rows: each chunk's summed log frequencies and its words; ``left`` has the words that are not cached."""
        split = [letter_runs(c) for c in chunks]
        flat = list({w for ws in split for w in ws})
        index = {w: k for k, w in enumerate(flat)}
        spot = np.fromiter((self.words.get(w, -1) for w in flat), np.int64, len(flat))
        table = np.zeros((len(flat), self.rows.shape[1]))
        table[spot >= 0, :-1] = self.word_logs[spot[spot >= 0]]
        table[:, -1] = 1
        open_ = {flat[k] for k in np.flatnonzero(spot < 0)}
        size = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.zeros((len(chunks), self.rows.shape[1]))
        if len(flat):
            at = np.fromiter((index[w] for ws in split for w in ws), np.int64, size.sum())
            some = np.flatnonzero(size)
            rows[some] = np.add.reduceat(table[at], (np.cumsum(size) - size)[some])
        base = self.used
        while base + len(chunks) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.opens = np.concatenate((self.opens, np.zeros_like(self.opens)))
        self.rows[base : base + len(chunks)] = rows
        self.opens[base : base + len(chunks)] = False
        self.memo.update(zip(chunks, range(base, base + len(chunks))))
        self.used += len(chunks)
        self.held += sum(map(len, chunks))
        if open_:
            for k, ws in enumerate(split):
                if not open_.isdisjoint(ws):
                    self.left[base + k] = [w for w in ws if w in open_]
                    self.opens[base + k] = True

    def partial(self, texts: list) -> dict:
        """Of each text: its words, the summed logs of the cached ones, and the others with their counts."""
        if self.used > 300_000 or self.held > 16_000_000:
            self._forget()
        memo = self.memo
        words, sums, left, times = [], [], [], []
        cut = [(t or "").lower().split() for t in texts]
        self.learn(list({c for cs in cut for c in cs if c not in memo}))
        for cs in cut:
            at = np.fromiter(map(memo.__getitem__, cs), np.int64, len(cs))
            total = self.rows[at].sum(0)
            more = Counter(w for k in at[self.opens[at]].tolist() for w in self.left[k])
            words.append(int(total[-1]))
            sums.append(total[:-1].tolist())
            left.append(list(more))
            times.append(list(more.values()))
        return {"words": words, "sums": sums, "left": left, "times": times}

    def backoff(self, ids: list, words: list, most: int = 200_000) -> Iterator[dict]:
        """id, level, gram, n, sums: the n-grams by which words that training never saw are scored. Cached ones of a
        level are one row without a gram; levels under the longest with a cached n-gram can't count."""
        out: dict[str, list] = {k: [] for k in ("id", "level", "gram", "n", "sums")}

        def add(*row):
            for column, x in zip(out.values(), row):
                column.append(x)

        for k, w in zip(ids, words):
            for n in ORDERS:
                seen = Counter(grams(w, n))
                known = [g for g in seen if g in self.grams]
                for g in seen.keys() - set(known):
                    add(k, n, g, seen[g], None)
                if known:
                    times = np.array([seen[g] for g in known])
                    add(k, n, None, int(times.sum()), (times @ self.gram_logs[[self.grams[g] for g in known]]).tolist())
                if len(out["id"]) > most:
                    yield {c: x.copy() for c, x in out.items()}
                    for x in out.values():
                        x.clear()
                if known:
                    break
        yield out


@dataclass
class LangModel:
    """Log frequencies by language of every counted word and n-gram (``words``, ``grams``: key, v0, v1, ...)."""

    langs: list[str]
    prior: np.ndarray
    words: DataFrame | None = None
    grams: DataFrame | None = None
    cached: Cached | None = None

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Of a few texts."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        df = self.words.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = sorted(predict(df, self).collect())
        return [r["lang_pred"] for r in rows], [r["score"] for r in rows]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 250_000, max_grams: int = 150_000) -> LangModel:
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = materialize(count_words(rows), "lang-words")
    # one row a language; a label set, not data
    totals = {r["lang"]: r["t"] for r in words.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    langs = sorted(totals)
    total = np.array([totals[x] for x in langs], float)
    if not langs:
        return LangModel(langs, total)

    def wide(counts: DataFrame, key: str) -> DataFrame:
        each = counts.groupBy(key).agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)])
        return materialize(each, f"lang-{key}")

    def logs(counts: DataFrame, key: str, mass: list) -> DataFrame:
        # add-half smoothing
        return counts.select(key, "total", *[F.log((F.col(f"n{k}") + 0.5) / m).alias(f"v{k}") for k, m in enumerate(mass)])

    def top(table: DataFrame, key: str, most: int) -> tuple[list[str], np.ndarray]:
        """The most frequent rows, by whole levels of frequency, as many levels as have at most ``most`` rows."""
        # long ones are left to the table, so that the cache is bounded in bytes
        levels = table.filter(F.length(key) <= 64).withColumn("level", F.floor(16 * F.log2("total")).cast("int"))
        # a row a level: some hundreds
        counts = sorted(((r["level"], r["n"]) for r in levels.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
        sizes = np.cumsum([n for _, n in counts])
        fits = int(np.searchsorted(sizes, most, side="right"))
        least = counts[fits - 1][0] if fits else 1 << 30
        kept = levels.filter(F.col("level") >= least).drop("total", "level").toArrow()
        return kept[key].to_pylist(), np.stack([kept[f"v{k}"].to_numpy() for k in range(len(langs))], 1)

    by_word, by_gram = wide(words, "word"), wide(count_grams(words), "gram")
    # one row an order of n-grams
    sums = {r["level"]: r for r in by_gram.groupBy(F.length("gram").alias("level")).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(langs))]).collect()}
    mass = [F.element_at(F.create_map(*[F.lit(x) for n, r in sums.items() for x in (n, float(r[f"n{k}"] + 1))]), F.length("gram")) for k in range(len(langs))]
    by_word, by_gram = logs(by_word, "word", [F.lit(t + 1) for t in total]), logs(by_gram, "gram", mass)
    cached = Cached(top(by_word, "word", max_words), top(by_gram, "gram", max_grams))
    return LangModel(langs, np.log(np.maximum(total, 1) / max(total.sum(), 1)), by_word.drop("total"), by_gram.drop("total"), cached)


def _unseen(asked: DataFrame, model: LangModel, shared) -> DataFrame:
    """id, v0, v1, ... of words (id, word): means over their known n-grams of the longest order that has any."""
    ks = range(len(model.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"id": pa.int64(), "level": pa.int32(), "gram": pa.string(), "n": pa.int64(), "sums": pa.list_(pa.float64())}
        for batch in batches:
            for cols in shared.value.backoff(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in types.items()], names=list(types))

    pieces = materialize(asked.select("id", "word").mapInArrow(run, "id long, level int, gram string, n long, sums array<double>"), "lang-backoff")
    direct = pieces.filter("gram IS NULL").select("id", "level", "n", *[F.col("sums")[k].alias(f"v{k}") for k in ks])
    joined = pieces.filter("gram IS NOT NULL").select("id", "level", "gram", "n").join(model.grams, "gram")
    joined = joined.select("id", "level", "n", *[(F.col("n") * F.col(f"v{k}")).alias(f"v{k}") for k in ks])
    level = direct.unionByName(joined).groupBy("id", "level").agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(f"v{k}") for k in ks])
    best = level.groupBy("id").agg(F.max(F.struct("level", "n", *[f"v{k}" for k in ks])).alias("b"))
    return best.select("id", *[(F.col(f"b.v{k}") / F.col("b.n")).alias(f"v{k}") for k in ks])


def predict(df: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score. Cached words are summed in place; the others of all documents are asked of
    the count tables once a distinct word."""
    if not model.langs:
        return documents(df).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    ks = range(len(model.langs))
    shared = df.sparkSession.sparkContext.broadcast(model.cached)

    def make():
        m = shared.value  # one copy a worker process, its memo with it
        return lambda ids, texts: {"doc_id": ids} | m.partial(texts)

    part = map_rows(documents(df), make, "doc_id long, words long, sums array<double>, left array<string>, times array<long>")
    part = materialize(part.withColumn("row", F.monotonically_increasing_id()), "lang-partial")
    left = part.filter(F.size("left") > 0).select("row", F.explode(F.arrays_zip("left", "times")).alias("x")).select("row", F.col("x.left").alias("word"), F.col("x.times").alias("n"))
    asked = left.select("word").distinct().join(model.words, "word", "left").withColumn("id", F.monotonically_increasing_id())
    asked = materialize(asked, "lang-asked")
    unseen = asked.filter("v0 IS NULL").select("id", "word")
    found = asked.filter("v0 IS NOT NULL").drop("id").unionByName(unseen.join(_unseen(unseen, model, shared), "id").drop("id"))
    gained = left.join(found, "word").groupBy("row").agg(*[F.sum(F.col("n") * F.col(f"v{k}")).alias(f"v{k}") for k in ks])
    scored = part.select("row", "doc_id", "words", "sums").join(gained, "row", "left")
    scored = scored.select("doc_id", "words", F.array(*[F.col("sums")[k] + F.coalesce(f"v{k}", F.lit(0.0)) + float(model.prior[k]) for k in ks]).alias("s"))
    scored = scored.withColumn("top", F.array_max("s"))
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("s", F.col("top")).cast("int"))
    return scored.select(
        "doc_id",
        F.when(F.col("words") > 0, name).otherwise("und").alias("lang_pred"),
        F.when(F.col("words") > 0, 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).otherwise(0.0).alias("score"),
    )
