"""Byte-level BPE, packing and token counts against the libraries and plain recounts."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import bpe, packing, registry, token_counts
from kindred.llm.registry import tokenizer_file

RANKS = tokenizer_file("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizer_file("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "  a  b\n\nc", "a\t b\x1c!\n x", " lead", "trail ", "x" * 3000, "añ🙂🙂 " * 40, "it's we'll 123 ½!!!", "a\n b", " \n ", "ΣΑΣ ὈΔΥΣ", "<|endoftext|> x<|startoftext|>", "é İ", "ab " * 9000, "a\x00b c", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n long").repartition(3)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


ENCODER = bpe.Encoder(RANKS, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_library(text):
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.bpe.ranks, special_tokens={}).encode_ordinary(text)
    n, ids = ENCODER.encode(pa.array(["a b", text, None]))
    assert ids[n[0] : n[0] + n[1]].tolist() == want and n[2] == 0 and ENCODER.decode(ids)[1].tobytes() == b"a b" + text.encode()


def test_long_words_take_the_scalar_tree(reference):
    words = [("abc" * n)[: 65 + n].encode() for n in (30, 700)] + [b"", b"the", b"unthinkably"]
    n, ids = ENCODER.bpe.encode_words(words)
    for w, a, b in zip(words, np.cumsum(n) - n, np.cumsum(n)):
        assert ids[a:b].tolist() == reference.encode_ordinary(w.decode())


def test_round_trip(docs, reference):
    out = {r["doc_id"]: r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for k, t in enumerate(TEXTS):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert out[k]["n_tokens"] == len(ids) and out[k]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=150), max_size=4))
def test_word_tokenizer_equals_library(texts):
    tok = packing.tokenizer(WORDS)
    n, ids = tok.encode(pa.array(texts, pa.string()))
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_word_tokenizer_odd_pieces_and_a_full_table():
    tok = packing.WordTokenizer(WORDS)
    tok.table.limit = 20
    texts = ["Don't it's 'Sabc ''s I'VE 12 3x\t4\n\ny", "<|endoftext|> ab<|endoftext|>", "\u0130stanbul \u03a3\u0391\u03a3 \u00bd \u2461", "e\u0301 \u00e9 x\xa0y x\u3000y \u6f22\u5b57", None, "", " ", "a\rb '", "'ll ab'll's", "x\x85y\x1cz", "\u037e ok", "word " * 40 + "y" * 3000]
    for _ in range(3):
        n, ids = tok.encode(pa.array(texts))
        want = [tok.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        texts = texts[3:] + [" ".join(f"word{k}" for k in range(40))]


def test_packing_is_gapless(docs):
    rows = packing.pack(docs, WORDS, window=512).collect()
    tok = Tokenizer.from_file(WORDS)
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(TEXTS)}
    for k, want in ids.items():
        pieces = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(want, "<u4").tobytes()
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["doc_tokens"] == len(want) for r in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, spans in sequences.items():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at == 512 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_rollup(spark, tmp_path):
    rows = [("s", "en", 2, 3), ("s", "en", 5, 0), (None, None, 3, 4)]
    docs = spark.createDataFrame(rows, "source string, lang string, old long, new long")
    old, new = F.col("old"), F.col("new")
    up = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert up.totals().count() == 0
    assert up.apply("1", token_counts.inserted(docs, "v", old))
    assert up.apply("2", token_counts.revised(docs, "v", old, new))
    assert not up.apply("2", token_counts.revised(docs, "v", old, new))
    total = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in up.totals().collect()}
    want = {("s", "en"): (2, 3), (None, None): (1, 4)}
    assert total() == want
    up.compact()
    assert total() == want and up.committed() == ["batch=1", "batch=2"]
    # a folded batch is still committed
    assert not up.apply("1", token_counts.inserted(docs, "v", old)) and total() == want
    assert up.apply("3", token_counts.deleted(docs.filter("source IS NULL"), "v", new))
    want.pop((None, None))
    assert total() == want
    up.compact()
    up.compact()
    assert total() == want and up.committed() == ["batch=1", "batch=2", "batch=3"]
    assert not up.apply("2", token_counts.revised(docs, "v", old, new))


def test_rollup_survives_a_crash_in_compaction(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("s", "en", 2)], "source string, lang string, n long")
    path = str(tmp_path / "r")
    up = token_counts.Rollup(spark, path)
    for k in "12":
        up.apply(k, token_counts.inserted(docs, "v", F.col("n")))

    class Crash(Exception):
        pass

    class Fs:
        """The file system, which fails at one call."""

        def __init__(self, fs, call):
            self.fs, self.call = fs, call

        def __getattr__(self, name):
            def fail(*_):
                raise Crash

            return fail if name == self.call else getattr(self.fs, name)

    for call in ("create", "rename", "delete"):
        broken = token_counts.Rollup(spark, path)
        broken.fs = Fs(broken.fs, call)
        try:
            broken.compact()
            broken.compact()
        except Crash:
            pass
        again = token_counts.Rollup(spark, path)
        assert [tuple(r)[3:] for r in again.totals().collect()] == [(2, 4)] and again.committed() == ["batch=1", "batch=2"]


def test_token_counts_equal_the_libraries(spark, sf_dir, reference):
    """The whole query, and the counting of odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    words = Tokenizer.from_file(WORDS)
    words.encode_special_tokens = False
    counters = {"byte_bpe_multi_50k": lambda t: len(reference.encode_ordinary(t)), "word_bpe_49k": lambda t: len(words.encode(t, add_special_tokens=False).ids)}
    want = {}
    for r in docs:
        for version, count in counters.items() if r["text"] else ():
            n, tokens = want.get((r["source"], r["lang"], version), (0, 0))
            want[r["source"], r["lang"], version] = (n + 1, tokens + count(r["text"]))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in registry.op1_token_counts(spark, sf_dir).collect()}
    assert got == want
    odd = spark.createDataFrame([(t, "x") for t in TEXTS], "text string, tokens string")
    made = token_counts.counted(odd.select("text"), {"w": token_counts.word_counter(WORDS), "b": token_counts.byte_counter(RANKS, P.PATTERN)})
    assert sorted((r["tokens"]["w"], r["tokens"]["b"]) for r in made.collect()) == sorted((counters["word_bpe_49k"](t or ""), counters["byte_bpe_multi_50k"](t or "")) for t in TEXTS)
