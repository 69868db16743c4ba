"""Concatenate and cut: documents end to end in one token stream, cut into fixed windows.

Pass 1 tokenizes and writes (partition, tokens before, ids) to the shared folder; "tokens before" is
the running sum inside the partition. The running sum over the partitions' totals (one row a task)
gives each partition's global offset, so pass 2 knows every document's place. Windows are then cut by arithmetic; a document that crosses a
window's edge gets one boundary record (piece) on either side. Only the last window can be short.

Defined results: null text is the empty text, whose only token is the end id; repeated ids are
separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices, worker_state
from .runs import RunTable, binary, bounds, ragged

WINDOW = 4096
PIECE = ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordTokenizer:
    """ids of the tokenizer file, a column at once. Its pattern drops blanks and never spans them, so the
    column is cut at blanks and only its distinct pieces are looked at; these are cut into the pattern's
    matches, and the distinct ones that were never seen are encoded as one blank-separated text, whose ids
    fall apart at the tokens that end a word. Pieces that the tokenizer's normalizer might treat otherwise
    (special tokens, control characters, not in NFC, letters with context-dependent lower case or outside
    the long-settled blocks of Unicode) are encoded alone."""

    #: In what is left every text is in NFC.
    ODD = r"<\||[\x{3a3}\x{130}\x{374}\x{37e}\x{387}\x00-\x1f\x7f-\x{a0}]|[^\x00-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}]"
    #: The one pattern whose matches the expression below finds in pieces without odd characters.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 65536 else "<u4"
        self.width = int(self.dtype[2])
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        splits = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = bool(suffix) and len(splits) == 1 and splits[0]["invert"] and splits[0]["pattern"].get("Regex") == self.PATTERN
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix or "\0") for i in range(size)])
        self.table = RunTable(self.dtype, limit)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(map(len, coded), np.int64, len(coded)), np.array([i for c in coded for i in c], self.dtype)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, coded = [], []
        for lo in range(0, len(words), 500):
            part = words[lo : lo + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            size = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(size) != len(part):
                size, ids = self._alone(part)
            sizes.append(size)
            coded.append(ids)
        return np.concatenate(sizes), np.concatenate(coded)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, ids) of each distinct piece."""
        odd = np.asarray(pc.match_substring_regex(pieces, self.ODD))
        split = pc.utf8_lower(pc.if_else(pa.array(odd), "", pieces) if odd.any() else pieces).dictionary_encode()
        # "don't..." to "don 't ...": the matches with a blank after each
        words = pc.replace_substring_regex(split.dictionary, pattern=self.PATTERN, replacement=r"\0 ")
        words = pc.split_pattern(pc.utf8_rtrim(words, " "), " ")
        distinct = words.values.dictionary_encode()
        which = np.asarray(distinct.indices)
        spot = self.table.find(distinct.dictionary.to_pylist(), np.bincount(which, minlength=len(distinct.dictionary)), self._learn)
        sizes, ids = self.table.gather(spot[which])
        ends = bounds(sizes)[np.asarray(words.offsets)]
        which = np.asarray(split.indices)
        first, size = ends[:-1][which], np.diff(ends)[which]
        if odd.any():
            at = np.flatnonzero(odd)
            size[at], more = self._alone(pieces.take(pa.array(at)).to_pylist())
            first[at] = len(ids) + np.cumsum(size[at]) - size[at]
            ids = np.concatenate((ids, more))
        return first, size, ids

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first id and number of ids of each piece, where each text's pieces start and end, ids)."""
        self.table.room()
        for blank in "\t\r\n":
            texts = pc.replace_substring(texts, blank, " ")
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        pieces = cut.values.dictionary_encode()
        first, size, ids = self._pieces(pieces.dictionary)
        which = np.asarray(pieces.indices)
        return first[which], size[which], np.asarray(cut.offsets), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids); null is the empty text."""
        if not self.by_word:
            return self._alone([t or "" for t in texts.to_pylist()])
        first, size, ends, ids = self._cut(texts)
        return np.diff(bounds(size)[ends]), ids[ragged(first, size)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return self.encode(texts)[0]
        _, size, ends, _ = self._cut(texts)
        return np.diff(bounds(size)[ends])


def tokenizer(path: str) -> WordTokenizer:
    return worker_state(("words", path), lambda: WordTokenizer(path))


def tokenizer(path: str) -> WordTokenizer:
    return worker_state(("words", path), lambda: WordTokenizer(path))


def binary(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Runs of ``sizes`` values each as a binary column."""
    ends = np.append(0, np.cumsum(sizes)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def tokenize(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, before, doc_id, n, ids for every row; the end id closes each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, before = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, 6 << 20, 10_000):
                n, ids = tok.encode(rows.column(1))
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(n), part, np.int32)),
                        "before": pa.array(before + np.cumsum(n) - n),
                        "doc_id": rows.column(0),
                        "n": pa.array(n),
                        "ids": binary(n, ids),
                    }
                )
                before += int(n.sum())

    return documents(df).mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def cut(base: int, n: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of n tokens from global offset base."""
    out, done = [], 0
    while done < n:
        seq, off = divmod(base + done, window)
        take = min(n - done, window - off)
        out.append((done, take, seq, off))
        done += take
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32,
    doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    coded = materialize(tokenize(df, tokenizer_path, end_id), "pack")
    totals = coded.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).orderBy("part").collect()
    bases, at = [], 0
    for r in totals:  # one row a task of pass 1: grows with tasks, not with documents
        bases.append((r["part"], at))
        at += r["total"]
    placed = coded.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    placed = placed.select("doc_id", "n", (F.col("base") + F.col("before")).alias("base"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                out: list[tuple] = []
                for doc, n, base, ids in zip(*(c.to_pylist() for c in rows.columns)):
                    wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                    for start, length, seq, off in cut(base, n, window):
                        piece = wide[4 * start : 4 * (start + length)]
                        out.append((doc, start, length, piece, zlib.crc32(piece), n, seq, off))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in zip(PIECE, zip(*out))})

    return placed.mapInArrow(run, ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in PIECE))
