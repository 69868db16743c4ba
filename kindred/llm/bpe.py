"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each pre-token's bytes are leaves; node i holds the smallest (rank, position) of the pairs that start
in its span, so the root is the leftmost minimum pair. A merge changes one pair, removes the next and
renews the previous one: three point updates of log2(n) levels. Short pre-tokens are merged together
in numpy, one tree a row; long ones use the same tree in plain Python.

Defined results: null text encodes as "", which has no ids; repeated ids are rows of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents, slices, worker_state
from .runs import RunTable, binary, bounds, ragged

NONE = np.int64(2**62)
#: Widest row of the numpy trees; longer pre-tokens take the scalar tree.
WIDE = 64
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentTreeBPE:
    """``encode_words`` maps byte strings to id arrays exactly as rank-ordered merging does."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.vocab = {i: t for t, i in ranks.items()}
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.merged = np.array([p[1] for p in pairs] or [0], np.int64)
        self.by_pair = dict(pairs)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def _batch(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids). All words have at most ``width`` bytes; entries are rank * width + position."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        live = np.arange(width) < size[:, None]
        ids = np.where(live, self.first[flat], -1)
        spot = np.arange(width)
        nxt, prv = np.tile(spot + 1, (n, 1)), np.tile(spot - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE)
        pair = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(pair < NONE, pair * width + spot[:-1], NONE)
        for lo in (width >> k for k in range(1, width.bit_length())):
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        rows = np.nonzero(tree[:, 1] < NONE)[0]

        def put(r, at, value):
            node = at + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while len(rows):
            best = tree[rows, 1]
            at = best % width
            other = nxt[rows, at]
            after = nxt[rows, other]
            ids[rows, at] = best // width
            ids[rows, other] = -1
            nxt[rows, at] = after
            has = after < width
            prv[rows[has], after[has]] = at[has]
            put(rows, other, NONE)
            right = np.where(has, ids[rows, np.minimum(after, width - 1)], -1)
            pair = self._rank(ids[rows, at], right)
            put(rows, at, np.where(pair < NONE, pair * width + at, NONE))
            before = prv[rows, at]
            has = before >= 0
            if has.any():
                r, b = rows[has], before[has]
                pair = self._rank(ids[r, b], ids[r, at[has]])
                put(r, b, np.where(pair < NONE, pair * width + b, NONE))
            rows = rows[tree[rows, 1] < NONE]
        keep = ids >= 0
        return keep.sum(1), ids[keep].astype("<u4")

    def _long(self, word: bytes) -> np.ndarray:
        if not word:
            return np.zeros(0, "<u4")
        n, none = len(word), (1 << 62, 0)
        width = 1 << (n - 1).bit_length()
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.by_pair.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[width + i] = (r, i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i, value):
            i += width
            tree[i] = value
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while tree[1] is not none and tree[1][0] < none[0]:
            rank, at = tree[1]
            other = nxt[at]
            after = nxt[other]
            ids[at], ids[other], nxt[at] = rank, -1, after
            put(other, none)
            r = None
            if after < n:
                prv[after] = at
                r = get(rank << 32 | ids[after])
            put(at, none if r is None else (r, at))
            b = prv[at]
            if b >= 0:
                r = get(ids[b] << 32 | rank)
                put(b, none if r is None else (r, b))
        return np.array([i for i in ids if i >= 0], "<u4")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            # 0: one id; 1: the scalar tree; else the width of a numpy tree
            width = 0 if w in self.ranks else 1 if len(w) > WIDE or not w else max(4, 1 << (len(w) - 1).bit_length())
            groups.setdefault(width, []).append(k)
        place, sizes, ids = [], [], []
        for width, at in groups.items():
            for lo in range(0, len(at), 20_000):
                part = at[lo : lo + 20_000]
                if width > 1:
                    size, coded = self._batch([words[k] for k in part], width)
                elif width:
                    runs = [self._long(words[k]) for k in part]
                    size, coded = np.fromiter(map(len, runs), np.int64, len(runs)), np.concatenate(runs)
                else:
                    size, coded = np.ones(len(part), np.int64), np.array([self.ranks[words[k]] for k in part], "<u4")
                place.append(part)
                sizes.append(size)
                ids.append(coded)
        if not place:
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        order, size = np.argsort(np.concatenate(place)), np.concatenate(sizes)
        return size[order], np.concatenate(ids)[ragged((np.cumsum(size) - size)[order], size[order])]


class Encoder:
    """Columns of whole texts to 32-bit ids and back. A text is cut at blanks, and only the column's distinct
    chunks are looked at: no match of the pattern crosses from a non-blank to a blank, so each chunk with
    the blanks before it stands alone."""

    #: Texts that are not words with single blanks or line ends between them.
    UNEVEN = r"^$|^[ \n]|[ \n][ \n]|[ \n]\z|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, ranks_path: str, pattern: str, limit: int = 500_000):
        import regex

        self.bpe = SegmentTreeBPE(read_ranks(ranks_path))
        self.pattern = regex.compile(pattern)
        self.chunks, self.words = RunTable("<u4", limit), RunTable("<u4", limit * 3 // 5)
        top = max(self.bpe.vocab) + 1
        self.bytes = np.frombuffer(b"".join(self.bpe.vocab.get(i, b"") for i in range(top)), np.uint8)
        self.byte_count = np.array([len(self.bpe.vocab.get(i, b"")) for i in range(top)], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A key that starts with a letter or sign stands for that chunk after one space."""
        split = [self.pattern.findall(c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c) for c in keys]
        index: dict[str, int] = {}
        which = np.array([index.setdefault(w, len(index)) for ws in split for w in ws], np.int64)
        self.words.room()
        spot = self.words.find(list(index), np.bincount(which, minlength=len(index)), lambda ws: self.bpe.encode_words([w.encode("utf-8", "replace") for w in ws]))
        size, ids = self.words.gather(spot[which])
        return np.diff(bounds(size)[bounds(np.fromiter(map(len, split), np.int64, len(split)))]), ids

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of an uneven text's chunks; a leading NUL marks one that is taken literally."""
        if not text:
            return []
        if ODD_SPACE.search(text) or "\0" in text:
            return ["\0" + text]
        return ["\0" + c for c in CHUNK.findall(text)]

    def _keys(self, texts: pa.Array) -> pa.ListArray:
        uneven = np.asarray(pc.match_substring_regex(texts, self.UNEVEN))
        at = np.flatnonzero(uneven)
        even = texts.filter(pa.array(~uneven)) if len(at) else texts
        keys = pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(even, "\n", " \n"), ""), " ")
        if not len(at):
            return keys
        rest = pa.array([self.cut(t) for t in texts.take(pa.array(at)).to_pylist()], pa.list_(pa.string()))
        place = np.argsort(np.concatenate((np.flatnonzero(~uneven), at)), kind="stable")
        return pa.concat_arrays([keys, rest]).take(pa.array(place))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of all chunks, where each text's chunks start and end)."""
        self.chunks.room()
        keys = self._keys(pc.fill_null(texts, ""))
        chunks = keys.flatten().dictionary_encode()
        which = np.asarray(chunks.indices)
        spot = self.chunks.find(chunks.dictionary.to_pylist(), np.bincount(which, minlength=len(chunks.dictionary)), self._learn)
        return spot[which], bounds(np.asarray(pc.list_value_length(keys)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids); null is the empty text."""
        spot, ends = self._cut(texts)
        sizes, ids = self.chunks.gather(spot)
        return np.diff(bounds(sizes)[ends]), ids

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        spot, ends = self._cut(texts)
        return np.diff(bounds(self.chunks.size[spot])[ends])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each id, all bytes)."""
        size = self.byte_count[ids]
        return size, self.bytes[ragged(self.byte_start[ids], size)]


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder a worker process, so its memo serves later tasks too."""
    return worker_state(("bytes", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))


def _map(df: DataFrame, ranks_path: str, pattern: str, columns: Callable[[Encoder, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """doc_id and the columns made from (number of ids, all ids) of a slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | columns(enc, *enc.encode(part.column(1))))

    return documents(df).mapInArrow(run, "doc_id long, " + schema)


def encode_documents(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) for every row."""
    return _map(df, ranks_path, pattern, lambda enc, n, ids: {"ids": binary(n, ids)}, "ids binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and digest both."""

    def digests(enc: Encoder, n: np.ndarray, ids: np.ndarray) -> dict:
        ends = bounds(n)
        size, text = enc.decode(ids)
        parts = lambda data, at: pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": parts(ids, ends), "decoded_sha256": parts(text, bounds(size)[ends])}

    return _map(df, ranks_path, pattern, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
