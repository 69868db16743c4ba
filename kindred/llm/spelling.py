"""Spelling variants: words one edit apart, by letter-parity bitmask bands.

A word's mask has a bit for each letter (accented letters share twelve), set if the letter occurs an odd number
of times. One inserted or deleted letter flips one bit, one replaced letter two or none, so of three bands
of a near pair's masks one at least is equal. Words of an equal band are compared in blocks (``blocks``): masks
that differ in more bits, or lengths by more than one, are put aside, the others are verified letter by
letter. A pair is taken in its first equal band only. What leaves a block is a row a word: how many near
words, and the best of them.

Words are counted on the texts' UTF-8 bytes in numpy: marks of runs, a checksum and a hash by byte position over
all runs of a slice, and the distinct ones. Then a grouped sum, pre-aggregated by Spark.

Roots come by pointer jumping: a word's form has at least twice its count, so chains are short, and each round
doubles the step.

Defined results: null and empty texts have no words; a null id is taken as an empty one in ``<doc_id>:<run>``;
repeated rows count each; words of any length are compared in full; no words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal, segments
from .common import discard, documents, materialize, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = {c: c + 32 for c in range(65, 91)}
#: One of so many runs loses a code point.
MODULUS = 97
LEAST_LENGTH, LEAST_TIMES = 5, 3
_BITS = 38
BANDS = np.array([sum(1 << b for b in range(k, _BITS, 3)) for k in range(3)], np.uint64)

_U = np.uint64
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The lead byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3
_BIT = np.array([1 << (c - 97) if 97 <= c <= 122 else 1 << (26 + (c - 0xC0) % 12) if c >= 0xC0 else 0 for c in range(256)], np.uint64)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ 0xEDB88320, out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()
#: Runs of more bytes are looked at one by one.
LONG = 48


def lower(text: str) -> str:
    """Only A to Z."""
    return text.translate(_LOW)


def changed(run: str, crc: int) -> str:
    """The lower-cased run, without a code point if MODULUS divides its checksum."""
    if crc % MODULUS:
        return run
    k = crc % len(run)
    return run[:k] + run[k + 1 :]


def count_slice(ids: list, texts: pa.Array, least: int = LEAST_LENGTH) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of at least ``least`` code points, and how often they occur."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    first = offsets[:-1] - lo
    lead = data == _LEAD
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = first[first < len(data)]
    begins[inner] = letter[inner]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    inner = first[(first > 0) & (first <= len(data))] - 1
    ends[inner] = letter[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    points = size - (np.cumsum(lead, dtype=np.int32)[end - 1] - np.cumsum(lead, dtype=np.int32)[start] + lead[start]) if len(start) else size
    big = points >= least
    start, size, points = start[big], size[big], points[big]
    owner = np.searchsorted(first, start, side="right") - 1
    extra: Counter = Counter()

    def text(k: int) -> str:
        return lower(data[start[k] : start[k] + size[k]].tobytes().decode())

    before = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    for k in np.flatnonzero(size > LONG):
        w = text(k)
        extra[changed(w, zlib.crc32(w.encode(), before[owner[k]]))] += 1
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    start, size, owner = start[short], size[short], owner[short]
    low = _LOWER[data]
    crc = np.array(before, np.uint32)[owner] ^ np.uint32(0xFFFFFFFF)
    key = np.zeros(len(start), _U)
    # how many runs are longer than j
    longer = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    with np.errstate(over="ignore"):
        for j, m in enumerate(longer.tolist()):
            byte = low[start[:m] + j]
            c = crc[:m]
            crc[:m] = _CRC[(c ^ byte) & 0xFF] ^ c >> 8
            key[:m] = (key[:m] ^ byte) * _U(0x9E3779B97F4A7C15)
            key[:m] ^= key[:m] >> _U(29)
    crc ^= np.uint32(0xFFFFFFFF)
    cut = crc % MODULUS == 0
    for k in np.flatnonzero(cut):
        extra[changed(text(k), int(crc[k]))] += 1
    rest = np.flatnonzero(~cut)
    _, at, times = np.unique(key[rest], return_index=True, return_counts=True)
    at = rest[at]
    more = [(w, n) for w, n in extra.items() if len(w) >= least]
    width = size[at]
    spot = np.cumsum(width) - width
    joined = low[np.repeat(start[at] - spot, width) + np.arange(width.sum())]
    ends_ = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends_.tobytes()), pa.py_buffer(joined.tobytes()))
    return pa.concat_arrays([words, pa.array([w for w, _ in more], pa.string())]), np.concatenate((times, [n for _, n in more])).astype(np.int64)


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """word, n of the words of at least ``least`` code points that occur at least ``times`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8 << 20, 100_000):
                words, n = count_slice(part.column(0).to_pylist(), part.column(1), least)
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    part = documents(docs).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


#: Pairs looked at once.
TILE = 1 << 21
#: Longer words are verified one by one.
WIDE = 32


def letters(words: list[str]) -> np.ndarray:
    """Letters of the words, a row each, 0 behind their ends; none of words over WIDE."""
    size = np.fromiter((len(w) if len(w) <= WIDE else 0 for w in words), np.int64, len(words))
    flat = np.frombuffer("".join([w for w in words if len(w) <= WIDE]).encode("latin-1"), np.uint8)
    out = np.zeros((len(words), WIDE + 1), np.uint8)
    out[np.arange(WIDE + 1) < size[:, None]] = flat
    return out


def mask(word: str) -> int:
    return int(np.bitwise_xor.reduce(_BIT[np.frombuffer(word.encode("latin-1"), np.uint8)]))


def masks(words: list[str]) -> np.ndarray:
    out = np.bitwise_xor.reduce(_BIT[letters(words)], 1)
    for k, w in enumerate(words):
        if len(w) > WIDE:
            out[k] = mask(w)
    return out


def inserted(short: str, long: str) -> bool:
    """Whether ``long`` is ``short`` with one more letter."""
    k = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[k:] == long[k + 1 :]


def one_edit(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a and b (row numbers; a not longer, by one letter at most) differ by exactly one edit."""
    out = np.zeros(len(a), bool)
    same = size[a] == size[b]
    at = np.flatnonzero(same)
    out[at] = (m[a[at]] != m[b[at]]).sum(1) == 1
    at = np.flatnonzero(~same)
    x, y = m[a[at]], m[b[at]]
    differ = x != y
    # the inserted letter stands where they first differ; from there on the longer is one behind
    first = differ.argmax(1)
    behind = x[:, :-1] != y[:, 1:]
    out[at] = ~(behind & (np.arange(behind.shape[1]) >= first[:, None])).any(1)
    return out


def near_pairs(words: list[str], m: np.ndarray, size: np.ndarray, mask: np.ndarray, band: int, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs among the rows ``left``, or between ``left`` and ``right``, that have this band first in common."""
    one = right is None
    b_all = left if one else right
    b_all = b_all[np.argsort(size[b_all], kind="stable")]
    a_all = left[np.argsort(size[left], kind="stable")]
    a_size, b_size = size[a_all], size[b_all]
    at = 0
    while at < len(a_all):
        # rows of like length at a time, against those of a length one less, equal or one more
        stop = int(np.searchsorted(a_size, a_size[at], side="right")) if len(a_all) > 128 else len(a_all)
        lo = int(np.searchsorted(b_size, a_size[at] - 1, side="left")) if not one else at
        hi = int(np.searchsorted(b_size, a_size[stop - 1] + 1, side="right"))
        step = max(1, TILE // max(1, hi - lo))
        for k in range(at, stop, step):
            a, b = a_all[k : min(k + step, stop)], b_all[lo:hi]
            x = mask[a][:, None] ^ mask[b][None, :]
            gap = np.abs(size[a][:, None] - size[b][None, :])
            flips = np.bitwise_count(x)
            ok = ((gap == 1) & (flips == 1)) | ((gap == 0) & ((flips == 2) | (flips == 0)))
            for earlier in range(band):
                ok &= (x & BANDS[earlier]) != 0
            if one:
                ok &= np.arange(lo, hi)[None, :] > np.arange(k, k + len(a))[:, None]
            p, q = np.nonzero(ok)
            p, q = a[p], b[q]
            turn = size[p] > size[q]
            p, q = np.where(turn, q, p), np.where(turn, p, q)
            sure = one_edit(m, size, p, q)
            for k in np.flatnonzero(size[q] > WIDE):
                x, y = words[p[k]], words[q[k]]
                sure[k] = sum(c != d for c, d in zip(x, y)) == 1 if len(x) == len(y) else inserted(x, y)
            yield p[sure], q[sure]
        at = stop


def compare(table: pa.Table) -> pa.Table:
    """word, near, best_n, best_word of the words of some blocks that have near words there."""
    table = table.combine_chunks()
    words = table["word"].to_pylist()
    n, band, i, j, mine, value = (table[c].to_numpy() for c in ("n", "band", "i", "j", "mine", "value"))
    length = np.fromiter(map(len, words), np.int64, len(words))
    m, bits = letters(words), masks(words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in segments(table["block"].to_numpy(), value, band, i, j):
        one = i[at[0]] == j[at[0]]
        left, right = (at, None) if one else (at[mine[at] == i[at[0]]], at[mine[at] == j[at[0]]])
        if len(left) and (one or len(right)):
            found += near_pairs(words, m, length, bits, int(band[at[0]]), left, right)
    if not found:
        return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best_word": pa.array([], pa.string())})
    a, b = (np.concatenate(x) for x in zip(*[(np.concatenate((p, q)), np.concatenate((q, p))) for p, q in found]))
    # of each row the near word of largest n, of those the smallest
    turn = np.empty(len(words), np.int64)
    turn[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((turn[b], -n[b], a))
    who, first, count = np.unique(a[order], return_index=True, return_counts=True)
    best = b[order[first]]
    return pa.table({"word": table["word"].take(pa.array(who)), "near": pa.array(count.astype(np.int64)), "best_n": pa.array(n[best]), "best_word": table["word"].take(pa.array(best))})


def variants(docs: DataFrame, factor: int = 2, part: int = 16_384, group: int = 16_384) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word."""
    words = materialize(vocabulary(docs), "words")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1 << 20, 20_000):
                bits = masks(piece.column(0).to_pylist())
                at = pa.array(np.tile(np.arange(len(bits)), 3))
                bands = np.repeat(np.arange(3, dtype=np.int32), len(bits))
                values = (bits[None, :] & BANDS[:, None]).ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.take(at).columns, pa.array(bands), pa.array(values)], names=["word", "n", "band", "value"])

    posted = words.mapInArrow(banded, "word string, n long, band int, value long")
    dealt, used = deal(posted, ["band", "value"], "word", part, group)
    met = dealt.groupBy("grp").applyInArrow(compare, "word string, near long, best_n long, best_word string")
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best_word").alias("w"))).alias("best"))
    form = F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best.w"))
    about = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))
    about = materialize(about, "forms")
    discard(*used)
    return _with_roots(about)


def _with_roots(about: DataFrame) -> DataFrame:
    """The last of each word's forms, by pointer jumping over (word, to)."""
    jumps = materialize(about.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "jumps")
    while True:
        on = jumps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        after = materialize(jumps.join(on.hint("merge"), "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jumps")
        moved = not after.filter("moved").isEmpty()
        discard(jumps)
        jumps = after.drop("moved")
        if not moved:
            break
    out = about.join(jumps.withColumnRenamed("to", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
