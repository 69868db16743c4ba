"""Word shingles of whole texts as 64-bit hashes, in numpy over a batch's bytes.

Words are runs of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text.
A shingle is ``size`` words in a row; a text of fewer words has one shingle of all of them; a text
without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .dart_minhash import U, mix

_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
#: An odd multiplier and its inverse modulo 2**64.
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)


#: Bytes hashed at once; the tables of powers have as many entries, whatever the text.
CHUNK = 1 << 18


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0], done = 1, 1
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * U(pow(base, done, 1 << 64))
            done += take
    return out


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every word, in order. A word's hash is its bytes' polynomial, from a
    running sum over a chunk of bytes, and its length, mixed; a word that a chunk's end cuts is put together."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    del raw
    up, down = _powers(_P, CHUNK), _powers(_P_INV, CHUNK)
    starts, ends, sums = [], [], []
    for lo in range(0, len(flat), CHUNK):
        part = flat[lo : lo + CHUNK]
        edge = np.flatnonzero(np.diff(_WORD[part].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=total[1:])
            value = (total[end] - total[start]) * down[start]
            start, end = start + lo, end + lo
            if starts and ends[-1][-1] == start[0]:
                sums[-1][-1] += value[0] * U(pow(_P, int(ends[-1][-1] - starts[-1][-1]), 1 << 64))
                ends[-1][-1] = end[0]
                start, end, value = start[1:], end[1:], value[1:]
        if len(start):
            starts.append(start)
            ends.append(end)
            sums.append(value)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    start, end, value = (np.concatenate(x) for x in (starts, ends, sums))
    with np.errstate(over="ignore"):
        value = mix(value + mix((end - start).astype(U)))
    return np.searchsorted(np.cumsum(size), start, side="right"), value


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles (48-bit hashes) in order of text and shingle, and
    a hash of each text's word sequence (0 without words). At most 65,536 texts at once."""
    text, word = words(texts)
    n_texts = len(texts)
    count = np.bincount(text, minlength=n_texts)
    first = np.cumsum(count) - count
    spot = np.arange(len(text)) - first[text]
    with np.errstate(over="ignore"):
        sequence = np.zeros(n_texts, U)
        np.add.at(sequence, text, mix(word + spot.astype(U) * U(0x9E3779B97F4A7C15)))
        sequence = np.where(count > 0, mix(sequence + count.astype(U)), U(0))
        value = word.copy()
        for k in range(1, size):
            later = np.zeros_like(word)
            later[: max(len(word) - k, 0)] = word[k:]
            value = np.where(spot + k < count[text], value * U(0x2545F4914F6CDD1D) + later, value)
        starts = np.flatnonzero(spot <= np.maximum(count[text] - size, 0))
        owner = text[starts].astype(U)
        key = np.sort(owner << U(48) | mix(value[starts] + np.minimum(count[text[starts]], size).astype(U)) >> U(16))
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U(0xFFFFFFFFFFFF), times, sequence


def multiset(owner: np.ndarray, value: np.ndarray, times: np.ndarray, n_texts: int) -> list[bytes]:
    """Each text's shingles, the n-th copy of one as an element of its own, as sorted 32-bit hashes."""
    who = np.repeat(np.arange(len(owner)), times)
    copy = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        key = np.sort(owner[who].astype(U) << U(32) | mix(value[who] + copy.astype(U) * U(0x9E3779B97F4A7C15)) >> U(32))
    at = np.searchsorted(key, np.arange(n_texts + 1).astype(U) << U(32))
    low = (key & U(0xFFFFFFFF)).astype("<u4")
    return [low[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def jaccard(a: bytes, b: bytes) -> float:
    """Of two multisets in that form."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return 0.0
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(x) + len(y) - both)
