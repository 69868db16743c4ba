"""Pair metrics on strings. The LCS length and the matching blocks have no native expression: both run over whole
Arrow batches in numpy (the LCS bit-parallel, one machine word a pair), longer strings one by one."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from . import text as T


def _lcs_long(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    a = np.array(left, dtype=object)
    b = np.array(right, dtype=object)
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    swap = la > lb
    a[swap], b[swap] = b[swap], a[swap]
    la, lb = np.minimum(la, lb), np.maximum(la, lb)
    out = np.zeros(len(a), np.int64)
    short = np.flatnonzero((la > 0) & (la <= 64) & (lb <= 256))
    for k in np.flatnonzero((la > 0) & ~((la <= 64) & (lb <= 256))):
        out[k] = _lcs_long(a[k], b[k])
    for at in np.array_split(short[np.argsort(lb[short], kind="stable")], max(1, len(short) // 2048)):
        if not len(at):
            continue
        wa, wb = 64, int(lb[at].max())
        x = np.array([s.ljust(wa, "\0") for s in a[at]], dtype=f"U{wa}").view(np.uint32).reshape(len(at), -1)
        x = np.pad(x, ((0, 0), (0, wa - x.shape[1])))
        y = np.array(b[at].tolist(), dtype=f"U{wb}").view(np.uint32).reshape(len(at), -1)
        live = np.arange(wa) < la[at][:, None]
        v = np.full(len(at), ~np.uint64(0))
        for j in range(wb):
            m = np.packbits((x == y[:, j : j + 1]) & live, axis=1, bitorder="little").view(np.uint64).ravel()
            m = np.where(j < lb[at], m, np.uint64(0))
            u = v & m
            v = (v + u) | (v - u)
        mask = np.where(la[at] == 64, ~np.uint64(0), (np.uint64(1) << (la[at] % 64).astype(np.uint64)) - np.uint64(1))
        out[at] = la[at] - np.bitwise_count(v & mask)
    return out


def _grid(left: list[str], right: list[str]) -> np.ndarray:
    """``lcs_grid`` for left texts of 1 to 64 characters, one machine word a pair."""
    (a, a_at), (b, b_at) = _codes(left), _codes(right)
    alphabet, small = np.unique(np.concatenate([a, b]), return_inverse=True)
    small = small.astype(np.int64)
    la, lb = np.diff(a_at), np.diff(b_at)
    masks = np.zeros((len(left), len(alphabet) + 1), np.uint64)  # the last is of no character
    for i in range(int(la.max())):
        on = np.flatnonzero(la > i)
        masks[on, small[a_at[on] + i]] |= np.uint64(1) << np.uint64(i)
    order = np.argsort(lb, kind="stable")
    starts, lb = b_at[:-1][order] + len(a), lb[order]
    out = np.empty((len(left), len(right)), np.int64)
    full = np.where(la == 64, ~np.uint64(0), (np.uint64(1) << (la % 64).astype(np.uint64)) - np.uint64(1))
    for r0 in range(0, len(right), 1024):
        begin, length = starts[r0 : r0 + 1024], lb[r0 : r0 + 1024]
        for l0 in range(0, len(left), 64):
            of = masks[l0 : l0 + 64]
            v = np.full((len(of), len(begin)), ~np.uint64(0))
            for j in range(int(length.max(initial=0))):
                k = int(np.searchsorted(length, j, "right"))  # shorter texts have ended
                w = v[:, k:]
                u = w & of[:, small[begin[k:] + j]]
                np.bitwise_or(w + u, w - u, out=w)
            out[l0 : l0 + 64, order[r0 : r0 + 1024]] = np.bitwise_count(~v & full[l0 : l0 + 64, None])
    return out


def lcs_grid(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all left texts (rows) with all right texts."""
    out = np.zeros((len(left), len(right)), np.int64)
    short = lambda texts: np.fromiter((0 < len(t) <= 64 for t in texts), bool, len(texts))
    some = lambda texts, at: [texts[k] for k in at]
    filled = np.flatnonzero(np.fromiter(map(len, right), np.int64, len(right)))
    rows, others = np.flatnonzero(short(left)), np.flatnonzero(np.fromiter((len(t) > 64 for t in left), bool, len(left)))
    columns, long = np.flatnonzero(short(right)), np.flatnonzero(np.fromiter((len(t) > 64 for t in right), bool, len(right)))
    if len(rows) and len(filled):
        out[np.ix_(rows, filled)] = _grid(some(left, rows), some(right, filled))
    if len(others) and len(columns):
        out[np.ix_(others, columns)] = _grid(some(right, columns), some(left, others)).T
    for k in others:
        out[k, long] = [_lcs_long(left[k], right[j]) for j in long]
    return out


def distinct_of(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, list[str], list[str], np.ndarray, np.ndarray]:
    """For each row the number of its pair among the distinct ones; the distinct texts of each side; which two of them
    each distinct pair has. Null is the empty text."""
    (i, left), (j, right) = (pd.factorize(s.fillna("")) for s in (a, b))
    pairs, spot = np.unique(i.astype(np.int64) * max(1, len(right)) + j, return_inverse=True)
    return spot, list(left), list(right), pairs // max(1, len(right)), pairs % max(1, len(right))


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs that repeat in a batch, as brands do, are measured once; where few texts make many pairs, as a grid."""
    if not len(a):
        return pd.Series([], dtype="int32")
    spot, left, right, i, j = distinct_of(a, b)
    if len(left) * len(right) <= 8 * len(i):
        out = lcs_grid(left, right)[i, j]
    else:
        out = lcs_lengths([left[k] for k in i], [right[k] for k in j])
    return pd.Series(out[spot], dtype="int32")


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(s: Column | str) -> Column:
    """Composed characters; ASCII texts need no Python."""
    s = F.col(s) if isinstance(s, str) else s
    wide = F.octet_length(s) != F.length(s)
    return F.when(wide, _composed(F.when(wide, s))).otherwise(s)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each begins."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], ends])


def _longest_blocks(a: np.ndarray, b: np.ndarray, areas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each area (a from, to, b from, to) the longest common block as (start in a, start in b, length): of equally
    long ones the first in a, of these the first in b. Runs grow one character of ``a`` at a time in all areas at once."""
    n, wa, wb = len(areas), int((areas[:, 1] - areas[:, 0]).max()), int((areas[:, 3] - areas[:, 2]).max())

    def cut(codes: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, none: int) -> np.ndarray:
        at = low + np.arange(width)[:, None]
        return np.where(at < high, codes[np.minimum(at, len(codes) - 1)], none).astype(codes.dtype)

    top = np.iinfo(a.dtype).max  # no character has the two highest codes
    x, y = cut(a, areas[:, 0], areas[:, 1], wa, top), cut(b, areas[:, 2], areas[:, 3], wb, top - 1)
    run = np.zeros((wb + 1, n), np.uint8 if min(wa, wb) < 255 else np.int32)
    size, i, j = np.zeros(n, run.dtype), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(wa):
        run[1:] = (run[:-1] + 1) * (y == x[k])
        most = run.max(axis=0)
        longer = np.flatnonzero(most > size)
        if len(longer):
            size[longer], i[longer], j[longer] = most[longer], k + 1, run[:, longer].argmax(axis=0)
    size = size.astype(np.int64)
    return areas[:, 0] + i - size, areas[:, 2] + j - size, size


def matched_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair: the longest common block, then the same left and right of it.
    All pairs go down one level at a time. Where the second text has 200 characters or more its frequent ones count
    as junk, which leaves so few places that the standard library is quick; such pairs, and those whose first text is
    over 1,000 long, go to it."""
    out = np.zeros(len(left), np.int64)
    long = [k for k, (x, y) in enumerate(zip(left, right)) if len(y) >= 200 or len(x) > 1000]
    for k in long:
        out[k] = sum(m.size for m in difflib.SequenceMatcher(None, left[k], right[k]).get_matching_blocks())
    pairs = np.setdiff1d(np.arange(len(left)), long)
    (a, a_at), (b, b_at) = _codes([left[k] for k in pairs]), _codes([right[k] for k in pairs])
    alphabet, small = np.unique(np.concatenate([a, b]), return_inverse=True)
    small = small.astype(np.uint8 if len(alphabet) < 254 else np.uint32)
    a, b = small[: len(a)], small[len(a) :]
    areas = np.column_stack([pairs, a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]])
    while True:
        areas = areas[(areas[:, 1] < areas[:, 2]) & (areas[:, 3] < areas[:, 4])]
        if not len(areas):
            return out
        # areas of like size share a step
        areas = areas[np.lexsort((areas[:, 2] - areas[:, 1], areas[:, 4] - areas[:, 3]))]
        deeper = []
        for some in np.array_split(areas, -(-len(areas) // 4096)):
            i, j, size = _longest_blocks(a, b, some[:, 1:])
            np.add.at(out, some[:, 0], size)
            some, i, j, size = (v[size > 0] for v in (some, i, j, size))
            deeper += [np.column_stack([some[:, 0], some[:, 1], i, some[:, 3], j]), np.column_stack([some[:, 0], i + size, some[:, 2], j + size, some[:, 4]])]
        areas = np.concatenate(deeper)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp, with the junk heuristic of the standard library; not symmetric. Null is the empty text, two
    empty texts are equal. Pairs that repeat in a batch are measured once."""
    if not len(a):
        return pd.Series([], dtype="float64")
    spot, left, right, i, j = distinct_of(a, b)
    left, right = [left[k] for k in i], [right[k] for k in j]
    both = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=float)
    ratios = np.divide(2.0 * matched_lengths(left, right), both, out=np.ones(len(both)), where=both > 0)
    return pd.Series(ratios[spot], dtype="float64")


@F.pandas_udf(IntegerType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ``ratio`` of the shorter string with any equally long window of the longer; over 99.5
    counts as 100. All windows are tried, so the result depends on no block choice."""

    if not len(a):
        return pd.Series([], dtype="int32")
    spot, left, right, i, j = distinct_of(a, b)
    out = np.zeros(len(i), np.int64)
    asked: list[tuple[int, str, str]] = []  # pairs whose windows are measured together
    windows = 0

    def measure() -> None:
        lefts = [x for _, x, y in asked for _ in range(len(y) - len(x) + 1)]
        rights = [y[w : w + len(x)] for _, x, y in asked for w in range(len(y) - len(x) + 1)]
        lengths, at = lcs_lengths(lefts, rights), 0
        for k, x, y in asked:
            best = int(lengths[at : at + len(y) - len(x) + 1].max())
            at += len(y) - len(x) + 1
            out[k] = 100 if best / len(x) > 0.995 else int(round(100 * best / len(x)))
        asked.clear()

    for k, (m, n) in enumerate(zip(i, j)):
        x, y = sorted((left[m], right[n]), key=len)
        if x:
            asked.append((k, x, y))
            windows += len(y) - len(x) + 1
        else:
            out[k] = 100 if x == y else 0
        if windows > 65_536:
            measure()
            windows = 0
    if asked:
        measure()
    return pd.Series(out[spot], dtype="int32")


def ratio_of(lcs: Column, a: Column, b: Column) -> Column:
    """fuzz.ratio from an LCS length: percent of matching characters, rounded half to even."""
    both = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100)).when(both == 0, F.lit(0)).otherwise(F.rint(200.0 * lcs / F.greatest(both, F.lit(1)))).cast("int")


def ratio(a: Column, b: Column) -> Column:
    return ratio_of(lcs_length(a, b), a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(T.sorted_tokens(a), T.sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    x, y = T.words(T.full_process(a)), T.words(T.full_process(b))
    both = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    left = F.trim(F.concat_ws(" ", both, F.array_join(F.array_sort(F.array_except(x, y)), " ")))
    right = F.trim(F.concat_ws(" ", both, F.array_join(F.array_sort(F.array_except(y, x)), " ")))
    best = F.greatest(ratio(both, left), ratio(both, right), ratio(left, right))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0)).otherwise(best)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = T.words(a), T.words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def stepped_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of two token sets, raised to fixed steps."""
    j = F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(j >= 0.8, F.lit(0.95)).when(j >= 0.6, F.lit(0.85)).otherwise(j)


def semantic_similarity(a: Column, b: Column) -> Column:
    """Of normalized texts: equal 1, else the stepped Jaccard of their content words."""
    return F.when(a == b, F.lit(1.0)).otherwise(stepped_jaccard(T.semantic_tokens(a), T.semantic_tokens(b)))


def _percent(lcs: np.ndarray, a: list[str], b: list[str]) -> np.ndarray:
    """``ratio_of`` in numpy."""
    both = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    same = np.fromiter((x == y for x, y in zip(a, b)), bool, len(a))
    return np.where(same, 100, np.where(both == 0, 0, np.rint(200.0 * lcs / np.maximum(both, 1))))


@F.pandas_udf(DoubleType())
def six_metrics(a: pd.Series, b: pd.Series, a_sorted: pd.Series, b_sorted: pd.Series, a_content: pd.Series, b_content: pd.Series) -> pd.Series:
    """0.15 ratio + 0.15 partial ratio + 0.25 token-sort ratio + 0.25 token-set ratio + 5 sequence ratio + 15 semantic
    similarity of two normalized texts, with their sorted tokens and content words (joined by spaces). Pairs that repeat in
    a batch are measured once."""
    if not len(a):
        return pd.Series([], dtype="float64")
    spot, left, right, i, j = distinct_of(a, b)
    words = [dict(zip(t.fillna(""), zip(s.fillna(""), c.fillna("")))) for t, s, c in ((a, a_sorted, a_content), (b, b_sorted, b_content))]
    sides = [[(s, set(s.split(" ")) - {""}, set(c.split(" ")) - {""}) for s, c in (of[t] for t in texts)] for of, texts in zip(words, (left, right))]
    grid = len(left) * len(right) <= 8 * len(i)

    def lengths(one: list[str], other: list[str]) -> np.ndarray:
        return lcs_grid(one, other)[i, j] if grid else lcs_lengths([one[k] for k in i], [other[k] for k in j])

    x, y = [left[k] for k in i], [right[k] for k in j]
    sx, sy = [sides[0][k][0] for k in i], [sides[1][k][0] for k in j]
    common, rests, semantic = [], ([], []), np.zeros(len(i))
    for n, (k, m) in enumerate(zip(i, j)):
        (_, u, c), (_, v, d) = sides[0][k], sides[1][m]
        common.append(" ".join(sorted(u & v)))
        rests[0].append(" ".join(sorted(u - v)))
        rests[1].append(" ".join(sorted(v - u)))
        jaccard = len(c & d) / len(c | d) if c and d else 0.0
        semantic[n] = 1.0 if x[n] == y[n] else 0.95 if jaccard >= 0.8 else 0.85 if jaccard >= 0.6 else jaccard
    # what both have is the beginning of either text
    held = np.fromiter(map(len, common), np.int64, len(common))
    fronts = [[(h + " " + r).strip(" ") for h, r in zip(common, rest)] for rest in rests]
    gap = np.fromiter((bool(h and r and q) for h, r, q in zip(common, *rests)), bool, len(common))
    pairs, at = distinct_lists(rests[0], rests[1])
    within = lcs_lengths(*pairs)[at] + held + gap
    token_set = np.maximum.reduce([_percent(held, common, fronts[0]), _percent(held, common, fronts[1]), _percent(within, *fronts)])
    token_set[np.fromiter((not p or not q for p, q in zip(sx, sy)), bool, len(i))] = 0
    partial = partial_ratio.func(pd.Series(x), pd.Series(y)).to_numpy()
    sequence = sequence_ratio.func(pd.Series(x), pd.Series(y)).to_numpy()
    sort = _percent(lengths([s[0] for s in sides[0]], [s[0] for s in sides[1]]), sx, sy)
    mixed = 0.15 * _percent(lengths(left, right), x, y) + 0.15 * partial + 0.25 * sort + 0.25 * token_set + 5.0 * sequence + 15.0 * semantic
    return pd.Series(mixed[spot])


def distinct_lists(a: list[str], b: list[str]) -> tuple[tuple[list[str], list[str]], np.ndarray]:
    """The distinct pairs, and for each pair its number among them."""
    at: dict[tuple[str, str], int] = {}
    spot = np.fromiter((at.setdefault(pair, len(at)) for pair in zip(a, b)), np.int64, len(a))
    return ([x for x, _ in at], [y for _, y in at]), spot


def six_of(a: Column, b: Column, a_words: tuple[Column, Column] | None = None, b_words: tuple[Column, Column] | None = None) -> Column:
    """``six_metrics``; ``..._words`` are ``compared_words`` of the texts if they are known."""
    (p, q), (r, s) = a_words or compared_words(a), b_words or compared_words(b)
    return six_metrics(a, b, p, r, q, s)


def compared_words(c: Column) -> tuple[Column, Column]:
    """Sorted tokens and content words, joined by spaces."""
    return T.sorted_tokens(c), F.array_join(T.semantic_tokens(c), " ")
