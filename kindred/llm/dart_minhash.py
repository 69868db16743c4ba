"""DartMinHash signatures of weighted shingle sets, in numpy over whole batches of documents.

Every element x owns the quarter plane (weight, rank). It is cut into fixed areas, dyadic in weight and
in rank; an area's darts, their number (Poisson with its size as mean), places, coordinates and names,
come from hashes of (x, area) alone, so all documents see the same darts. A document with weight w for x
is hit by x's darts under w. For each of k coordinates the hit of least rank names the signature: two
documents agree in a coordinate with probability equal to their weighted Jaccard similarity. Areas are
visited by rising rank, and a document is done when all its coordinates have a dart, after about
k log k darts, however many elements it has.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Height of the lowest rank stratum; each further one doubles the rank reached.
BASE = 2.0**-6
#: Areas larger than this are cut into equal cells, so that counts stay small.
CELL = 16.0


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _poisson_cdf(mean: float) -> np.ndarray:
    out, term, total = [], np.exp(-mean), 0.0
    for k in range(int(mean + 12 * np.sqrt(mean) + 24)):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return np.array(out)


def weight_bands(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each element once for every dyadic weight band below its weight: (element, band, low, width).
    Bands are [0, 1), [1, 2), [2, 4), ..."""
    n = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))), 0).astype(np.int64) + 1
    who = np.repeat(np.arange(len(w)), n)
    band = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    low = np.where(band == 0, 0.0, 2.0 ** (band - 1))
    return who, band, low, np.where(band == 0, 1.0, low)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) dart names as uint64. ``doc`` numbers the documents, (doc, element) pairs are distinct,
    weights are positive. Rows of documents without elements are 0."""
    out = np.zeros((n_docs, k), np.uint64)
    empty = np.zeros(n_docs, bool)
    empty[doc] = True
    missing = np.where(empty, k, 0)
    who, band, low, width = weight_bands(weight)
    with np.errstate(over="ignore"):
        seed = mix(element[who] + mix(band.astype(U) + U(0x9E3779B97F4A7C15)))
        of, most = doc[who], weight[who]
        stratum = 0
        while missing.any():
            live = missing[of] > 0
            if not live.all():
                seed, of, most, low, width = (a[live] for a in (seed, of, most, low, width))
            floor, height = (0.0, BASE) if stratum == 0 else (BASE * 2.0 ** (stratum - 1), BASE * 2.0 ** (stratum - 1))
            here = mix(seed + U(stratum + 1) * U(0xD1B54A32D192ED03))
            found: list[tuple] = []
            for size in np.unique(width):
                own = np.flatnonzero(width == size) if width.min() != width.max() else slice(None)
                h, d, m, lo = here[own], of[own], most[own], low[own]
                cells = max(1, int(np.ceil(size * height / CELL)))
                cdf = _poisson_cdf(size * height / cells)
                for cell in range(cells):
                    draw = unit(mix(h + U(cell) * U(0xA0761D6478BD642F)))
                    hit = np.flatnonzero(draw >= cdf[0])
                    if not len(hit):
                        continue
                    n = np.searchsorted(cdf, draw[hit], side="right")
                    hit = np.repeat(hit, n)
                    nth = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
                    name = mix(h[hit] + (nth.astype(U) + U(1)) * U(0xE7037ED1A0B428DB) + U(cell) * U(0x8EBC6AF09C88C6E3))
                    at = lo[hit] + unit(mix(name + U(1))) * size
                    inside = at < m[hit]
                    name, owner = name[inside], d[hit][inside]
                    rank = floor + (cell + unit(mix(name + U(2)))) * (height / cells)
                    slot = owner * k + (mix(name + U(3)) % U(k)).astype(np.int64)
                    found.append((slot, rank, name))
            if found:
                slot, rank, name = (np.concatenate(x) for x in zip(*found))
                open_ = out.ravel()[slot] == 0  # darts of lower strata have lower ranks
                slot, rank, name = slot[open_], rank[open_], name[open_]
                order = np.lexsort((name, rank, slot))
                slot, name = slot[order], name[order]
                first = np.flatnonzero(np.diff(slot, prepend=-1))
                out.ravel()[slot[first]] = np.maximum(name[first], U(1))
                missing -= np.bincount(slot[first] // k, minlength=n_docs)
            stratum += 1
    return out
