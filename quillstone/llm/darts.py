"""DartMinHash: sparse weighted minhash signatures.

Every element owns an endless strip of the (weight, rank) plane with one dart per unit
area on average. Where the darts lie follows from the element's hash alone, so two sets
see the same darts where their strips overlap. A set of weights keeps the darts below
each element's weight, and of those the one of lowest rank in each of ``size``
coordinates, to which darts are dealt by hash. A coordinate is equal in two signatures
with the probability of the weighted Jaccard similarity. About ``size * ln(size)`` darts
fill a signature, whatever the number of elements, while plain minhash needs ``size``
hashes of each of them.

The strips are cut into unit cells. Cells of higher rank are opened only for sets with
coordinates still empty; the darts of opened cells all lie below those of later ones, so
a filled coordinate is final.
"""

from __future__ import annotations

import math

import numpy as np

from quillstone.llm.words import M1, M2, mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_CELLS = 1 << 20


def _poisson_limits() -> np.ndarray:
    """P(X <= n) for a mean of one, to where it can't be told from 1."""
    p = [math.exp(-1) / math.factorial(n) for n in range(20)]
    return np.cumsum(p)


_LIMITS = _poisson_limits()


def _throw(sig: np.ndarray, size: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
    """Throw the darts of ranks first .. first + count (by element) and keep the earliest of each coordinate."""
    layers = np.maximum(np.ceil(weight).astype(np.int64), 1) * count
    ends = np.cumsum(layers)
    lo = 0
    while lo < len(element):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _CELLS, side="right")))
        of = np.repeat(np.arange(lo, hi), layers[lo:hi])
        step = np.arange(len(of)) - np.repeat(ends[lo:hi] - layers[lo:hi] - base, layers[lo:hi])
        cell_w, rank = step // count[of], step % count[of] + first[of]
        cell = mix(element[of] * M1 + (rank.astype(np.uint64) << np.uint64(24)) + cell_w.astype(np.uint64) * M2 + np.uint64(1))
        darts = np.searchsorted(_LIMITS, (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        src = np.repeat(np.arange(len(of)), darts)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[src] + (nth.astype(np.uint64) + np.uint64(1)) * M1)
        at = of[src]
        if (weight != 1).any():
            height = cell_w[src] + (mix(dart + M2) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            below = height < weight[at]
            src, at, dart = src[below], at[below], dart[below]
        place = owner[at] * size + ((dart >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        value = (rank[src].astype(np.uint64) << np.uint64(44)) | (mix(dart) >> np.uint64(20))
        np.minimum.at(sig, place, value)
        lo = hi


def signatures(elements: np.ndarray, starts: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """One row of ``size`` coordinates for each set; sets without elements keep ``EMPTY`` everywhere."""
    n = len(starts) - 1
    sig = np.full(n * size, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    weight = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=np.float64)
    total = np.bincount(owner, weight, minlength=n)
    step = np.ceil((size * math.log(size) + 2 * size) / np.maximum(total, 1e-9)).astype(np.int64)
    step, opened = np.clip(step, 1, 1 << 18), np.zeros(n, np.int64)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        _throw(sig, size, owner[mine], elements[mine], weight[mine], opened[owner[mine]], step[owner[mine]])
        opened[todo] += step[todo]
        step = np.maximum(step // 4, 1)
        todo &= (sig.reshape(n, size) == EMPTY).any(axis=1)
    return sig.reshape(n, size)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of ``rows`` coordinates, with the run's number in it."""
    n, size = sig.shape
    out = np.zeros((n, size // rows), np.uint64) + np.arange(size // rows, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * M1 + sig[:, k::rows][:, : size // rows])
    return out


def bits(sig: np.ndarray, words: int) -> np.ndarray:
    """One bit of each of the first 64 * ``words`` coordinates, as int64: bits agree with probability (1 + similarity) / 2."""
    b = (mix(sig[:, : 64 * words] + M2) & np.uint64(1)).astype(np.uint8)
    return np.packbits(b, axis=1).view(np.int64)
