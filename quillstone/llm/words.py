"""Words of a text, and hashes of words and word sequences, a batch at a time.

A word is a longest run of letters and digits (Unicode L and N) of the lower-cased
text. ``str.isalnum``, which ``\\w`` follows, holds for just these two categories.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 1 << 20
_cache: dict[str, int] = {}

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads close values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * M2
    x = x ^ (x >> np.uint64(27))
    x = x * M3
    return x ^ (x >> np.uint64(31))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the batch, and where each text's words start (one entry more than texts)."""
    if len(_cache) > _CACHE_WORDS:
        _cache.clear()
    out: list[int] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, text in enumerate(texts):
        found = words(text)
        try:
            out.extend([_cache[w] for w in found])
        except KeyError:
            for w in found:
                if w not in _cache:
                    _cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.extend([_cache[w] for w in found])
        starts[i + 1] = len(out)
    return np.array(out, dtype=np.uint64), starts


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``size``-word sequences of each text, sorted within it, and the starts of each text's part.

    A text of fewer than ``size`` words has none.
    """
    h, starts = hashed(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value = mix(value * M1 + h[k : k + n] + np.uint64(k + 1))
    whole = owner[:n] == owner[size - 1 :]
    value, owner = value[whole], owner[:n][whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))
