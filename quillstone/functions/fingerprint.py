"""FNV-1a 64 over the bytes before an offset, for many files at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAIL = 4096
#: Fixed values of FNV-1a, 64 bits.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(blobs: list[bytes]) -> np.ndarray:
    """The hash of each byte string; one step of the loop takes the next byte of all of them."""
    lengths = np.array([len(b) for b in blobs], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order])
    data = np.frombuffer(b"".join([blobs[i] for i in order]), dtype=np.uint8).astype(np.uint64)
    begins, sorted_lengths = ends - lengths[order], lengths[order]
    h = np.full(len(blobs), BASIS, dtype=np.uint64)
    prime = np.uint64(PRIME)
    for k in range(int(sorted_lengths[0]) if len(blobs) else 0):
        live = int(np.searchsorted(-sorted_lengths, -k, side="left"))
        h[:live] = (h[:live] ^ data[begins[:live] + k]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def _hex(parts: pd.Series) -> pd.Series:
    blobs = [b"".join(p) if p is not None else b"" for p in parts]
    return pd.Series([f"{x:016x}" for x in fnv1a(blobs).tolist()], dtype=object)


def fnv1a_hex(parts: Column) -> Column:
    """16 hex digits for the concatenation of an array of binaries; a null array counts as empty."""
    return F.pandas_udf(_hex, "string")(parts)
