"""Vector expressions and the offline encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import ascii_lower

#: Fixed values of the hash encoder: an FNV-1a prime with a start of its own.
SEED, PRIME = 1_469_598_103_934_665_603, 1_099_511_628_211


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles within -1 and 1; 0 where a norm is 0. Vectors of different lengths are an error, a null vector gives null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def _similarities(queries: list[list[float]]) -> Callable:
    q = np.asarray(queries, np.float64)
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    unit = q / np.where(norms == 0, 1, norms)

    def score(vectors):
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        # twelve places: equal vectors get equal values, wherever they stand in a batch
        return pd.Series(list(np.clip((x / np.where(norm == 0, 1, norm)) @ unit.T, -1, 1).round(12)))

    score.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return score


def cosines(vectors: Column, queries: list[list[float]]) -> Column:
    """The cosines of a vector with each of the query vectors, as an array; a matrix product for each batch. Vectors must be of one length, not null and finite."""
    return F.pandas_udf(_similarities(queries), "array<double>")(vectors)


def stable_hash(token: str) -> int:
    h = SEED
    for byte in token.encode("utf-8", "surrogatepass"):
        h = ((h ^ byte) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _encode(dim: int) -> Callable:
    def encode(batches):
        place: dict[str, int] = {}
        for lists in batches:
            out = np.zeros((len(lists), dim), np.float32)
            for i, tokens in enumerate(lists):
                for t in tokens if tokens is not None else ():
                    p = place.get(t)
                    if p is None:
                        p = place[t] = stable_hash(t) % dim
                    out[i, p] += 1
            norm = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
            yield pd.Series(list((out / np.where(norm == 0, 1, norm)).astype(np.float32)))

    # the hints as classes: as text, which the future import makes of them, they aren't understood
    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encode


def hash_embed(x: Column, dim: int) -> Column:
    """Counts of hashed words, of unit length: the encoder where no model is at hand. Null and wordless texts give zeros."""
    tokens = F.regexp_extract_all(ascii_lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.pandas_udf(_encode(dim), "array<float>")(tokens)


def hash_embed_text(text: str, dim: int) -> list[float]:
    """``hash_embed`` of one text, on the driver, for queries."""
    import re

    out = np.zeros(dim)
    for t in re.findall(r"[^\W_]+", "".join(c.lower() if c.isascii() else c for c in text)):
        out[stable_hash(t) % dim] += 1
    norm = np.linalg.norm(out)
    return (out / (norm or 1)).astype(np.float32).tolist()
