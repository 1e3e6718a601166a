"""Vector column functions (``array<float>`` / ``array<double>``) as native higher-order
expressions: dot product, norm, Euclidean distance, cosine similarity; and the hashing embedder."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import let, word_tokens


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a, b) -> Column:
    """Dot product, folded in double precision."""
    return _sum(F.zip_with(_col(a), _col(b),
                           lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a, b) -> Column:
    """Euclidean distance; both sides cast to double before subtracting."""
    return F.sqrt(_sum(F.zip_with(
        _col(a), _col(b),
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_similarity(a, b) -> Column:
    """dot / (|a| |b|); a zero vector gives NaN (as float division by zero does)."""
    return let(F.struct((l2_norm(a) * l2_norm(b)).alias("den"), dot(a, b).alias("dot")),
               lambda s: F.when(s["den"] == 0, F.lit(float("nan")))
                          .otherwise(s["dot"] / s["den"]))


def md5_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: first 32 bits of its MD5 (hex) modulo ``dim``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast(
        "int")


#: texts whose tokens are counted at once
COUNT_ROWS = 512


def _count_buckets(dim: int):
    @F.arrow_udf("array<double>")
    def counts(buckets: pa.Array) -> pa.Array:
        out = np.zeros((len(buckets), dim))
        for x in range(0, len(buckets), COUNT_ROWS):
            some = buckets.slice(x, COUNT_ROWS)
            size = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(some)) * dim, size) + some.flatten().to_numpy()
            out[x:x + COUNT_ROWS] = np.bincount(at, minlength=len(some) * dim).reshape(-1, dim)
        ends = np.arange(len(buckets) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
    return counts


def hash_embed(text, dim: int = 64) -> Column:
    """Deterministic lexical embedder: counts of lower-cased word tokens per MD5 bucket,
    L2-normalised, as ``array<float>`` of length ``dim``. A text with no token gives the zero
    vector. Lexical, not semantic; real models plug in via ``PandasEmbedder``.

    Tokens are hashed in the JVM, once each; the buckets of an Arrow batch are counted by
    ``bincount``, ``COUNT_ROWS`` texts at a time and without a copy of the batch, so the cost is
    tokens + rows x ``dim``.
    """
    buckets = F.transform(word_tokens(_col(text)), lambda t: md5_bucket(t, dim))
    return normalize(_count_buckets(dim)(buckets))


def normalize(vec) -> Column:
    """L2-normalise to ``array<float>``; the zero vector stays zero."""
    def scaled(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(
            v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n).cast("float")))
    return let(_col(vec), scaled)


class Embedder(Protocol):
    """Plug point: text column -> ``array<float>`` column of a fixed length ``dim``."""

    name: str
    dim: int

    def __call__(self, text: Column) -> Column: ...


class HashEmbedder:
    """Native default embedder (see ``hash_embed``)."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hash-md5-{dim}"

    def __call__(self, text) -> Column:
        return hash_embed(text, self.dim)
