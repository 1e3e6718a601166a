"""Pluggable embedders backed by an iterator ``pandas_udf`` (Arrow batches, model loaded once
per Python worker). Use these for real models; the native ``HashEmbedder`` is the default."""

from __future__ import annotations

import hashlib
import re
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

_MODELS: dict = {}


_TOKEN = re.compile(r"\w+|[^\w\s]")


def token_length(text: str) -> int:
    """Words and signs of a text, and its two end marks."""
    return len(_TOKEN.findall(text)) + 2


def length_batches(lengths: list[int], budget: int) -> list[np.ndarray]:
    """Rows in batches of like length, shortest first: in each, the longest length times the
    number of rows is at most ``budget``, or it is one row."""
    order = np.argsort(lengths, kind="stable")
    out, start = [], 0
    for at, row in enumerate(order):
        if at > start and lengths[row] * (at - start + 1) > budget:
            out.append(order[start:at])
            start = at
    return [*out, order[start:]] if len(order) else out


class PandasEmbedder:
    """Wrap ``loader() -> encode(list[str]) -> ndarray[n, dim]`` as a column function.

    The loader runs once per worker process (cached by ``name``); vectors of any other length
    than ``dim`` raise an error. A model that pads the texts of a call to one length gets texts
    of like length together, at most ``batch_tokens`` padded tokens a call (by ``length`` of a
    text; None: a call per Arrow batch); vectors come back in the order of the rows.
    """

    def __init__(self, name: str, dim: int, loader: Callable[[], Callable],
                 batch_tokens: int | None = None, length: Callable[[str], int] = token_length):
        self.name, self.dim, self._loader = name, dim, loader
        name_, dim_, loader_, budget, length_ = name, dim, loader, batch_tokens, length

        def encoded(enc, texts: list[str]) -> np.ndarray:
            out = np.asarray(enc(texts), dtype=np.float32)
            if out.ndim != 2 or out.shape[1] != dim_ or out.shape[0] != len(texts):
                raise ValueError(f"embedder {name_} returned shape {out.shape}, "
                                 f"expected ({len(texts)}, {dim_})")
            return out

        @F.pandas_udf(ArrayType(FloatType()))
        def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            enc = _MODELS.get(name_)
            if enc is None:
                enc = _MODELS.setdefault(name_, loader_())
            for texts in batches:
                filled = texts.fillna("").tolist()
                if budget is None:
                    yield pd.Series(list(encoded(enc, filled)))
                    continue
                out = np.empty((len(filled), dim_), np.float32)
                for rows in length_batches([length_(t) for t in filled], budget):
                    out[rows] = encoded(enc, [filled[r] for r in rows])
                yield pd.Series(list(out))

        self._udf = _embed

    def __call__(self, text) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return self._udf(text)


def trigram_encoder(dim: int = 64):
    """Example model: character trigrams of the lower-cased text, two blanks in front and one
    behind, counted by the first 32 bits of their MD5 modulo ``dim``, L2-normalised. Stands in
    for a neural encoder in tests and demos. Each distinct trigram of a batch is hashed once."""
    def encode(texts):
        padded = [f"  {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(p) for p in padded])
        row = np.repeat(np.arange(len(padded)), size)
        grams = (codes[:-2].astype(np.int64) << 42 | codes[1:-1].astype(np.int64) << 21
                 | codes[2:].astype(np.int64))
        whole = row[:-2] == row[2:]
        distinct, at = np.unique(grams[whole], return_inverse=True)
        mask = (1 << 21) - 1
        bucket = np.array([int(hashlib.md5("".join(
            chr(g >> s & mask) for s in (42, 21, 0)).encode()).hexdigest()[:8], 16) % dim
            for g in distinct.tolist()], np.int64)
        out = np.bincount(row[:-2][whole] * dim + bucket[at], minlength=len(padded) * dim)
        out = out.reshape(len(padded), dim).astype(float)
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    return encode


def trigram_embedder(dim: int = 64, batch_tokens: int | None = 1 << 16) -> PandasEmbedder:
    return PandasEmbedder(f"trigram-md5-{dim}", dim, lambda: trigram_encoder(dim), batch_tokens)
