"""Words of whole texts in flat numpy arrays.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are in lower case: ASCII
letters and digits and every character beyond ASCII, so the bytes alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.shared import utf8

#: bytes of text that are scanned at once; a longer text is scanned on its own
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Words(NamedTuple):
    """``flat``: the words of all texts in turn, in lower case, a space after each; word ``w`` is
    ``flat[starts[w]:ends[w]]``; text ``i`` has the words ``bounds[i]`` to ``bounds[i + 1]``."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def scan(texts: pa.Array) -> Words:
    """Words of an Arrow string column; a null has none."""
    # a space after each text, so that no word goes over into the next text
    closed = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""),
                                         pa.scalar("", pa.large_string()),
                                         pa.scalar(" ", pa.large_string()))
    data, offsets = utf8(closed)
    inside = _IN_WORD[data]
    before = np.concatenate(([False], inside[:-1]))
    first = np.flatnonzero(inside & ~before)
    bounds = np.searchsorted(first, offsets)
    kept = inside | before                      # the byte after a word stands for the separator
    flat = _LOWER[data[kept]]
    inside = inside[kept]
    flat[~inside] = 32
    ends = np.flatnonzero(~inside)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return Words(flat, starts, ends, bounds)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        upto = np.searchsorted(np.cumsum(sizes[at:at + 65536]), limit, side="right")
        stop = at + max(1, int(upto))
        yield at, min(stop, len(sizes))
        at = stop
