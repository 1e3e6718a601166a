"""External induced suffix sorting.

The suffixes that start a run of ascending type after a descending one are sorted first, by
recursion on the string of their substrings' names; from their order all descending suffixes
are induced by one ascending scan, and from those all ascending ones by a descending scan. Both
scans are driven by a priority queue over blocks of first characters: a scanned suffix pushes
its left neighbour, and a block is taken out when the scan reaches it. Within a first character
the queue keeps the order of pushing, which is the order of the suffixes, so its runs need no
sorting and are kept in files once they exceed the memory given; so are the string and the
result of long inputs. All steps work on whole arrays.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: rows that a queue or an array holds in memory before it goes to a file
MEMORY_ROWS = 1 << 24
#: rows of a block of several first characters
BLOCK_ROWS = 1 << 16


def array(n: int, dtype, memory_rows: int) -> np.ndarray:
    """An uninitialised array, in an unnamed temporary file if it is long."""
    if n <= memory_rows:
        return np.empty(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype=dtype, mode="w+", shape=(n,))


class BlockQueue:
    """Priority queue of suffixes by block; first in, first out within a block. Beyond
    ``memory_rows`` rows everything that is held moves to an unnamed temporary file."""

    def __init__(self, memory_rows: int = MEMORY_ROWS):
        self.memory_rows, self.held = memory_rows, 0
        self.rows: dict[int, list[np.ndarray]] = defaultdict(list)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.file = None
        self.end = 0

    def push(self, blocks: np.ndarray, suffixes: np.ndarray) -> None:
        """Suffixes in scan order with the block of each."""
        if not len(suffixes):
            return
        if blocks.max() < 1 << 16:
            blocks = blocks.astype(np.uint16)       # short keys are sorted by radix
        order = np.argsort(blocks, kind="stable")
        blocks, suffixes = blocks[order], suffixes[order]
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for x, y in zip(cuts, cuts[1:]):
            self.rows[int(blocks[x])].append(suffixes[x:y])
        self.held += len(suffixes)
        if self.held > self.memory_rows:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for block, parts in self.rows.items():
            data = np.concatenate(parts).astype(np.int64)
            self.file.seek(self.end)
            self.file.write(data.tobytes())
            self.runs[block].append((self.end, len(data)))
            self.end += data.nbytes
        self.rows.clear()
        self.held = 0

    def pop(self, block: int) -> np.ndarray:
        """All suffixes of a block, in the order in which they came."""
        parts = []
        for at, n in self.runs.pop(block, []):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * n), np.int64))
        held = self.rows.pop(block, [])
        self.held -= sum(map(len, held))
        parts += held
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def blocks_of(text: np.ndarray, size: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each character, first character of each block and the end). A frequent
    character has a block of its own; rare neighbours share one of about ``block_rows``."""
    count = np.bincount(text, minlength=size)
    big = count > block_rows // 4
    total = np.cumsum(np.where(big, 0, count)) // block_rows
    new = np.ones(size, bool)
    new[1:] = big[1:] | big[:-1] | (total[1:] != total[:-1])
    return np.cumsum(new) - 1, np.append(np.flatnonzero(new), size)


def _scan_block(text: np.ndarray, came: np.ndarray, given: np.ndarray, single: bool, edge: int,
                up: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order within one block, in scan direction: (induced suffixes, all suffixes). ``came`` are
    those from the queue, ``given`` those whose order is known and that come after the induced
    ones of the same first character. ``edge``: the first character beyond the block."""
    sign = 1 if up else -1
    if single:
        rounds, now = [came], came
        while len(now):
            left = now[now > 0] - 1
            now = left[text.take(left) == text.take(left + 1)]
            rounds.append(now)
        induced = np.concatenate(rounds)
        return induced, np.concatenate((induced, given))
    pos = [came, given]
    kind = [np.zeros(len(came), np.int8), np.full(len(given), 2, np.int8)]
    key = [np.arange(len(came)), np.arange(len(given))]
    at = len(came) + len(given)
    now, index = np.concatenate(pos), np.arange(at)
    strict = np.concatenate((np.zeros(len(came), bool), np.ones(len(given), bool)))
    depth = 0
    while len(now):
        ok = now > 0
        now, index, strict = now[ok], index[ok], strict[ok]
        before = text.take(now - 1)
        step = before - text.take(now)
        step *= sign
        ok = ((step > 0) | ((step == 0) & ~strict)) & ((edge - before) * sign > 0)
        now, parent = now[ok] - 1, index[ok]
        index, strict = np.arange(at, at + len(now)), np.zeros(len(now), bool)
        at += len(now)
        pos.append(now)
        kind.append(np.ones(len(now), np.int8))
        key.append(parent)
        depth += 1
    pos, kind, key = np.concatenate(pos), np.concatenate(kind), np.concatenate(key)
    # first character, kind and key as one number: all are different, so any sort will do
    char = (text.take(pos).astype(np.int64) - edge) * sign
    high = (char - char.min(initial=0)) * 3 + kind
    high *= len(pos) + 1
    base = key
    deep = np.flatnonzero(kind == 1)
    base_deep = base[deep]
    order = np.argsort(high + key)
    for _ in range(depth if len(deep) else 0):
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = base.copy()
        key[deep] = rank.take(base_deep)
        fine = (high + key).take(order)         # sorted but for suffixes of equal first parts
        if (fine[1:] > fine[:-1]).all():
            break
        order = order.take(np.argsort(fine, kind="stable"))
    return pos[order[kind[order] != 2]], pos[order]


def _scan(text: np.ndarray, given: np.ndarray, blocks: tuple, up: bool,
          memory_rows: int) -> np.ndarray:
    """Induce in one direction from ``given``, sorted in scan direction. Upwards: descending
    suffixes from the first of ascending runs; downwards: ascending suffixes from all descending
    ones. Returns the induced suffixes in scan order."""
    of_char, first = blocks
    sign = 1 if up else -1
    queue = BlockQueue(memory_rows)
    if up:                                          # the last suffix follows the end of the text
        last = np.array([len(text) - 1])
        queue.push(of_char[text[last]], last)
    numbers = range(len(first) - 1) if up else range(len(first) - 2, -1, -1)
    given_block = of_char[text[given]] * sign
    out = []
    for b in numbers:
        low, high = np.searchsorted(given_block, [b * sign, b * sign + 1])
        edge = int(first[b + 1]) if up else int(first[b]) - 1
        induced, everything = _scan_block(text, queue.pop(b), given[low:high],
                                          first[b + 1] - first[b] == 1, edge, up)
        out.append(induced)
        left = everything[everything > 0] - 1
        c = text.take(left)
        left = left[(c - edge) * sign >= 0]
        queue.push(of_char.take(text.take(left)), left)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def suffix_array(text: np.ndarray, size: int, memory_rows: int = MEMORY_ROWS,
                 block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Starts of all suffixes of ``text`` (characters 0 to size - 1) in ascending order; a
    suffix that is a prefix of another one comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    rising = _rising(text)
    first = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    blocks = blocks_of(text, size, block_rows)
    if len(first):
        rough = first[np.argsort(text[first], kind="stable")]
        first = _sort_first(text, rising, first, rough, blocks, memory_rows, block_rows)
    falling = _scan(text, first, blocks, True, memory_rows)
    climbing = _scan(text, falling[::-1], blocks, False, memory_rows)[::-1]
    out = array(n, np.int64, memory_rows)
    fall_c, climb_c = text[falling], text[climbing]
    # descending suffixes come before ascending ones of the same first character
    out[np.arange(len(falling)) + np.searchsorted(climb_c, fall_c, "left")] = falling
    out[np.arange(len(climbing)) + np.searchsorted(fall_c, climb_c, "right")] = climbing
    return out


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last one is not)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(decided[::-1])[::-1]
    return step[after] > 0


def _sort_first(text: np.ndarray, rising: np.ndarray, first: np.ndarray, rough: np.ndarray,
                blocks: tuple, memory_rows: int, block_rows: int) -> np.ndarray:
    """The first suffixes of ascending runs in order: their substrings are sorted by inducing
    from any order, named, and the string of names is sorted by recursion."""
    falling = _scan(text, rough, blocks, True, memory_rows)
    climbing = _scan(text, falling[::-1], blocks, False, memory_rows)[::-1]
    is_first = np.zeros(len(text), bool)
    is_first[first] = True
    order = climbing[is_first[climbing]]
    number = array(len(text), np.int64, memory_rows)
    number[first] = np.arange(len(first))
    length = np.append(np.diff(first) + 1, 0)        # to the next one; 0: to the end, unlike all
    a, b = order[:-1], order[1:]
    la = length[number[a]]
    same = (la == length[number[b]]) & (la > 0)
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[la[live] > k]
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 == len(order):
        return order
    reduced = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    reduced[number[order]] = names
    return first[suffix_array(reduced, int(names[-1]) + 1, memory_rows, block_rows)]


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours of ``order`` (starts of suffixes of a byte text, sorted, with at least
    ``length`` bytes each): whether their common prefix has ``length`` bytes."""
    padded = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    same = np.ones(max(len(order) - 1, 0), bool)
    live = np.arange(len(same))
    for k in range(0, length, 8):
        width = min(8, length - k)
        a, b = words[order[live] + k, :width], words[order[live + 1] + k, :width]
        equal = (a == b).all(1)
        same[live[~equal]] = False
        live = live[equal]
    return same
