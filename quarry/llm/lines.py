"""Fuzzy line deduplication.

A line's words in lower case are hashed; lines of equal words are one row with its first
occurrence, and a line without words stands for its own characters. In scripts without blanks
each character is a word. Two lines are linked if the edit similarity of their word sequences is
high enough, and of each connected group one occurrence stays, the first by document and line.

Candidates are complete. An edit changes at most q of a line's runs of q words, so if two lines
are within d edits, any of their runs that d edits cannot all change include a shared one. Runs
are ordered by how often they occur (a fixed table of counts by hash, runs that occur once
first); each line takes the first ones in that order until d edits cannot change them all, so the
rarer of two such choices meets the other. Runs that occur once need no row at all. Pairs are
ruled out by their lengths and by the parity of their words' hashes (an edit changes two bits at
most), both before and after the run they have in common, before any words are moved.

Texts are cut into words once. Each line's words are stored once, by hash, and all later steps read those.

Groups of equal runs are compared in two steps: every line with the least line of its group, and
then, in groups that are not one component after that, the pairs of lines of unlike components.
Only lines that are not ruled out to match another one of their group get to the second step.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.shared import (Scratch, fresh, growing, majority_bits, pairs_within,
                               sorted_groups)
from quarry.llm.simhash import block_pairs

MIN_WORDS = 5
SIMILARITY = 0.8
RADIUS = 3
#: options of the whole job: every line that is not blank, and no bound but the edit similarity
WHOLE = {"min_words": 1, "radius": None}
BLOCK = 2048
#: blocks of a SimHash that name a pair within the radius
AGREE = 3
CACHE = 400_000
#: the bitmap that spares reading most texts again has 2^BITS bits
BITS = 26
#: lines of so many words have runs of q words: (q, least, most)
RUNS = ((2, 4, 10), (3, 9, 1 << 62))
#: at most 2^SLOTS bits tell which runs occur twice, and 2^COUNTS counters how often they do
SLOTS, COUNTS = 28, 20
#: pairs compared at once
SLICE = 1 << 17
#: words, or characters, that are handled at once
SOME = 1 << 18
#: longer lines take their runs by count alone
LONG = 1 << 14

WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\W_]+|\n")
#: scripts that part words by no blanks: Thai, Lao, Myanmar, Khmer, kana, Han
_UNPARTED = (r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
             r"\uf900-\ufaff\U00020000-\U0003ffff")
UNPARTED = re.compile(f"[{_UNPARTED}]")
FINE_TOKEN = re.compile(rf"(?=[^\W_])[{_UNPARTED}]|[^\W_{_UNPARTED}]+|\n")
#: what a line's end has in place of a word's hash
NEWLINE = -1
_DIGITS = re.compile(r"\d")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9),
        np.uint64(0x94D049BB133111EB))


class Words(dict):
    """token -> 63-bit hash of the word in lower case, or NEWLINE."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[token] = NEWLINE if token == "\n" else self.named(token)
        return h

    @staticmethod
    def named(word: str) -> int:
        return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) >> 1


class NormalWords(Words):
    """token -> 32-bit hash of the word's normal form, or NEWLINE: for SimHashes alone."""

    @staticmethod
    def named(word: str) -> int:
        return word_hash(word)


def word_hash(word: str) -> int:
    """32-bit hash of a word in lower case, digits as 0."""
    plain = word.lower()
    if not word.isalpha():
        plain = _DIGITS.sub("0", plain)
    return zlib.crc32(plain.encode("utf-8", "surrogatepass"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def line_keys(words: np.ndarray, bounds: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit names of non-empty word sequences given end to end, or other, ``second`` ones."""
    size = np.diff(bounds)
    place = np.arange(len(words)) - np.repeat(bounds[:-1], size)
    each = mix(words.astype(np.uint64) * _MIX[0])
    if second:
        each = mix(each + _MIX[2])
    key = np.add.reduceat(mix(each + place.astype(np.uint64) * _MIX[0]), bounds[:-1])
    return mix(key + size.astype(np.uint64))


def line_marks(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, simhash) of non-empty word sequences given end to end; neither looks past one."""
    size = np.diff(bounds)
    first = bounds[:-1]
    place = np.arange(len(words)) - np.repeat(first, size)
    each = mix(words.astype(np.uint64) * _MIX[0])
    # a line's features: its words, then its pairs of neighbours
    starts = 2 * first - np.arange(len(size))
    at = np.repeat(starts, size) + place
    features = np.empty(2 * len(words) - len(size), np.uint64)
    features[at] = each
    inner = np.ones(len(words), bool)
    inner[bounds[1:] - 1] = False
    pair = np.flatnonzero(inner)
    features[(at + np.repeat(size, size))[pair]] = mix(each[pair] * _MIX[0] + each[pair + 1])
    ends = np.append(starts, len(features))
    return line_keys(words, bounds), majority_bits(features, ends)


def tokens(text: str) -> list[str]:
    fine = not text.isascii() and UNPARTED.search(text)
    return (FINE_TOKEN if fine else TOKEN).findall(text)


def text_lines(texts: list, memory: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, line, words, bounds) of the lines of ``min_words`` or more words: the row of each
    line's text, its number, and the word hashes of all lines end to end with their bounds. For a
    ``min_words`` of 1, a line that is not blank but has no word has one, its characters."""
    texts = [(t or "") + "\n" for t in texts]
    ids = [np.fromiter(map(memory.__getitem__, found), np.int64, len(found))
           for found in map(tokens, texts)]
    if min_words <= 1:
        ids = [_signs(t, i, memory.named) for t, i in zip(texts, ids)]
    text = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    ends = np.flatnonzero(ids == NEWLINE)
    size = np.diff(np.append(-1, ends)) - 1
    owner = text[ends]
    number = np.arange(len(ends)) - np.searchsorted(owner, owner)
    keep = size >= max(min_words, 1)
    wanted = np.repeat(keep, size + 1)
    wanted[ends] = False
    return owner[keep], number[keep], ids[wanted], np.append(0, np.cumsum(size[keep]))


def _signs(text: str, ids: np.ndarray, named) -> np.ndarray:
    """``ids`` with one word for each line that has none and is not blank."""
    ends = np.flatnonzero(ids == NEWLINE)
    bare = np.flatnonzero(np.diff(np.append(-1, ends)) == 1)
    if len(bare) <= text.endswith("\n\n"):
        return ids
    rows = text.split("\n")
    bare = [n for n in bare.tolist() if rows[n].strip()]
    return np.insert(ids, ends[bare], [named(" " + rows[n].strip()) for n in bare])


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its kind (0 between words, 1 in a word, 2 newline, 3 a word of its
    own), the hash of its lower case, and whether that is no one character by itself."""
    if not _LETTERS:
        kind, odd = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
        plain = np.arange(0x110000, dtype=np.uint64)
        own = re.compile(rf"(?=[^\W_])[{_UNPARTED}]")
        for base in range(0, 0x110000, 0x4000):
            some = "".join(map(chr, range(base, base + 0x4000)))
            for value, pattern in ((1, WORD), (3, own)):
                for found in pattern.finditer(some):
                    kind[base + found.start():base + found.end()] = value
            if some != some.lower():
                for at, lower in enumerate(map(str.lower, some), base):
                    odd[at], plain[at] = len(lower) > 1, ord(lower[0])
        kind[10] = 2
        odd[0x3A3] = True                       # sigma, whose lower case depends on its place
        _LETTERS.extend((kind, _letter_hash(plain), odd))
    return tuple(_LETTERS)


_LETTERS: list[np.ndarray] = []


def _letter_hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * _MIX[0] + _MIX[1])


def _weights(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) * _MIX[2] + _MIX[0]) | np.uint64(1)


def _word_name(word: str) -> int:
    """What ``parsed_lines`` names a word by, from the word itself."""
    codes = np.frombuffer(word.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    total = (_letter_hash(codes) * _weights(len(codes))).sum(dtype=np.uint64)
    return int(mix(total + np.array([len(codes)], np.uint64) * _MIX[2])[0] >> np.uint64(1))


def parsed_lines(texts: list, min_words: int) -> tuple[np.ndarray, ...]:
    """What ``text_lines`` gives, by other 63-bit hashes of the words in lower case: all
    characters of the texts are taken at once."""
    texts = [t or "" for t in texts]
    if not texts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(1, np.int64),)
    letters = _letters()
    whole = "\n".join(texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = letters[0][codes]
    part = kind == 1
    start = kind == 3
    start[0] |= part[0]
    start[1:] |= part[1:] & ~part[:-1]
    at = np.flatnonzero(kind & 1)
    first = np.flatnonzero(start[at])
    size = np.diff(np.append(first, len(at)))
    starts = at[first]
    if len(first):
        weights = _weights(int(size.max()))
        places = np.arange(len(at)) - np.repeat(first, size)
        total = np.add.reduceat(letters[1][codes[at]] * weights[places], first)
        odd = np.add.reduceat(letters[2][codes[at]], first, dtype=np.int64) > 0
        words = (mix(total + size.astype(np.uint64) * _MIX[2]) >> np.uint64(1)).astype(np.int64)
        for x in np.flatnonzero(odd).tolist():
            words[x] = _word_name(whole[starts[x]:starts[x] + size[x]])
    else:
        words = np.zeros(0, np.int64)
    ends = np.flatnonzero(kind == 2)
    counts = np.array([t.count("\n") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(ends)) - np.repeat(np.cumsum(counts) - counts, counts)
    after = np.searchsorted(starts, ends)
    size = np.diff(after, prepend=0)
    if min_words <= 1:                         # a line without words stands for its characters
        begin = np.append(0, ends[:-1] + 1)
        bare = [(x, sign) for x in np.flatnonzero((size == 0) & (ends > begin)).tolist()
                if (sign := whole[begin[x]:ends[x]].strip())]
        if bare:
            rows = np.array([x for x, _ in bare])
            words = np.insert(words, after[rows], [_word_name(" " + sign) for _, sign in bare])
            size[rows] = 1
    keep = size >= max(min_words, 1)
    return (owner[keep], number[keep], words[np.repeat(keep, size)],
            np.append(0, np.cumsum(size[keep])))


class Lines:
    """Lines by their keys and their words, end to end with their bounds."""

    def __init__(self, key: np.ndarray, words: np.ndarray, bounds: np.ndarray):
        self.key, self.words, self.bounds = key, words, bounds
        self.size = np.diff(bounds)

    def runs(self, q: int, least: int, most: int) -> tuple[np.ndarray, ...]:
        """(line, place, hash) of the runs of q words, by line, of lines in the given range."""
        each = mix(self.words.astype(np.uint64) * _MIX[0])
        line = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(each)) - self.bounds[:-1][line]
        size = self.size[line]
        at = np.flatnonzero((size >= least) & (size <= most) & (place <= size - q))
        h = np.full(len(at), q, np.uint64)
        for x in range(q):
            h = mix(h * _MIX[0] + each[at + x])
        return line[at], place[at], h

    def parity(self, line: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """128 bits for the words of a line before a place in it, and 128 for the others: every
        word turns one of them over. As four 64-bit columns."""
        h = mix(self.words.astype(np.uint64) * _MIX[1] + _MIX[2])
        bit = np.uint64(1) << (h & np.uint64(63))
        high = (h >> np.uint64(6)) & np.uint64(1) == 1
        zero = np.uint64(0)
        begin, end = self.bounds[:-1][line], self.bounds[1:][line]
        out = []
        for some in (np.where(high, zero, bit), np.where(high, bit, zero)):
            up_to = np.append(zero, np.bitwise_xor.accumulate(some))
            at = up_to[begin + place]
            out += [at ^ up_to[begin], up_to[end] ^ at]
        return [out[x] for x in (0, 2, 1, 3)]


class Seen:
    """How often runs occur: bits of those seen once and twice, and counters. Both go by hash, so
    a run may be held to be more frequent than it is, never less."""

    def __init__(self, slots: int):
        self.slots = slots
        self.once = np.zeros(1 << (slots - 6), np.uint64)
        self.twice = np.zeros(1 << (slots - 6), np.uint64)
        self.count = np.zeros(1 << COUNTS, np.int64)

    def add(self, runs: np.ndarray) -> None:
        if not len(runs):
            return
        self.count += np.bincount((runs >> np.uint64(64 - COUNTS)).astype(np.int64),
                                  minlength=1 << COUNTS)
        slot, n = np.unique(runs & np.uint64((1 << self.slots) - 1), return_counts=True)
        word, bit = slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        at = word[first].astype(np.int64)
        new = np.bitwise_or.reduceat(bit, first)
        many = np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint64(0)), first)
        self.twice[at] |= many | (self.once[at] & new)
        self.once[at] |= new

    def order(self, runs: np.ndarray) -> np.ndarray:
        """Order of the runs, the rarest first: 0 for those that occur once."""
        slot = runs & np.uint64((1 << self.slots) - 1)
        often = self.twice[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))
        n = np.minimum(self.count[(runs >> np.uint64(64 - COUNTS)).astype(np.int64)], 1 << 30)
        out = (n.astype(np.uint64) << np.uint64(32) | (runs >> np.uint64(8)) & np.uint64(
            0xFFFFFFFF)) + np.uint64(1)
        return np.where(often & np.uint64(1) == 1, out, np.uint64(0))


#: words of a bitmap, or counters, in a row
PIECE = 1 << 14


def packed_words(column) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of a binary Arrow column without nulls that holds 64-bit words."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    words = (np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None
             else np.zeros(0, np.uint8))
    return words.view(np.int64), (bounds.astype(np.int64) - bounds[0]) // 8


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of together at most ``most`` in size, or of one item."""
    ends, x = np.append(0, np.cumsum(sizes)), 0
    while x < len(sizes):
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + most, "right")) - 1)
        yield x, y
        x = y


def _some_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[Lines]:
    """(key, words) -> the lines of about SOME words at a time."""
    for batch in batches:
        key = batch.column(0).to_numpy().view(np.uint64)
        words, bounds = packed_words(batch.column(1))
        for x, y in cuts(np.diff(bounds), SOME):
            yield Lines(key[x:y], words[bounds[x]:bounds[y]], bounds[x:y + 1] - bounds[x])


def _count_runs(slots: int):
    """(key, words) -> compressed pieces (kind, piece, a, b) of a task's ``Seen``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(slots)
        for lines in _some_lines(batches):
            for q, least, most in RUNS:
                seen.add(lines.runs(q, least, most)[2])
        yield from _pieces(seen)
    return run


def _count_taken(slots: int):
    """(run) -> pieces of a task's ``Seen`` of the runs that were taken, under other hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(slots)
        for batch in batches:
            seen.add(again(batch.column(0).to_numpy()))
        yield from _pieces(seen)
    return run


def again(runs: np.ndarray) -> np.ndarray:
    """Hashes of runs that are apart from those of their first count."""
    return mix(runs.view(np.uint64) * _MIX[0] + _MIX[2])


def _shared_runs(seen):
    """Rows (run, ...) -> those whose run may have been taken twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often = seen.value.order(again(batch.column(0).to_numpy())) > 0
            yield batch.filter(pa.array(often))
    return run


def _pieces(seen: Seen) -> Iterator[pa.RecordBatch]:
    for kind, a, b in ((0, seen.once, seen.twice), (1, seen.count, seen.count[:0])):
        for x in range(0, len(a), PIECE):
            if a[x:x + PIECE].any():
                yield _piece(kind, x // PIECE, a[x:x + PIECE], b[x:x + PIECE])


def _piece(kind: int, at: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([at], pa.int32()),
         *[pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (a, b)]],
        names=["kind", "piece", "a", "b"])


def _merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, a, b = None, None, None
    for batch in batches:
        for kind, at, x, y in zip(*[c.to_pylist() for c in batch.columns]):
            x, y = (np.frombuffer(zlib.decompress(z), np.uint64) for z in (x, y))
            if name != (kind, at):
                if name:
                    yield _piece(*name, a, b)
                name, a, b = (kind, at), x.copy(), y.copy()
            elif kind:
                a += x
            else:
                b |= y | (a & x)
                a |= x
    if name:
        yield _piece(*name, a, b)


def run_counts(lines: DataFrame) -> Seen:
    """How often the runs of distinct lines occur, from one scan. What reaches the driver is of
    fixed size, 2^SLOTS bits and 2^COUNTS counters at most."""
    words = (lines.agg(F.sum(F.length("words"))).first()[0] or 0) // 8
    slots = min(SLOTS, max(18, int(2 * words).bit_length()))
    return _counted(lines, _count_runs(slots), slots)


def _counted(rows: DataFrame, count, slots: int) -> Seen:
    schema = "kind int, piece int, a binary, b binary"
    # every task has a filter of its own, so there are no more tasks than cores
    pieces = (rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
              .mapInArrow(count, schema)
              .repartition("kind", "piece").sortWithinPartitions("kind", "piece")
              .mapInArrow(_merge_pieces, schema).select("kind", "piece", F.when(
                  F.col("kind") == 1, F.col("a")).otherwise(F.col("b")).alias("bits")))
    out = Seen(slots)
    out.once = None
    for kind, piece, bits in pieces.collect():
        into = out.count.view(np.uint64) if kind else out.twice
        bits = np.frombuffer(zlib.decompress(bits), np.uint64)
        into[piece * PIECE:piece * PIECE + len(bits)] = bits
    return out


def edits(size, similarity: float):
    """The most edits within which a line of ``size`` words can be similar to another one."""
    longest = np.floor(size / similarity + 1e-9)
    return np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)


def _lasting(starts: np.ndarray, ends: np.ndarray, place: np.ndarray, taken: np.ndarray, q: int,
             need: np.ndarray) -> np.ndarray:
    """For lines with the runs starts:ends, whether ``need`` edits cannot change all the taken
    runs: whether there are more of them that do not overlap, each the first one possible."""
    n = len(place)
    after = np.where(taken, np.arange(n), n)
    after = np.append(np.minimum.accumulate(after[::-1])[::-1], n)
    left, count, live = starts.copy(), np.zeros(len(starts), np.int64), np.arange(len(starts))
    while len(live):
        at = after[np.minimum(left[live], n)]
        ok = at < ends[live]
        live, at = live[ok], at[ok]
        count[live] += 1
        left[live] = at + q
        live = live[count[live] <= need[live]]
    return count > need


def chosen_runs(line: np.ndarray, place: np.ndarray, order: np.ndarray, q: int,
                need: np.ndarray) -> np.ndarray:
    """Which runs each line takes: all up to the least order at which ``need`` (by line) edits
    cannot change all of them. Those of order 0 are left out: no other line has them."""
    if not len(line):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    ends = np.append(starts[1:], len(line))
    need = need[line[starts]]
    size = ends - starts
    far = np.zeros(len(starts), np.uint64)             # the greatest order to take
    rest = np.flatnonzero(~_lasting(starts, ends, place, order == 0, q, need))
    if len(rest):
        within = np.repeat(np.arange(len(starts)), size)
        ranked = order[np.lexsort((order, within))]
        low, high = np.zeros(len(starts), np.int64), np.minimum(q * need, size - 1)
        far[rest] = ranked[(starts + high)[rest]]
        live = rest[size[rest] <= LONG]
        while len(live):                               # the first rank that is enough
            mid = (low[live] + high[live]) // 2
            limit = np.zeros(len(starts), np.uint64)
            limit[live] = ranked[starts[live] + mid]
            ok = _lasting(starts[live], ends[live], place, order <= limit[within], q, need[live])
            high[live[ok]], low[live[~ok]] = mid[ok], mid[~ok] + 1
            live = live[low[live] < high[live]]
        short = rest[size[rest] <= LONG]
        far[short] = ranked[starts[short] + high[short]]
    return (order > 0) & (order <= np.repeat(far, size))


#: what is known of a run in a line: the line and its words, the run's place, and the parities of
#: the words before it and of the others; a run that a line has more than once has the place -1,
#: and no words before it
TAKEN = "run long, key long, n int, at int, p long, r long, s long, t long"


def _take_runs(similarity: float, seen):
    """(key, words) -> the runs that each line takes, as TAKEN."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _some_lines(batches):
            need = edits(lines.size, similarity)
            found = []
            for q, least, most in RUNS:
                line, place, h = lines.runs(q, least, most)
                take = chosen_runs(line, place, seen.value.order(h), q, need)
                found.append((line[take], place[take], h[take]))
            line, place, h = (np.concatenate(c) for c in zip(*found))
            by = np.lexsort((h, line))
            line, place, h = line[by], place[by], h[by]
            new = np.append(True, (line[1:] != line[:-1]) | (h[1:] != h[:-1]))[:len(line)]
            many = np.diff(np.append(np.flatnonzero(new), len(line))) > 1
            line, place, h = line[new], np.where(many, -1, place[new]), h[new]
            if len(line):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(lines.key[line].view(np.int64)),
                     pa.array(lines.size[line], pa.int32()), pa.array(place, pa.int32()),
                     *[pa.array(x.view(np.int64))
                       for x in lines.parity(line, np.maximum(place, 0))]],
                    names=[c.split()[0] for c in TAKEN.split(", ")])
    return run


def _spots(min_words: int, with_sim: bool):
    """(id, th, text) -> one row per line of ``min_words`` or more words; the first one of a key
    in a task has its words, and the SimHash (else 0) of the words' normal forms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, known = NormalWords(), set()
        for batch in batches:
            length = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            for x, y in cuts(length + 1, 2 * SOME):
                some = batch.slice(x, y - x)
                texts = some.column(2).to_pylist()
                owner, number, words, bounds = parsed_lines(texts, min_words)
                if not len(owner):
                    continue
                keys = [line_keys(words, bounds, k) for k in (False, True)]
                sim = np.zeros(len(owner), np.uint64)
                if with_sim:                    # the same lines by other names of their words
                    sim = line_marks(text_lines(texts, normal, min_words)[2], bounds)[1]
                new = np.zeros(len(owner), bool)
                for at, key in enumerate(keys[0].tolist()):
                    if key not in known:
                        if len(known) >= CACHE:
                            known.clear()
                        known.add(key)
                        new[at] = True
                size = np.where(new, np.diff(bounds), 0)
                data = words[np.repeat(new, np.diff(bounds))]
                ends = np.append(0, 8 * np.cumsum(size)).astype(np.int32)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(rows), some.column(1).take(rows),
                     pa.array(number, pa.int32()),
                     *[pa.array(k.view(np.int64)) for k in (*keys, sim)],
                     pa.BinaryArray.from_buffers(
                         pa.binary(), len(owner),
                         [pa.py_buffer(np.packbits(new, bitorder="little")), pa.py_buffer(ends),
                          pa.py_buffer(data)])],
                    names=["id", "th", "line", "key", "key2", "sim", "words"])
    return run


def _marked(wanted, inside: bool = True):
    """Rows (key, ...) that a broadcast bitmap of keys may hold, or those that it does not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = bit_of(batch.column(0).to_numpy().view(np.uint64))
            bits = wanted.value[place >> np.uint64(6)] >> (place & np.uint64(63))
            held = (bits & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(held == inside))
    return run


def distinct_lines(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, sim, words): one row per key of the lines with words. Only keys that more than one
    task may have are shuffled with their words."""
    held = found.filter(F.col("words").isNotNull()).select("key", "words", "sim")
    twice = held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    copied = _bitmap(twice.select("key"))
    once = held.mapInArrow(_marked(copied, inside=False), held.schema)
    rest = held.mapInArrow(_marked(copied), held.schema).dropDuplicates(["key"])
    out = scratch.keep(once.unionByName(rest), "distinct")
    copied.destroy()
    return out


def bit_of(name: np.ndarray) -> np.ndarray:
    """Place of a 64-bit hash in a bitmap of 2^BITS bits: its low bits."""
    return name & np.uint64((1 << BITS) - 1)


def _bitmap(names: DataFrame):
    """The bitmap of a column ``key``: 2^BITS bits (8 MB) whatever the table's size. It only
    spares rows that an exact join would drop, or a shuffle."""
    table = (names.select(F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)).alias("p"))
             .selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit")
             .groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[table.w.to_numpy(dtype=np.int64)] = table.bits.to_numpy(dtype=np.int64).view(np.uint64)
    return names.sparkSession.sparkContext.broadcast(out)


def word_edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two word sequences, bit-parallel over whole integers."""
    a, b = a.tolist(), b.tolist()
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    if not a or not b:
        return len(a) + len(b)
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for w in b:
        eq = at.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(zero | up)), up & zero
        distance += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(zero | more)), more & zero
    return distance


def block_masks(radius: int) -> list[int]:
    """Masks of the radius + AGREE blocks, almost equal parts of the 64 bits."""
    n = radius + AGREE
    cut = [64 * k // n for k in range(n + 1)]
    return [(1 << cut[k + 1]) - (1 << cut[k]) for k in range(n)]


def key_table(radius: int) -> np.ndarray:
    """Number of the join key of each set of AGREE blocks, given as a bit set."""
    n = radius + AGREE
    out = np.full(1 << n, -1)
    for k, blocks in enumerate(itertools.combinations(range(n), AGREE)):
        out[sum(1 << x for x in blocks)] = k
    return out


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def slices(starts: np.ndarray, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups, about ``most`` at a time: small groups together, large ones in
    slices of rows."""
    size = np.diff(starts)
    pairs = np.concatenate(([0], np.cumsum(size * (size - 1) // 2)))
    g = 0
    while g < len(size):
        if pairs[g + 1] - pairs[g] > most:
            end = starts[g + 1]
            step = max(1, most // int(size[g]))
            for x in range(starts[g], end, step):
                rows = np.arange(x, min(x + step, end))
                after = end - rows - 1
                a = np.repeat(rows, after)
                first = np.cumsum(after) - after
                yield a, a + 1 + np.arange(len(a)) - np.repeat(first, after)
            g += 1
            continue
        h = max(g + 1, int(np.searchsorted(pairs, pairs[g] + most, "right")) - 1)
        yield pairs_within(starts[g:h + 1])
        g = h


def may_match(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray,
              similarity: float) -> np.ndarray:
    """For rows (n, at, p, r, s, t) of one run, the pairs a, b of rows whose lines are not ruled
    out by the lengths and the parities before and after that run."""
    n, at, p, r, s, t = rows
    most = np.floor((1 - similarity) * np.maximum(n[a], n[b]) + 1e-9)
    # without a place for the run, whole lines are compared
    known = (at[a] >= 0) & (at[b] >= 0)
    before = np.where(known, np.abs(at[a] - at[b]), 0)
    after = np.abs(n[a] - n[b] - np.where(known, at[a] - at[b], 0))
    ok = np.flatnonzero(before + after <= most)
    a, b, most, known, before, after = (x[ok] for x in (a, b, most, known, before, after))
    one, two = p[a] ^ p[b], r[a] ^ r[b]
    odd = np.bitwise_count(one).astype(np.int32) + np.bitwise_count(two)
    before = np.maximum(before, np.where(known, (odd + 1) // 2, 0))
    zero = np.uint64(0)
    one = s[a] ^ s[b] ^ np.where(known, zero, one)
    two = t[a] ^ t[b] ^ np.where(known, zero, two)
    odd = np.bitwise_count(one).astype(np.int32) + np.bitwise_count(two)
    after = np.maximum(after, (odd + 1) // 2)
    return ok[before + after <= most]


def _signatures(rows: pa.Table, first: int) -> list[np.ndarray]:
    """The columns n, at, p, r, s and t, from number ``first`` on."""
    cols = [rows.column(x).to_numpy() for x in range(first, first + 6)]
    return cols[:2] + [c.view(np.uint64) for c in cols[2:]]


def _open_rows(similarity: float, block: int):
    """Rows (run, key, n, ..., size, star), groups of a run together -> those with a star, and
    those that are ``open``: not ruled out to match a line of their group but its least one. In
    groups of more than ``block`` rows, all are taken for open."""
    def marked(rows: pa.Table, open_: np.ndarray) -> list[pa.RecordBatch]:
        star = rows.column(9).is_valid().to_numpy()
        out = rows.append_column("open", pa.array(open_))
        return out.filter(pa.array(open_ | star)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = []

        def small():
            for batch in batches:
                many = batch.column(8).to_numpy() > block
                if many.any():
                    some = pa.Table.from_batches([batch]).filter(pa.array(many))
                    large.extend(marked(some, np.ones(some.num_rows, bool)))
                    batch = batch.filter(pa.array(~many))
                yield batch

        rest = small()
        for rows, starts in sorted_groups(rest, 1):
            yield from large
            large.clear()
            key, signature = rows.column(1).to_numpy(), _signatures(rows, 2)
            least = np.repeat(np.minimum.reduceat(key, starts[:-1]), np.diff(starts)) == key
            open_ = np.zeros(len(key), bool)
            for a, b in slices(starts):
                other = np.flatnonzero(~(least[a] | least[b]))
                other = other[may_match(signature, a[other], b[other], similarity)]
                open_[a[other]] = open_[b[other]] = True
            yield from marked(rows, open_)
        yield from large
    return run


def _across(similarity: float):
    """Sorted groups (run, i, j, c, key, n, at, p, r, s, t) -> pairs of keys of unlike components c
    that are not ruled out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in sorted_groups(batches, 3):
            c, key = (rows.column(x).to_numpy() for x in (3, 4))
            signature = _signatures(rows, 5)
            for a, b in slices(starts):
                ok = c[a] != c[b]
                a, b = a[ok], b[ok]
                ok = may_match(signature, a, b, similarity)
                a, b = key[a[ok]], key[b[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                        names=["a", "b"])
    return run


def _similar(similarity: float, radius: int | None):
    """(a, b, sim, words, other sim, other words) -> the pairs (a, b) that are links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            if radius is not None:
                s, t = (batch.column(x).to_numpy().view(np.uint64) for x in (2, 4))
                ok = np.bitwise_count(s ^ t) <= radius
            (x, u), (y, v) = (packed_words(batch.column(c)) for c in (3, 5))
            for row in np.flatnonzero(ok).tolist():
                one, two = x[u[row]:u[row + 1]], y[v[row]:v[row + 1]]
                most = (1 - similarity) * max(len(one), len(two)) + 1e-9
                ok[row] = word_edit_distance(one, two) <= most
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def _links(pairs: DataFrame, lines: DataFrame, similarity: float, radius: int | None,
           scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of line keys that are links."""
    pairs = scratch.keep(pairs.distinct(), "pairs")
    keys = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    wanted = _bitmap(keys)
    worded = scratch.keep(lines.mapInArrow(_marked(wanted), lines.schema)
                          .join(growing(keys), "key", "left_semi"), "words")
    one = worded.select(F.col("key").alias("a"), F.col("sim").alias("s"),
                        F.col("words").alias("u"))
    two = worded.select(F.col("key").alias("b"), F.col("sim").alias("t"),
                        F.col("words").alias("v"))
    full = (pairs.join(growing(one), "a").join(growing(two), "b")
            .select("a", "b", "s", "u", "t", "v"))
    links = scratch.keep(full.mapInArrow(_similar(similarity, radius), "a long, b long"), "links")
    scratch.drop(pairs, keys, worded)
    wanted.destroy()
    return links


def _close(one: str, similarity: float):
    """Whether lengths and parities do not rule out that a row's line and the one in ``one`` are
    similar, given that their run is the same one."""
    of = lambda c: F.col(f"{one}.{c}")
    most = F.floor(F.lit(1 - similarity) * F.greatest("n", of("n")) + 1e-9)
    known = (F.col("at") >= 0) & (of("at") >= 0)
    moved = F.when(known, F.col("at") - of("at")).otherwise(0)
    p, r, s, t = (F.col(c).bitwiseXOR(of(c)) for c in ("p", "r", "s", "t"))
    none = F.lit(0).cast("long")
    half = lambda x, y: F.ceil((F.bit_count(x) + F.bit_count(y)) / 2)
    before = F.when(known, F.greatest(F.abs(moved), half(p, r))).otherwise(none)
    after = F.greatest(F.abs(F.col("n") - of("n") - moved),
                       half(s.bitwiseXOR(F.when(known, none).otherwise(p)),
                            t.bitwiseXOR(F.when(known, none).otherwise(r))))
    # without a place for the run, whole lines are compared
    return (F.col("key") != of("key")) & (before + after <= most)


def line_groups(lines: DataFrame, similarity: float, radius: int | None, block: int,
                scratch: Scratch) -> DataFrame:
    """lines (key, words, sim) -> (node, component) of the keys that are linked to another one."""
    if similarity < 0.8:
        raise ValueError("the runs of RUNS are complete for a similarity of 0.8 or more")
    context = lines.sparkSession.sparkContext
    named = lines.select("key", "words")
    seen = context.broadcast(run_counts(named))
    taken = scratch.keep(named.mapInArrow(_take_runs(similarity, seen), TAKEN), "runs")
    # rows whose run no other line took go before any is shuffled
    slots = min(SLOTS, max(18, (4 * taken.count()).bit_length()))
    twice = context.broadcast(_counted(taken.select("run"), _count_taken(slots), slots))
    # the least line of a group is compared with all others here, the others among them below
    held = ["key", "n", "at", "p", "r", "s", "t"]
    group = Window.partitionBy("run")
    grouped = taken.mapInArrow(_shared_runs(twice), TAKEN).select(
        "run", *held, F.min(F.struct(*held)).over(group).alias("one"),
        F.max("key").over(group).alias("last"), F.count("*").over(group).alias("size"))
    grouped = grouped.filter("one.key <> last").select(
        "run", *held, "size", F.when(_close("one", similarity), F.col("one.key")).alias("star"))
    shared = scratch.keep(grouped.sortWithinPartitions("run").mapInArrow(
        _open_rows(similarity, block), f"{TAKEN}, size long, star long, open boolean"), "shared")
    scratch.drop(taken)
    for sent in (seen, twice):
        sent.destroy()
    stars = shared.filter(F.col("star").isNotNull()).select(
        F.col("star").alias("a"), F.col("key").alias("b"))
    options = (lines, similarity, radius, scratch)
    links = _links(stars, *options)
    parts = scratch.keep(connected_components(links, scratch), "parts")
    left = shared.filter("open")
    placed = scratch.keep(left.join(growing(parts), F.col("key") == F.col("node"), "left").select(
        "run", "size", F.coalesce("component", "key").alias("c"), *held), "placed")
    scratch.drop(shared, links)
    parted = placed.groupBy("run").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    parted = parted.filter("low <> high").select("run")
    dealt = block_pairs(placed.join(growing(parted), "run"), "size", "key", block)
    dealt = (dealt.select("run", "i", "j", "c", *held)
             .repartition("run", "i", "j").sortWithinPartitions("run", "i", "j"))
    more = _links(dealt.mapInArrow(_across(similarity), "a long, b long"), *options)
    if more.isEmpty():
        return parts
    return connected_components(more.unionByName(parts.select(
        F.col("node").alias("a"), F.col("component").alias("b"))), scratch)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, radius: int | None = RADIUS,
                   similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, th, line) of every line that is to go: an occurrence, other than the first by id,
    text hash and line number, of a group of similar lines. ``th`` is xxhash64 of the text, so
    rows that repeat both id and text are one document. Lines are parted by newlines; those of
    fewer than ``min_words`` words always stay, and lines whose SimHashes differ in more than
    ``radius`` bits are not linked (None: whatever their SimHashes). ``WHOLE`` has neither bound.
    Null texts have no lines; a null id comes first.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    found = scratch.keep(rows.mapInArrow(
        _spots(min_words, radius is not None),
        "id long, th long, line int, key long, key2 long, sim long, words binary"), "found")
    lines = distinct_lines(found, scratch)
    spots = scratch.keep(found.select("id", "th", "line", "key", "key2").distinct(), "spots")
    scratch.drop(found)
    groups = line_groups(lines, similarity, radius, block, scratch)
    place = F.struct("id", "th", "line")
    # equal lines agree in both keys; a linked line goes by its group, any other by itself
    by_key = spots.groupBy("key", "key2").agg(F.min(place).alias("first"),
                                              F.count("*").alias("n"))
    alone = F.col("node").isNull()
    root = F.struct(F.coalesce("component", "key").alias("a"),
                    F.when(alone, F.col("key2")).otherwise(0).alias("b"))
    found = by_key.join(growing(groups), F.col("key") == F.col("node"), "left")
    rooted = scratch.keep(found.select("key", "key2", "first", "n", root.alias("root")), "rooted")
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all"))
    told = rooted.join(growing(kept.filter(F.col("all") > 1)), "root").select("key", "key2", "kept")
    return (spots.join(growing(told), ["key", "key2"]).filter(~place.eqNullSafe(F.col("kept")))
            .select("id", "th", "line"))


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """One row per document: id, n_lines, and removed (its lines that go, from 0, ascending).
    An empty or null text has one line, and none to remove."""
    gone = repeated_lines(docs, id_col, text_col, **options).groupBy("id", "th").agg(
        F.sort_array(F.collect_list("line")).alias("gone"))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                       F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
                       .alias("n_lines"))
    return rows.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")),
                     "left").select(F.col("_id").alias(id_col), "n_lines",
                                    F.coalesce("gone", F.array().cast("array<int>"))
                                    .alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """``docs`` without the lines that go. A document that loses lines and has no word left is
    left out; all others keep every other column."""
    columns = docs.columns
    lost, key, name = (fresh(c, columns) for c in ("lost", "key", "name"))
    gone = repeated_lines(docs, id_col, text_col, **options).groupBy("id", "th").agg(
        F.collect_list("line").alias(lost)).select(
            F.col("id").alias(key), F.col("th").alias(name), lost)
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(key))
                       & (F.xxhash64(F.col(text_col)) == F.col(name)), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = columns.index(text_col)
        for batch in batches:
            texts, keep = [], []
            for text, gone in zip(batch.column(place).to_pylist(),
                                  batch.column(len(columns)).to_pylist()):
                if gone is not None:
                    cut = set(gone)
                    text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in cut)
                texts.append(text)
                keep.append(gone is None or WORD.search(text) is not None)
            cols = list(batch.columns[:len(columns)])
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep, pa.bool_()))

    return joined.select(*columns, lost).mapInArrow(run, docs.schema)
