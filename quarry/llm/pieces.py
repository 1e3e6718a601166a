"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

A text is normalised (a blank in front, blanks as U+2581) and cut where a blank follows another
character: no piece of a model that splits at white space reaches over such a place. The
distinct words of a batch are encoded together as flat arrays of symbols: each round looks up
the rank of every adjacent pair, takes the least rank of each word's segment, merges at its
leftmost place, and at all its other places too if no merge that this makes possible could come
first, then compacts the arrays. Words without a pair left drop out. What no piece covers falls
back to bytes. Ids are then gathered back into documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLANK = "▁"
#: what the unknown id decodes to (fixed by the library)
UNKNOWN = " ⁇ "
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: words of a task that are remembered before the memory is emptied, and the longest such
CACHE, CACHED_LENGTH = 300_000, 64
#: symbols that are merged in one call
SYMBOLS = 1 << 20
#: symbols above which a word is merged through a queue
LONG = 512
NEVER = np.int64(1) << 40
NONE = -(1 << 40)


@dataclass
class Pieces:
    """The pieces of a byte-pair model: texts, merge ranks and ids."""

    texts: list[str]
    ranks: np.ndarray                    # by id: less is merged first
    ids: dict[str, int]
    bytes_at: list[int]                  # id of each byte's piece
    control: frozenset[int]              # begin, end and the like: no text
    unknown: int
    add_blank: bool
    keys: np.ndarray = field(init=False)
    made: np.ndarray = field(init=False)
    alone: np.ndarray = field(init=False)
    lookup: dict[int, int] | None = field(init=False, default=None)

    def __post_init__(self):
        """The pairs of pieces that make a piece, sorted, and for each piece whether all its
        places in a word can be merged at once: no piece that is made of it and another one
        ranks as early as it does."""
        pairs = [(self.ids[p[:i]] * len(self.texts) + self.ids[p[i:]], k)
                 for p, k in self.ids.items() for i in range(1, len(p))
                 if p[:i] in self.ids and p[i:] in self.ids]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([m for _, m in pairs], np.int64)
        self.alone = np.zeros(len(self.texts), bool)
        for side in (self.keys // len(self.texts), self.keys % len(self.texts)):
            early = self.ranks[self.made] <= self.ranks[side]
            self.alone[side[early]] = True

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a model file. Only byte-pair models with byte pieces, whose pieces have blanks
        only in front and whose normaliser leaves texts as they are, are accepted."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i)
                                             or sp.is_unknown(i) or sp.is_unused(i))]
        octets = {int(texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        probe = " Å  ﬁ①\t\n x "
        add_blank = sp.decode(sp.encode("a")) == "a" and sp.id_to_piece(
            sp.encode("a")[0]).startswith(BLANK)
        if (len(octets) != 256 or any(BLANK in texts[i].lstrip(BLANK) for i in plain)
                or sp.decode(sp.encode(probe)) != probe):
            raise ValueError(f"{path} is not a model that this encoder covers")
        scores = np.array([sp.get_score(i) for i in plain])
        _, order = np.unique(-scores, return_inverse=True)
        ranks = np.full(n, NEVER, np.int64)
        ranks[plain] = order
        control = frozenset(i for i in range(n) if sp.is_control(i))
        return cls(texts, ranks, {texts[i]: i for i in plain},
                   [octets[b] for b in range(256)], control, sp.unk_id(), add_blank)

    # ------------------------------------------------------------------ encoding
    def words(self, text: str | None) -> list[str]:
        """The independent parts of a normalised text."""
        if not text:
            return []
        return WORD.findall((BLANK if self.add_blank else "") + text.replace(" ", BLANK))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word; long lists are cut into calls of about SYMBOLS symbols, and a
        word above LONG symbols goes through a queue of its own."""
        long = {i: self._queue(w) for i, w in enumerate(words) if len(w) > LONG}
        if long:
            rest = iter(self.encode_words([w for w in words if len(w) <= LONG]))
            return [long[i] if i in long else next(rest) for i in range(len(words))]
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (end == at or size + len(words[end]) <= SYMBOLS):
                size += len(words[end])
                end += 1
            out += self._rounds(words[at:end])
            at = end
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; -1 if none, or where the two are ``apart``."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left * len(self.texts) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0) & ~apart
        return np.where(ok, self.made[at], -1)

    def _rounds(self, words: list[str]) -> list[np.ndarray]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(chars, return_inverse=True)
        first = np.array([self.ids.get(chr(c), -1) for c in kinds.tolist()], np.int64)
        # symbols: piece id, or -1 - code point where no piece is
        sym = np.where(first >= 0, first, -1 - kinds.astype(np.int64))[inverse]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word, done_at = [], [], []
        at = np.arange(len(sym))
        made = self._pairs(sym, np.append(sym[1:], -1), np.append(word[1:] != word[:-1], True))
        while len(sym):
            rank = np.where(made >= 0, self.ranks[made], NEVER)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(least < NEVER, sizes)
            if not open_.all():                     # finished words leave the arrays
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                done_at.append(at[~open_])
                sym, word, at, made, rank = (x[open_] for x in (sym, word, at, made, rank))
                if not len(sym):
                    break
                sizes, least = sizes[least < NEVER], least[least < NEVER]
            place = np.flatnonzero(rank == np.repeat(least, sizes))
            head = np.append(True, word[place[1:]] != word[place[:-1]])
            # the leftmost place of each word; the others too unless a piece must go alone,
            # and then every second one of places that touch
            order = np.arange(len(place))
            run = np.append(True, place[1:] != place[:-1] + 1) | head
            step = order - np.maximum.accumulate(np.where(run, order, 0))
            firsts = np.flatnonzero(head)
            solo = np.logical_or.reduceat(self.alone[made[place]], firsts)[np.cumsum(head) - 1]
            take = place[head | (~solo & (step % 2 == 0))]
            sym[take] = made[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            now = np.cumsum(keep)[take] - 1         # where the merged symbols stand afterwards
            sym, word, at, made = (x[keep] for x in (sym, word, at, made))
            if len(sym):                            # only pairs beside a merge have changed
                beside = np.zeros(len(sym), bool)
                beside[now] = beside[np.maximum(now - 1, 0)] = True
                near = np.flatnonzero(beside)
                after = np.minimum(near + 1, len(sym) - 1)
                made[near] = self._pairs(sym[near], sym[after],
                                         (after == near) | (word[after] != word[near]))
        sym, at = np.concatenate([*done_sym, sym]), np.concatenate([*done_at, at])
        word = np.concatenate([*done_word, word])
        order = np.argsort(at, kind="stable")
        sym, word = self._bytes(sym[order], word[order])
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        return [sym[x:y] for x, y in zip(cuts, cuts[1:])]

    def _queue(self, text: str) -> np.ndarray:
        """Ids of one very long word: the same merges, one at a time from a priority queue, as
        rounds that merge one place each would take time with the square of its length."""
        n = len(self.texts)
        if self.lookup is None:
            self.lookup = dict(zip(self.keys.tolist(), self.made.tolist()))
        lookup, ranks = self.lookup, self.ranks.tolist()
        sym = [self.ids.get(c, -1 - ord(c)) for c in text]
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        queue: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0:
                made = lookup.get(sym[i] * n + sym[j], -1)
                if made >= 0:
                    heapq.heappush(queue, (ranks[made], i, j, sym[i], sym[j], made))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b, made = heapq.heappop(queue)
            if sym[i] != a or sym[j] != b or right[i] != j:
                continue                            # one of the two has been merged since
            sym[i], sym[j] = made, NONE
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        kept = np.array([s for s in sym if s != NONE], np.int64)
        return self._bytes(kept, np.zeros(len(kept), np.int64))[0]

    def _bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace what no piece covers by the pieces of its UTF-8 bytes."""
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, word
        octets = [[self.bytes_at[b] for b in chr(-1 - s).encode("utf-8", "replace")]
                  for s in sym[odd].tolist()]
        count = np.ones(len(sym), np.int64)
        count[odd] = [len(o) for o in octets]
        ends = np.cumsum(count)
        sym, word = np.repeat(sym, count), np.repeat(word, count)
        for at, ids in zip((ends[odd] - count[odd]).tolist(), octets):
            sym[at:at + len(ids)] = ids
        return sym, word

    # ------------------------------------------------------------------ decoding
    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes end to end and their bounds; control pieces are empty."""
        parts = [b"" if i in self.control else t.replace(BLANK, " ").encode("utf-8")
                 for i, t in enumerate(self.texts)]
        parts[self.unknown] = UNKNOWN.encode("utf-8")
        for value, i in enumerate(self.bytes_at):
            parts[i] = bytes([value])
        return (np.frombuffer(b"".join(parts), np.uint8),
                np.concatenate(([0], np.cumsum([len(p) for p in parts]))))

    def decode(self, ids: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> str:
        """The text of a row of ids: bytes of all pieces, less the blank that encoding put in
        front; bytes that are no UTF-8 become U+FFFD, one for each byte."""
        ids = np.asarray(ids, np.int64)
        size = bounds[ids + 1] - bounds[ids]
        first = np.cumsum(size) - size
        index = np.repeat(bounds[ids] - first, size) + np.arange(size.sum())
        raw = flat[index].tobytes()
        lead = next((i for i in ids.tolist() if i not in self.control), None)
        if self.add_blank and lead is not None and self.texts[lead].startswith(BLANK):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


class Memory(dict):
    """word -> ids, for the words that a task has met."""


def _encode_batch(model: Pieces, memory: Memory, texts: list) -> list[np.ndarray]:
    cut = [model.words(t) for t in texts]
    if len(memory) > CACHE:
        memory.clear()
    new = list({w for words in cut for w in words if w not in memory})
    for w, ids in zip(new, model.encode_words(new)):
        memory[w] = ids
    none = np.zeros(0, np.int64)
    out = [np.concatenate([memory[w] for w in words]) if words else none for words in cut]
    for w in new:
        if len(w) > CACHED_LENGTH:
            del memory[w]
    return out


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str = "decoded", rows: int = 512) -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>), the text's ids without begin or end, and
    ``decoded_col``, the text that the ids decode to.

    ``path`` is the model file, at the same place on every executor. Whole texts are encoded,
    ``rows`` of them at a time; null and empty texts have no ids and decode to an empty text.
    Columns that already bear the new names are replaced.
    """
    kept = docs.drop(*[c for c in (ids_col, decoded_col) if c in docs.columns and c != text_col])
    columns = kept.columns
    Pieces.load(path)                    # refuse an unfit model before any task starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = Pieces.load(path), Memory()
        flat, bounds = model.decoder()
        for whole in batches:
            for x in range(0, whole.num_rows, rows):
                batch = whole.slice(x, rows)
                ids = _encode_batch(model, memory,
                                    batch.column(columns.index(text_col)).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
                flat_ids = np.concatenate(ids) if ids else np.zeros(0)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 pa.array(flat_ids, pa.int32()))
                texts = pa.array([model.decode(i, flat, bounds) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts],
                                                 names=[*columns, ids_col, decoded_col])

    return kept.mapInArrow(run, T.StructType(
        [*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)),
         T.StructField(decoded_col, T.StringType())]))
