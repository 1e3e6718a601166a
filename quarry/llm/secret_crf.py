"""Secret spans: fixed patterns, and a linear-chain conditional random field on top.

The patterns find the base spans. The field tags the tokens of each line as beginning a secret,
inside one or outside, from the token's shape, the neighbouring words and features of the file,
decoded by Viterbi; its spans are added where they do not touch a base span. It is trained on
windows of at most ``train_rows`` documents in which the patterns hit, and as many others, with
the patterns' values as labels.

A token's score is a sum over feature weights of itself and its neighbours, so each distinct
token is looked at once per task. Lines in which no token's best tag beats "outside", even with
the best transitions that can lead to it and out, need no decoding: the path of "outside" alone
is optimal there.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch, fresh

#: at most so many documents with base spans, and as many without, are used to fit
TRAIN_ROWS = 1000
#: tokens on either side of a training window's centre, and rounds of gradient steps
WINDOW, ROUNDS = 12, 60
FEATURES = 1 << 12
CACHE = 200_000
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

# Fixed patterns: kind, pattern, group that is measured, characters that it needs.
PATTERNS = [
    ("assign", re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*"
                          r"[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
]
KINDS = [k for k, *_ in PATTERNS] + ["crf"]

TOKEN = re.compile(r"[\w+/.-]+|[^\w\s]|\n")
_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_WORDS = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, value start, value end) of the base spans, by start and kind.
    Cheap tests come first: an assignment needs a sign and a word, the others a literal or a
    long run."""
    found = []
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        if name == "assign" and not ((":" in text or "=" in text) and _WORDS.search(text)):
            continue
        if name == "access" and "AKIA" not in text:
            continue
        if name == "hex" and b"x" * least not in text.encode(
                "utf-8", "surrogatepass").translate(_HEX):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                found.append((m.start(), kind, m.end(), a, b))
    return sorted(found)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FEATURES


#: where a token stands for the one that is tagged
PLACES = ("", "before ", "second before ", "after ")
#: tokens of at most so many characters count as words, longer ones by their shape alone
WORD_LENGTH = 12
_SIZE = [sum(n >= x for x in (4, 6, 8, 12, 16, 20, 24, 32, 40, 64)) for n in range(65)]


def _shape(token: str) -> str:
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
             for c in token[:64]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)[:8]


def signature(token: str) -> tuple:
    """What the features know of a token besides the word: shape, size class, character mix,
    whether it looks like hex, and case. Words of letters take a short way."""
    size = _SIZE[min(len(token), 64)]
    long = len(token) > WORD_LENGTH
    if token.isalpha():
        shape = "a" if token.islower() else "A" if token.isupper() else "Aa" if (
            token[1:].islower()) else "aA"
        return shape, size, False, 0, False, shape, long
    digits = sum(c.isdigit() for c in token)
    mixed = digits > 0 and any(c.isalpha() for c in token)
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(token[:64], token[1:64]))
    hexed = len(token) >= 12 and all(c in "0123456789abcdefABCDEF" for c in token)
    case = "digits" if digits == len(token) else "a" if token.islower() else "A" if (
        token.isupper()) else "-"
    return _shape(token), size, mixed, (changes >= 3) + (changes >= 6), hexed, case, long


@functools.lru_cache(1 << 14)
def signature_features(sig: tuple, place: int) -> list[int]:
    """Features of a signature: all of it for the token itself, its shape for a long neighbour."""
    shape, size, mixed, changes, hexed, case, long = sig
    if place:
        return [_hash(f"{PLACES[place]}{shape} {size}")] if long else []
    return [_hash(x) for x in ("any", f"shape {shape}", f"size {size}",
                               f"mix {mixed} {changes} {size}", f"hex {hexed} {mixed}",
                               f"case {case} {size}")]


def word_hash(token: str) -> int:
    """Hash of a token as a word; -1 if it is too long to count as one."""
    if len(token) > WORD_LENGTH:
        return -1
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))


def word_feature(hashes: np.ndarray, place: int) -> np.ndarray:
    mixed = (hashes.astype(np.uint64) + np.uint64(place + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(52)).astype(np.int64) % FEATURES


def file_features(text: str) -> list[int]:
    """Features of the whole file: its size class and how many assignment signs it has."""
    n = len(text) + 1
    signs = text.count("=") + text.count(":") + text.count(";")
    return [_hash(f"file size {n.bit_length() // 3}"), _hash(f"file signs {signs * 200 > n}")]


class Tokens(dict):
    """token -> row of a table of scores by place; new tokens are scored many at a time."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.table = weights, np.zeros((4, 1024, 3))
        self.kinds: dict[tuple, int] = {}
        self.kind_scores = np.zeros((4, 0, 3))
        self.new_kinds: list[int] = []
        self.new_words: list[int] = []

    def __missing__(self, token: str) -> int:
        sig = signature(token)
        kind = self.kinds.get(sig)
        if kind is None:
            kind = self.kinds[sig] = len(self.kinds)
            rows = [self.weights[signature_features(sig, p)].sum(0) for p in range(4)]
            self.kind_scores = np.concatenate((self.kind_scores, np.array(rows)[:, None]), 1)
        self.new_kinds.append(kind)
        self.new_words.append(word_hash(token))
        k = self[token] = len(self)
        return k

    def _flush(self) -> None:
        n, new = len(self), len(self.new_kinds)
        while n > self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), 1)
        words = np.array(self.new_words)
        short = (words >= 0)[:, None]
        for p in range(4):
            self.table[p, n - new:n] = self.kind_scores[p, self.new_kinds] + np.where(
                short, self.weights[word_feature(words, p)], 0)
        self.new_kinds, self.new_words = [], []

    def scores(self, tokens: list[str], text: str) -> np.ndarray:
        """(tokens, 3) scores of the tags."""
        if len(self) >= CACHE:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new_kinds:
            self._flush()
        out = self.table[0, ids] + self.weights[file_features(text)].sum(0)
        out[1:] += self.table[1, ids[:-1]]
        out[2:] += self.table[2, ids[:-2]]
        out[:-1] += self.table[3, ids[1:]]
        return out


def token_features(tokens: list[str], at: int, file: list[int]) -> list[int]:
    """All feature ids of the token at a place of a line, for training."""
    out = list(file)
    for place, step in enumerate((0, -1, -2, 1)):
        if 0 <= at + step < len(tokens):
            token = tokens[at + step]
            out += signature_features(signature(token), place)
            word = word_hash(token)
            if word >= 0:
                out += word_feature(np.array([word]), place).tolist()
    return out


@dataclass(frozen=True)
class Field:
    """Weights by feature and tag, and transitions[from, to]; a line starts after OUTSIDE."""

    weights: np.ndarray
    moves: np.ndarray

    def viterbi(self, scores: np.ndarray) -> list[int]:
        moves = self.moves.tolist()
        best = [moves[OUTSIDE][t] + x for t, x in enumerate(scores[0].tolist())]
        back = []
        for row in scores[1:].tolist():
            step, now = [], []
            for t in range(3):
                got = [best[s] + moves[s][t] for s in range(3)]
                s = max(range(3), key=got.__getitem__)
                step.append(s)
                now.append(got[s] + row[t])
            back.append(step)
            best = now
        tag = max(range(3), key=best.__getitem__)
        path = [tag]
        for step in reversed(back):
            tag = step[tag]
            path.append(tag)
        return path[::-1]

    def spans(self, text: str, memory: Tokens) -> list[tuple[int, int]]:
        """Code-point spans of the tokens tagged as secrets."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        scores = memory.scores(tokens, text)
        stay = self.moves[OUTSIDE, OUTSIDE]
        enter = self.moves[:, :OUTSIDE].max(0) - stay       # the best way to BEGIN and INSIDE
        leave = max(self.moves[:OUTSIDE, OUTSIDE].max() - stay, 0)
        gain = (scores[:, :OUTSIDE] + enter).max(1) - scores[:, OUTSIDE] + leave
        hot = np.flatnonzero(gain > 0)
        if not len(hot):
            return []
        breaks = np.array([-1] + [i for i, t in enumerate(tokens) if t == "\n"] + [len(tokens)])
        at = None
        found = []
        for line in np.unique(np.searchsorted(breaks, hot, side="left")):
            a, b = int(breaks[line - 1]) + 1, int(breaks[line])
            if b <= a:
                continue
            tags = self.viterbi(scores[a:b])
            if all(t == OUTSIDE for t in tags):
                continue
            at = at or [m.span() for m in TOKEN.finditer(text)]
            for i, tag in enumerate(tags):
                if tag == BEGIN or tag == INSIDE and (i == 0 or tags[i - 1] == OUTSIDE):
                    found.append(list(at[a + i]))
                elif tag == INSIDE:
                    found[-1][1] = at[a + i][1]
        return [(s, e) for s, e in found]


def _windows(text: str, key: int) -> tuple[list[str], list[int]]:
    """One training window: around the first base value if there is one, else around a token
    chosen by ``key``; tags are from the base values."""
    spots = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    values = [(a, b) for *_, a, b in base_spans(text)]
    if not spots:
        return [], []
    at = key % len(spots)
    if values:
        at = next(i for i, (s, e, _) in enumerate(spots) if e > values[0][0])
    low = high = at
    while low > 0 and low > at - WINDOW and spots[low - 1][2] != "\n":
        low -= 1
    while high < len(spots) and high < at + WINDOW and spots[high][2] != "\n":
        high += 1
    tags, inside = [], None
    for s, e, _ in spots[low:high]:
        hit = next((v for v in values if s < v[1] and e > v[0]), None)
        tags.append(OUTSIDE if hit is None else INSIDE if hit == inside else BEGIN)
        inside = hit
    return [t for *_, t in spots[low:high]], tags


def fit(samples: list[tuple[str, int]]) -> Field:
    """``fit_windows`` of the windows of (text, key)."""
    return fit_windows([(*_windows(text, key), file_features(text)) for text, key in samples])


def fit_windows(windows: list[tuple[list, list, list]]) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adam steps on all windows at once;
    ``windows`` are (tokens, tags, features of the whole file). Without one nothing is ever
    tagged."""
    rows = [w for w in windows if w[0]]
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = -20.0
    weights = np.zeros((FEATURES, 3))
    if not rows or all(t == OUTSIDE for _, tags, _ in rows for t in tags):
        weights[:, OUTSIDE] = 1.0
        return Field(weights, moves)
    n, width = len(rows), max(len(t) for t, _, _ in rows)
    feats, spot_row, spot_col = [], [], []
    gold, real = np.full((n, width), OUTSIDE), np.zeros((n, width), bool)
    for r, (tokens, tags, file) in enumerate(rows):
        gold[r, :len(tags)], real[r, :len(tags)] = tags, True
        for c in range(len(tokens)):
            here = token_features(tokens, c, file)
            feats += here
            spot_row += [r] * len(here)
            spot_col += [c] * len(here)
    feats, cell = np.array(feats), np.array(spot_row) * width + np.array(spot_col)
    cells, cell_starts = np.unique(cell, return_index=True)
    by_feat = np.argsort(feats, kind="stable")
    used, feat_starts = np.unique(feats[by_feat], return_index=True)
    params = [weights, moves.copy()]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.eye(3)[gold] * real[:, :, None]
    before = np.concatenate((np.full((n, 1), OUTSIDE), gold[:, :-1]), 1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (before[real], gold[real]), 1.0)
    for step in range(1, ROUNDS + 1):
        w, m = params
        score = np.zeros((n * width, 3))
        score[cells] = np.add.reduceat(w[feats], cell_starts)
        score = score.reshape(n, width, 3)
        ahead = np.zeros((n, width, 3))
        ahead[:, 0] = score[:, 0] + m[OUTSIDE]
        for c in range(1, width):
            got = np.logaddexp.reduce(ahead[:, c - 1, :, None] + m, 1) + score[:, c]
            ahead[:, c] = np.where(real[:, c, None], got, ahead[:, c - 1])
        behind = np.zeros((n, width, 3))
        for c in range(width - 2, -1, -1):
            got = np.logaddexp.reduce(m + (score[:, c + 1] + behind[:, c + 1])[:, None], 2)
            behind[:, c] = np.where(real[:, c + 1, None], got, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], 1)
        prob = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        exp_moves = np.zeros((3, 3))
        exp_moves[OUTSIDE] += prob[:, 0].sum(0)
        for c in range(1, width):
            both = np.exp(ahead[:, c - 1, :, None] + m + (score[:, c] + behind[:, c])[:, None]
                          - total[:, None, None])
            exp_moves += both[real[:, c]].sum(0)
        grad_w = np.zeros_like(w)
        grad_w[used] = np.add.reduceat((hot - prob).reshape(-1, 3)[cell[by_feat]], feat_starts)
        grads = [grad_w / n - 1e-4 * w, (gold_moves - exp_moves) / n - 1e-4 * m]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += 0.1 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        params[1][OUTSIDE, INSIDE] = -20.0      # a secret has a beginning
    return Field(*params)


def _has_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, whether the text has base spans)."""
    for batch in batches:
        hits = [bool(base_spans(text)) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.bool_())],
                                         names=["key", "hit"])


def _train_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, tokens, tags, file): one window from anywhere in the whole text, and
    the features of the whole text, as a scan sees them."""
    for batch in batches:
        keys, texts = (c.to_pylist() for c in batch.columns)
        found = [_windows(t, k & 0x7FFFFFFF) for k, t in zip(keys, texts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([w for w, _ in found], pa.list_(pa.string())),
             pa.array([t for _, t in found], pa.list_(pa.int32())),
             pa.array([file_features(t) for t in texts], pa.list_(pa.int32()))],
            names=["key", "tokens", "tags", "file"])


def learn(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Field:
    """Fit on at most ``train_rows`` documents with base spans and as many without, those of
    least text hash, each text once. Only their training windows, at most 2 x ``WINDOW`` tokens
    each, reach the driver."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    kinds = scratch.keep(keyed.mapInArrow(_has_base, "key long, hit boolean").distinct(), "kinds")
    least = [kinds.filter(F.col("hit") == hit).orderBy("key").limit(train_rows).select("key")
             for hit in (True, False)]
    chosen = least[0].unionByName(least[1])             # at most 2 * train_rows keys
    rows = keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"))
    windows = rows.mapInArrow(_train_windows, "key long, tokens array<string>, tags array<int>, "
                              "file array<int>").orderBy("key").collect()
    scratch.drop(kinds)
    return fit_windows([(r.tokens, r.tags, r.file) for r in windows])


SPANS = "array<struct<start:int,kind:string,end:int,value_start:int,value_end:int>>"


def scan(docs: DataFrame, field: Field, text_col: str = "text",
         out_col: str = "secrets") -> DataFrame:
    """``docs`` with ``out_col``: all spans by start, then kind as listed (base kinds, then
    ``crf``), in code points, with the part that is the secret value. Null and empty texts have
    none; a column that is already named ``out_col`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kept = docs.drop(out_col) if out_col in docs.columns and out_col != text_col else docs
    columns = kept.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()),
                               ("value_start", pa.int32()), ("value_end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memory = Tokens(model.weights)
        for batch in batches:
            rows = []
            for text in batch.column(columns.index(text_col)).to_pylist():
                text = text or ""
                spans = base_spans(text)
                taken = [(s, e) for s, _, e, _, _ in spans]
                spans += [(s, len(PATTERNS), e, s, e) for s, e in model.spans(text, memory)
                          if not any(s < y and e > x for x, y in taken)]
                rows.append([{"start": s, "kind": KINDS[k], "end": e, "value_start": a,
                              "value_end": b} for s, k, e, a, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)],
                                             names=[*columns, out_col])

    return kept.mapInArrow(run, T.StructType(
        [*kept.schema.fields, *T._parse_datatype_string(f"{out_col} {SPANS}").fields]))


def redact(docs: DataFrame, field: Field, text_col: str = "text",
           mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret value in ``text_col`` replaced by ``mark``; values that
    overlap are replaced together. Rows without a secret are unchanged."""
    found = scan(docs, field, text_col, fresh("secrets", docs.columns))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(columns.index(text_col)).to_pylist(),
                                   batch.column(len(columns)).to_pylist()):
                out, at = [], 0
                for a, b in sorted((s["value_start"], s["value_end"]) for s in spans):
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                texts.append("".join([*out, text[at:]]) if spans else text)
            cols = list(batch.columns[:len(columns)])
            cols[columns.index(text_col)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return found.mapInArrow(run, docs.schema)
