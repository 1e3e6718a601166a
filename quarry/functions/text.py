"""Sentence splitting, token counting and greedy chunk packing as native column expressions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must stay as they are for results to match):
# sentence boundary = a whitespace run that follows '.', '!' or '?', or the end of the text.
# (?U) makes \s Unicode-aware, (?d) makes only '\n' a line terminator for \Z.
SENTENCE_BOUNDARY = r"(?Ud)(?<=[.!?])\s+|\Z"
# default token = a run of letters/digits/underscore, or one other non-space character;
# every encoded sequence also carries a start and an end token.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SPECIAL_TOKENS = 2
WORD_PATTERN = r"[\p{L}\p{N}_]+"
DEFAULT_CHUNK_TOKENS = 512


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst inlines aliased sub-expressions into every place that uses them (projections
    collapsed, filters pushed through projections, outer values referenced inside lambdas);
    for expensive expressions such as a regex split or a fold that multiplies the work. A
    one-element ``transform`` binds the value to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sentence_split(text) -> Column:
    """``array<string>`` of sentences; empty pieces dropped, whitespace-only pieces kept."""
    parts = F.split(_col(text), SENTENCE_BOUNDARY, -1)
    return F.filter(parts, lambda s: s != F.lit(""))


def token_count(sentence) -> Column:
    """Default token counter: word/punctuation tokens plus the two special tokens."""
    return (F.regexp_count(_col(sentence), F.lit(TOKEN_PATTERN)) + F.lit(SPECIAL_TOKENS)).cast(
        "int")


def word_tokens(text) -> Column:
    """Lower-cased word tokens (used by the hashing embedder)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_PATTERN), 0)


class TokenCounter(Protocol):
    """Plug point: maps a sentence column to an int token-count column.

    The default is native; a tokenizer-backed counter can be a ``pandas_udf``.
    """

    def __call__(self, sentence: Column) -> Column: ...


STARTS_BLOCK = 2048


def _fold_block(costs: Column, limit: int, length, i, opened):
    """Greedy fold over one block of costs, continuing from (length, i, opened); returns
    struct<len, i, opened, starts> with the block's chunk starts (global indices)."""
    init = F.struct(length.alias("len"), i.alias("i"), opened.alias("opened"),
                    F.array().cast("array<int>").alias("starts"))

    def step(acc, c):
        fits = acc["opened"] & (acc["len"] + c <= F.lit(limit))
        return F.when(
            fits,
            F.struct((acc["len"] + c).alias("len"), (acc["i"] + 1).alias("i"),
                     F.lit(True).alias("opened"), acc["starts"].alias("starts")),
        ).otherwise(
            F.struct(c.alias("len"), (acc["i"] + 1).alias("i"), F.lit(True).alias("opened"),
                     F.array_append(acc["starts"], acc["i"]).alias("starts")))

    return F.aggregate(costs, init, step)


def chunk_starts(costs, limit: int, block: int = STARTS_BLOCK) -> Column:
    """0-based index of the first sentence of every chunk, by greedy packing.

    A sentence joins the open chunk while ``open_len + cost <= limit`` (inclusive); otherwise it
    opens a new chunk. An over-long sentence forms its own chunk and is never cut.

    Native and near-linear for any document length: the costs are folded in blocks of
    ``block`` sentences; each block appends starts to its own small array and the outer fold
    appends one array reference per block, flattened at the end (no array that grows with the
    whole document is copied per sentence).
    """
    costs = _col(costs)

    def run(cs):
        n = F.size(cs)
        nb = F.ceil(n / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), nb - 1),
                             lambda b: F.slice(cs, b * F.lit(block) + 1, F.lit(block)))
        init = F.struct(F.lit(0).alias("len"), F.lit(0).alias("i"),
                        F.lit(False).alias("opened"),
                        F.array().cast("array<array<int>>").alias("parts"))

        def outer(o, blk):
            return let(_fold_block(blk, limit, o["len"], o["i"], o["opened"]),
                       lambda r: F.struct(r["len"].alias("len"), r["i"].alias("i"),
                                          r["opened"].alias("opened"),
                                          F.array_append(o["parts"], r["starts"]).alias(
                                              "parts")))

        folded = F.aggregate(blocks, init, outer, lambda o: F.flatten(o["parts"]))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(folded)

    return let(costs, run)


def _bounds(starts: Column, n: Column):
    """Per chunk: (start, length) in sentences, as array<struct<s:int, n:int>>."""
    nchunks = F.size(starts)
    return F.transform(
        F.sequence(F.lit(0), nchunks - 1),
        lambda j: F.struct(
            starts[j].alias("s"),
            (F.when(j + 1 < nchunks, starts[j + 1]).otherwise(n) - starts[j]).alias("n")))


def greedy_starts(costs, limit: int) -> list:
    """Linear greedy packing on one cost list (reference semantics of ``chunk_starts``)."""
    out, cur = [], 0
    for i, c in enumerate(costs):
        if out and cur + c <= limit:
            cur += c
        else:
            out.append(i)
            cur = c
    return out


def pack_chunks(sentences, costs, limit: int = DEFAULT_CHUNK_TOKENS) -> Column:
    """``array<struct<chunk:string, n_tokens:int, first_sentence:int, n_sentences:int>>``.

    Sentences of a chunk are joined with one space. Empty input gives an empty array.
    """
    sentences, costs = _col(sentences), _col(costs)

    def build(sents, cs):
        n = F.size(sents)
        return F.when(n == 0, F.array().cast(
            "array<struct<chunk:string,n_tokens:int,first_sentence:int,n_sentences:int>>")
        ).otherwise(let(chunk_starts(cs, limit),
                        lambda starts_: F.transform(
            _bounds(starts_, n),
            lambda b: F.struct(
                F.array_join(F.slice(sents, b["s"] + 1, b["n"]), " ").alias("chunk"),
                F.aggregate(F.slice(cs, b["s"] + 1, b["n"]), F.lit(0),
                            lambda a, x: a + x).alias("n_tokens"),
                b["s"].alias("first_sentence"),
                b["n"].alias("n_sentences")))))

    return let(F.struct(sentences.alias("s"), costs.alias("c")),
               lambda sc: build(sc["s"], sc["c"]))


def sentence_chunk_numbers(costs, limit: int = DEFAULT_CHUNK_TOKENS) -> Column:
    """Chunk number (0-based) of every sentence, as ``array<int>`` aligned with the sentences.

    Linear: every chunk span repeats its number once per sentence it holds.
    """
    def build(cs):
        n = F.size(cs)
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(
            let(chunk_starts(cs, limit), lambda starts: F.flatten(
                F.transform(_bounds(starts, n), lambda b, j: F.array_repeat(j, b["n"])))))

    return let(_col(costs), build)
