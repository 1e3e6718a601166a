"""License statements in texts, by diagonal voting.

The hashes of all runs of ``K`` words of every text are joined by Spark to the positions of the
same runs in the templates. A match of text position p and template position t lies on diagonal
p - t; matches are aggregated by diagonal, neighbouring diagonals of one text and template are
merged, as words put in or left out move the rest of a statement from one to the next, and the
merged diagonals with enough votes are candidate spans. A template of m words with at most e
edited words keeps m - K + 1 - K e of its runs or more, so no such span is lost. Each span is
then verified on the words of its text by their edit distance.

Votes belong to a text, not to a row: copies of one text add none. Texts are named by a 64-bit
hash until the verification; a span that comes from another text of the same name fails there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import fresh
from quarry.llm.wordscan import Words, scan, slices

K = 3
SIMILARITY = 0.8
#: template runs up to which their table is broadcast (about 50 bytes each); a larger one is
#: joined by a shuffle
BROADCAST_RUNS = 200_000


class Template(NamedTuple):
    """``exact`` templates match word for word only; ``base`` marks their spans."""

    label: str
    text: str
    base: bool = False
    exact: bool = False


# Phrases that count as license statements as they stand.
PHRASES = [
    Template("mit", "under the mit license", True, True),
    Template("apache-2", "apache license version 2", True, True),
    Template("cc-by-nc", "cc by nc", True, True),
]
# Opening words of public licenses and of the notices that name them.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy "
                    "of this software and associated documentation files"),
    Template("mit", "this software is released under the terms of the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not "
                         "use this file except in compliance with the license"),
    Template("apache-2", "this work is licensed under the apache license version 2 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu "
                      "general public license as published by the free software foundation "
                      "either version 3 of the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without "
                    "modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public "
                      "license v 2 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 "
                      "international license"),
]


# -- hashes of word runs ------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15                  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of every run of ``k`` words. The sums of all prefixes are stored;
    a run's hash is the difference of two of them, brought to one place."""
    n = len(words.flat)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[words.flat] * _powers(_BASE, n)[:n],
                                                     dtype=np.uint64)))
    count = np.diff(words.bounds)
    runs = np.maximum(count - k + 1, 0)
    text = np.repeat(np.arange(len(count)), runs)
    pos = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    first = np.repeat(words.bounds[:-1], runs) + pos
    a, b = words.starts[first], words.ends[first + k - 1]
    placed = (sums[b] - sums[a]) * _powers(_INVERSE, n)[a]
    return text, pos, _mixed(placed).view(np.int64)


def _text_runs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for i, j in slices(batch.column(1)):
                text, pos, h = run_hashes(scan(batch.column(1).slice(i, j - i)), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:j][text]), pa.array(pos.astype(np.int32)), pa.array(h)],
                    names=["key", "pos", "h"])
    return run


def _template_words(template: Template) -> list[bytes]:
    return scan(pa.array([template.text])).flat.tobytes().split()


def edits_of(m: int, exact: bool, k: int = K, similarity: float = SIMILARITY) -> int:
    """Words of a template of ``m`` that may be edited: what the similarity leaves, as long as
    one run of ``k`` words must survive."""
    return 0 if exact else min(int((1 - similarity) * m + 1e-9), (m - k) // k)


def _template_runs(spark: SparkSession, templates: list[Template], k: int) -> DataFrame:
    """(h, template, tpos, edits, need): all runs of all templates."""
    rows = []
    for number, t in enumerate(templates):
        m = len(_template_words(t))
        if m < k:
            raise ValueError(f"a template needs {k} words or more: {t.text!r}")
        e = edits_of(m, t.exact, k)
        _, pos, h = run_hashes(scan(pa.array([t.text])), k)
        rows += [(int(x), number, int(p), e, m - k + 1 - k * e) for x, p in zip(h, pos)]
    table = spark.createDataFrame(rows, "h long, template int, tpos int, edits int, need int")
    return F.broadcast(table) if len(rows) <= BROADCAST_RUNS else table


# -- votes --------------------------------------------------------------------------------------

def candidate_spans(texts: DataFrame, templates: list[Template], k: int = K) -> DataFrame:
    """texts (key, text) -> (key, spans): per text the candidates (template, low, high), the
    range of diagonals of each."""
    runs = texts.mapInArrow(_text_runs(k), "key long, pos int, h long")
    hits = runs.join(_template_runs(texts.sparkSession, templates, k), "h")
    # a diagonal's votes are the template positions on it: at most one template's length
    diagonals = hits.groupBy("key", "template", "edits", "need",
                             (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.size(F.collect_set("tpos")).alias("votes"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    chained = (diagonals.withColumn("new", F.coalesce((step > F.col("edits")).cast("int"),
                                                      F.lit(0)))
               .withColumn("chain", F.sum("new").over(along)))
    spans = (chained.groupBy("key", "template", "chain")
             .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"),
                  F.max("diagonal").alias("high"), F.first("need").alias("need"))
             .filter(F.col("votes") >= F.col("need")))
    return spans.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("spans"))


# -- verification -------------------------------------------------------------------------------

def best_match(template: list[bytes], words: list[bytes]) -> tuple[int, int, int]:
    """(edit distance, start, end) of the words' stretch that is nearest to the template, the
    first one of the least distance."""
    m = len(template)
    column = [(i, 0) for i in range(m + 1)]             # (distance, start) by template prefix
    best = (m, 0, 0)
    for end, word in enumerate(words, 1):
        above = column
        column = [(0, end)]
        for i, t in enumerate(template):
            column.append(min((above[i][0] + (t != word), above[i][1]),
                              (above[i + 1][0] + 1, above[i + 1][1]),
                              (column[i][0] + 1, column[i][1])))
        if column[m][0] < best[0]:
            best = (*column[m], end)
    return best


def verified(words: list[bytes], spans: list[tuple[int, int, int]], templates: list[Template],
             wanted: list[list[bytes]], k: int = K) -> list[dict]:
    """The candidates that hold, with their place and similarity."""
    out = []
    for number, low, high in spans:
        t, m = wanted[number], len(wanted[number])
        e = edits_of(m, templates[number].exact, k)
        a = max(0, low - e)
        if e == 0:
            found = [(0, p, p + m) for p in range(a, high + 1) if words[p:p + m] == t]
        else:
            d, start, end = best_match(t, words[a:high + m + e])
            found = [(d, a + start, a + end)] if d <= e else []
        out += [{"label": templates[number].label, "base": templates[number].base, "start": s,
                 "end": f, "similarity": 1 - d / m} for d, s, f in found]
    return sorted(out, key=lambda x: (x["start"], x["end"], x["label"], not x["base"]))


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
                            ("end", pa.int64()), ("similarity", pa.float64())]))


def _verify(templates: list[Template], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [_template_words(t) for t in templates]
        for batch in batches:
            spans = batch.column(2)
            for i, j in slices(batch.column(1)):
                words = scan(batch.column(1).slice(i, j - i))
                found: list[list[dict]] = [[]] * (j - i)
                mine = spans.slice(i, j - i)
                for r in np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    w, x = words.bounds[r], words.bounds[r + 1]
                    if w < x:
                        text = words.flat[words.starts[w]:words.ends[x - 1]].tobytes().split()
                        todo = [(s["template"], s["low"], s["high"]) for s in mine[r].as_py()]
                        found[r] = verified(text, todo, templates, wanted, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(words.bounds), pa.int64()),
                     pa.array(found, _SPAN)], names=["id", "n_words", "spans"])
    return run


def license_spans(docs: DataFrame, templates: list[Template] | None = None,
                  id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: id, n_words, spans (label, base, start, end, similarity), in words
    from 0, end exclusive, sorted by place.

    Exact templates are found at all their places, also overlapping ones; of the others one best
    place per candidate, if at most ``edits_of`` words differ (a similarity of 0.8 or more). A
    null or empty text has no words; repeated rows and null ids stay rows of their own; an empty
    table gives an empty result. Other columns are not read, whatever their names. A text is one
    row: a task holds several times the bytes of the longest one.
    """
    templates = PHRASES + NOTICES if templates is None else templates
    kind = dict(docs.dtypes)[id_col]
    key, text = fresh("key", [id_col]), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias(key))
    spans = candidate_spans(rows.select(F.col(key).alias("key"), "text"), templates, k)
    joined = rows.join(spans, rows[key] == spans["key"], "left").select("id", "text", "spans")
    return joined.mapInArrow(
        _verify(templates, k), f"id {kind}, n_words long, spans array<struct<label:string,"
        "base:boolean,start:bigint,end:bigint,similarity:double>>").select(
        F.col("id").alias(id_col), "n_words", "spans")
