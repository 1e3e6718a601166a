"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else.

Which windows can be equal is decided by content: the anchor of a window of ``length`` bytes is
the least hash of the ``gram``-byte strings in it, so equal windows have equal anchors wherever
they stand. Neighbouring windows with one anchor are a region. Anchors that occur once cannot
hold a repeated window and end there; regions of one content that occur twice or more are
repeated as a whole. Only the different contents that share an anchor, each once, are brought
together in shards and suffix-sorted (module ``induced``): neighbours in the suffix order whose
common prefix has ``length`` bytes are equal windows.

An anchor with more than ``most`` different contents is split further by its whole windows'
128-bit hashes, whose counts are an ordinary aggregate. Texts are named by 96 bits of hashes, so
exact copies are one text with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.induced import MEMORY_ROWS, equal_prefixes, suffix_array
from quarry.llm.shared import Scratch, utf8

LENGTH = 200
GRAM = 48
SHARD_BYTES = 4 << 20
MOST = 20_000
#: bytes that are hashed in one step
STEP = 1 << 17

_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE2 = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15


class Rolling:
    """Polynomial hashes modulo 2^64 of all strings in a buffer of up to ``room`` bytes."""

    def __init__(self, room: int, table: np.ndarray = _TABLE, odd: int = _ODD):
        self.table = table
        self.power = np.cumprod(np.full(room + 1, odd, np.uint64))
        self.inverse = np.cumprod(np.full(room + 1, pow(odd, -1, 1 << 64), np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings from ``start`` to ``end``, mixed."""
        x = (sums[end] - sums[start]) * self.inverse[start]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def grams(self, sums: np.ndarray, gram: int) -> np.ndarray:
        n = len(sums) - gram
        x = (sums[gram:] - sums[:n]) * self.inverse[:n]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbouring values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        n = len(values) - (width - have)
        values = np.minimum(values[:n], values[width - have:])
    return values


def regions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, rolling: Rolling
            ) -> dict[str, np.ndarray]:
    """Regions of all texts that lie end to end in ``data``: row of the text, start and end of
    the first bytes of the windows (within the text), anchor, content hash, and ``self``:
    whether windows of the region could equal each other."""
    width = length - gram + 1
    out: dict[str, list] = {k: [] for k in ("row", "start", "end", "h", "c", "self")}
    total = int(offsets[-1])
    step = STEP
    lows = range(0, max(total - length + 1, 0), step)
    for low in lows:
        # windows that start in [low, low + step); one more on the left shows where runs begin
        a, b = max(low - 1, 0), min(low + step, total - length + 1)
        part = data[a:b + length - 1]
        sums = rolling.sums(part)
        g = rolling.grams(sums, gram)
        least = window_minima(g, width)             # one per window start a .. b - 1
        starts = np.arange(a, b)
        row = np.searchsorted(offsets, starts, "right") - 1
        whole = starts + length <= offsets[row + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        # places where the window's first or last gram is the anchor
        at_first = np.concatenate(([0], np.cumsum(g[:len(least)] == least)))
        at_last = np.concatenate(([0], np.cumsum(g[width - 1:width - 1 + len(least)] == least)))
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(least))
        keep = whole[s]
        if a < low:                                 # the run that began before is cut at low
            s = np.maximum(s, 1)
            keep &= s < e
        s, e = s[keep], e[keep]
        run = e - s
        first, last = at_first[e] - at_first[s], at_last[e] - at_last[s]
        both = np.where(run >= width, at_first[e] - at_first[np.minimum(s + width - 1, e)], 0)
        out["row"].append(row[s])
        out["start"].append(s + a - offsets[row[s]])
        out["end"].append(e + a - offsets[row[s]])
        out["h"].append(least[s])
        out["c"].append(rolling.of(sums, s, e + length - 1) ^ (e - s).astype(np.uint64))
        out["self"].append((first > 0) & (last > 0) & (first + last - both > 1))
    return {k: np.concatenate(v) if v else np.zeros(0, bool if k == "self" else np.int64)
            for k, v in out.items()}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


ANCHORS = "h long, c long, t long, u int, start int, end int, self boolean"


def _anchors(length: int, gram: int):
    """(t, u, text) -> regions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(STEP + 2 * length)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            found = regions(data, offsets, length, gram, rolling)
            rows = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays(
                [_signed(found["h"]), _signed(found["c"]), batch.column(0).take(rows),
                 batch.column(1).take(rows), pa.array(found["start"], pa.int32()),
                 pa.array(found["end"], pa.int32()), pa.array(found["self"], pa.bool_())],
                names=["h", "c", "t", "u", "start", "end", "self"])
    return run


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text) with the text compressed, to move less."""
    for batch in batches:
        packed = [None if x is None else pa.compress(x.encode("utf-8"), "zstd", asbytes=True)
                  for x in batch.column(batch.num_columns - 1).to_pylist()]
        sizes = batch.column(batch.num_columns - 2)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], sizes,
                                          pa.array(packed, pa.binary())],
                                         names=batch.schema.names)


def _unpack(packed: bytes | None, size: int) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if packed and size else b""


def _contents(length: int):
    """(packed text, its size, list of (h, c, start, end, n)) -> (h, c, n, content)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, n, content = [], [], [], []
            for packed, size, wanted in zip(*(col.to_pylist() for col in batch.columns)):
                text = _unpack(packed, size)
                for w in wanted:
                    h.append(w["h"])
                    c.append(w["c"])
                    n.append(w["n"])
                    content.append(text[w["start"]:w["end"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(content, pa.binary())], names=["h", "c", "n", "content"])
    return run


def repeated_windows(contents: list[bytes], length: int, memory_rows: int = MEMORY_ROWS
                     ) -> list[tuple[int, int, int]]:
    """(content, first, end): runs of window starts that are equal to another window of any of
    the contents, by suffix-sorting all of them with a parting character below every byte."""
    size = np.array([len(x) for x in contents])
    flat = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    text = flat.astype(np.int16) + 1
    text[bounds[1:] - 1] = 0
    order = suffix_array(text, 257, memory_rows)
    owner = np.repeat(np.arange(len(size)), size + 1)
    is_start = np.arange(len(flat)) + length < bounds[owner + 1]
    order = np.asarray(order)[is_start[np.asarray(order)]]
    same = equal_prefixes(flat, order, length)
    hit = np.zeros(len(flat), bool)
    hit[order[:-1][same]] = hit[order[1:][same]] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    s, e = edge[::2], edge[1::2]
    return list(zip(owner[s].tolist(), (s - bounds[owner[s]]).tolist(),
                    (e - bounds[owner[s]]).tolist()))


def _sort_shard(length: int, memory_rows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(pdf.content.tolist(), length, memory_rows)
        at = np.array([f[0] for f in found], int)
        return pd.DataFrame({"h": pdf.h.to_numpy()[at], "c": pdf.c.to_numpy()[at],
                             "a": np.array([f[1] for f in found], int),
                             "b": np.array([f[2] for f in found], int)})
    return run


def _window_hashes(length: int):
    """(h, c, content) -> one row per window, with 128 bits of hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, content in zip(*(col.to_pylist() for col in batch.columns)):
                data = np.frombuffer(content, np.uint8)
                n = len(data) - length + 1
                pair = []
                for table in (_TABLE, _TABLE2):
                    rolling = Rolling(len(data), table)
                    pair.append(_signed(rolling.grams(rolling.sums(data), length)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, h)), pa.array(np.full(n, c)),
                     pa.array(np.arange(n), pa.int32()), *pair], names=["h", "c", "a", "x", "y"])
    return run


def text_name(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("t"), F.hash(F.lit(3), text).alias("u")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, shard_bytes: int = SHARD_BYTES, most: int = MOST,
                   memory_rows: int = MEMORY_ROWS) -> DataFrame:
    """(t, u, spans): for every text with repeated strings, by its name, the ascending byte
    spans that they cover. Null texts and texts under ``length`` bytes have none."""
    scratch = Scratch(docs.sparkSession, "substrings")
    text = F.col(text_col)
    named = docs.filter(F.octet_length(text) >= length).select(*text_name(text),
                                                              text.alias("text"))
    anchors = named.mapInArrow(_anchors(length, gram), ANCHORS)
    shared = (anchors.groupBy("h").agg(F.count("*").alias("n"), F.max("self").alias("s"))
              .filter("n > 1 OR s").select("h"))
    columns = ["h", "c", "t", "u", "start", "end"]
    hits = scratch.keep(anchors.join(shared, "h").groupBy(*columns).agg(
        F.count("*").alias("n"), F.max("self").alias("self")), "hits")
    by_content = hits.groupBy("h", "c").agg(
        F.sum("n").alias("n"), F.max("self").alias("self"),
        F.min(F.struct("t", "u", "start", "end")).alias("at"))
    by_content = scratch.keep(by_content, "contents")
    mixed = by_content.groupBy("h").agg(F.count("*").alias("kinds"), F.max("self").alias("any"))
    contested = mixed.filter("kinds > 1 OR any").select("h", "kinds")

    wanted = (by_content.join(contested, "h").groupBy("at.t", "at.u").agg(F.collect_list(
        F.struct("h", "c", "at.start", "at.end", "n")).alias("wanted")))
    packed = named.select("t", "u", F.octet_length("text").alias("size"), "text").mapInArrow(
        _pack_texts, "t long, u int, size int, text binary")
    taken = (packed.join(wanted, ["t", "u"]).select("text", "size", "wanted")
             .mapInArrow(_contents(length), "h long, c long, n long, content binary"))
    contents = scratch.keep(taken.groupBy("h", "c").agg(
        F.first("n").alias("n"), F.first("content").alias("content"))
        .join(contested, "h"), "taken")
    size = contents.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    sorted_ = (contents.filter(F.col("kinds") <= most)
               .select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "c", "content")
               .groupBy("shard").applyInPandas(_sort_shard(length, memory_rows),
                                               "h long, c long, a int, b int"))
    windows = contents.filter(F.col("kinds") > most).select("h", "c", "content").mapInArrow(
        _window_hashes(length), "h long, c long, a int, x long, y long")
    twice = windows.groupBy("x", "y").agg(F.count("*").alias("k")).filter("k > 1")
    split = windows.join(twice, ["x", "y"]).select("h", "c", "a", (F.col("a") + 1).alias("b"))
    parts = scratch.keep(sorted_.unionByName(split), "parts")

    whole = hits.join(by_content.filter("n > 1").select("h", "c"), ["h", "c"]).select(
        "t", "u", F.col("start").alias("a"), F.col("end").alias("b"))
    partly = hits.join(parts, ["h", "c"]).select(
        "t", "u", (F.col("start") + F.col("a")).alias("a"),
        (F.col("start") + F.col("b")).alias("b"))
    every = whole.unionByName(partly).groupBy("t", "u").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("runs"))
    return scratch.keep(every.mapInArrow(_spans(length), "t long, u int, spans "
                                         "array<struct<start:int,end:int>>"), "spans")


def _spans(length: int):
    """(t, u, runs of window starts) -> the union of what the windows cover."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(2).to_pylist():
                spans: list[dict] = []
                for r in runs:
                    end = r["b"] + length - 1
                    if spans and r["a"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], end)
                    else:
                        spans.append({"start": r["a"], "end": end})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                              pa.array(out, kind)], names=["t", "u", "spans"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """One row per document: id, n_bytes, kept (the remaining bytes), spans (maximal removed
    runs, in bytes). Null texts count as empty; repeated rows each have the same result; other
    columns are not read. Removal may cut inside a character, so ``kept`` is binary."""
    spans = repeated_spans(docs, text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *text_name(text),
                       F.octet_length(text).alias("size"), text.alias("text"))
    packed = rows.mapInArrow(_pack_texts, f"id {rows.schema['id'].dataType.simpleString()}, "
                             "t long, u int, size int, text binary")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 512):
                some = batch.slice(x, 512)
                out, gone = [], []
                for size, packed, found in zip(*(some.column(k).to_pylist() for k in (1, 2, 3))):
                    data, at, parts = _unpack(packed, size), 0, []
                    for s in found or []:
                        parts.append(data[at:s["start"]])
                        at = s["end"]
                    out.append(b"".join([*parts, data[at:]]))
                    gone.append(found or [])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(out, pa.binary()),
                     pa.array(gone, kind)], names=["id", "n_bytes", "kept", "spans"])

    joined = packed.join(spans, ["t", "u"], "left").select("id", "size", "text", "spans")
    done = joined.mapInArrow(
        cut, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes int, kept binary, "
        "spans array<struct<start:int,end:int>>")
    return done.select(F.col("id").alias(id_col), F.col("n_bytes").cast("long"), "kept", "spans")
