"""Importance resampling towards a target distribution of hashed word n-grams.

Every text is scanned once: its words are normalised to one separator, and the CRC-32 register
of every prefix of that flat text is stored. The CRC of an n-gram follows from the prefixes at
its two ends: the register at its start, shifted over GF(2) by as many zero bytes as the n-gram
has, cancels out of the register at its end. So no n-gram is ever cut out or hashed by itself.

The features' buckets are stored; bucket counts of both tables are added up in Spark and give
one gain per bucket, a table whose size is the parameter ``buckets``. A document's score is the
sum of its features' gains plus Gumbel noise that depends on its id alone, and the documents of
the highest scores are drawn without replacement, numbered over key ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch
from quarry.llm.wordscan import Words, scan, slices
from quarry.operators.numbering import ROW, start_offsets

POLYNOMIAL = 0xEDB88320         # CRC-32, reflected
ONES = np.uint32(0xFFFFFFFF)
LANE = 64

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return out.astype(np.uint32)


TABLE = _byte_table()


def _apply(operator: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear operator on 32 bits, given by its values on each byte: (4, 256)."""
    return (operator[0][x & 255] ^ operator[1][(x >> 8) & 255]
            ^ operator[2][(x >> 16) & 255] ^ operator[3][x >> 24])


def _shifts(bits: int) -> list[np.ndarray]:
    """Operators that run the register over 2^k zero bytes, for k below ``bits``."""
    lone = np.arange(256, dtype=np.uint32)
    x = np.stack([lone << np.uint32(8 * j) for j in range(4)])
    out = [TABLE[x & 255] ^ (x >> np.uint32(8))]
    for _ in range(bits - 1):
        out.append(_apply(out[-1], out[-1]))
    return out


SHIFTS = _shifts(34)


def shift(register: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each register run over so many zero bytes."""
    out = register.copy()
    k = 0
    while len(n_bytes) and (int(n_bytes.max()) >> k):
        at = np.flatnonzero((n_bytes >> k) & 1)
        out[at] = _apply(SHIFTS[k], out[at])
        k += 1
    return out


def _run(data: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers after each byte of each lane (bytes x lanes), from those before the lane."""
    out = np.empty(data.shape, np.uint32)
    for j, byte in enumerate(data):
        register = TABLE[(register ^ byte) & 255] ^ (register >> 8)
        out[j] = register
    return out


def prefix_registers(flat: np.ndarray) -> np.ndarray:
    """CRC-32 registers, started at zero, before each byte and after the last one: the bytes in
    lanes side by side, the lanes' starts by doubling, then the lanes again from those starts."""
    n = len(flat)
    lanes = -(-n // LANE)
    data = np.zeros((lanes, LANE), np.uint8)
    data.ravel()[:n] = flat
    data = np.ascontiguousarray(data.T)
    after = _run(data, np.zeros(lanes, np.uint32))[-1] if lanes else np.zeros(0, np.uint32)
    step, k = 1, LANE.bit_length() - 1
    while step < lanes:
        after[step:] ^= _apply(SHIFTS[k], after[:-step])
        step, k = 2 * step, k + 1
    start = np.concatenate((np.zeros(1, np.uint32), after[:-1])) if lanes else after
    runs = _run(data, start).T.ravel()[:n]
    return np.concatenate((np.zeros(1, np.uint32), runs))


def ngram_crcs(words: Words, registers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32 of every run of ``n`` words with single spaces, the text it is in)."""
    count = np.diff(words.bounds)
    runs = np.maximum(count - n + 1, 0)
    text = np.repeat(np.arange(len(count)), runs)
    first = np.repeat(words.bounds[:-1], runs) + (
        np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    a, b = words.starts[first], words.ends[first + n - 1]
    return registers[b] ^ shift(registers[a] ^ ONES, b - a) ^ ONES, text


def _features(min_n: int, max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(texts):
                words = scan(texts.slice(i, j - i))
                registers = prefix_registers(words.flat)
                found = [ngram_crcs(words, registers, n) for n in range(min_n, max_n + 1)]
                text = np.concatenate([t for _, t in found])
                bucket = (np.concatenate([c for c, _ in found]) % buckets).astype(np.int32)
                if len(found) > 1:
                    bucket = bucket[np.argsort(text, kind="stable")]
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=j - i))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(words.bounds), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket))],
                    names=["id", "n_words", "buckets"])
    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = 1,
             max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, buckets): the bucket of every run of ``min_n`` to ``max_n`` words, the
    unsigned CRC-32 of its UTF-8 bytes modulo ``buckets``, repeats included."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _features(min_n, max_n, buckets), f"id {kind}, n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all rows are in each bucket that has any. A task adds up
    its rows and sends one row per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])],
                                         names=["bucket", "n"])
    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, from the bucket counts of the two tables: ``buckets`` numbers."""
    spark = source.sparkSession
    s = source.withColumnRenamed("n", "s")
    t = target.withColumnRenamed("n", "t")
    both = (spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left")
            .join(t, "bucket", "left").fillna(0, ["s", "t"]))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    rows = both.crossJoin(F.broadcast(sums)).select(     # sums is one row
        "bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def _weights(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            bucket, offsets = _flat(batch.column(2))
            total = np.concatenate(([0], np.cumsum(gain[bucket])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()),
                 pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64())],
                names=["id", "n_words", "n_features", "weight"])
    return run


def noise(id_col, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of ``seed:id``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", min_n: int = 1, max_n: int = 1, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (all long).

    Of the N documents with ``min_words`` words or more, the floor(percent * N / 100) of the
    highest scores are drawn and ranked from 1, ties to the smaller id; other ranks are null. A
    null or empty text has no feature and the weight 0. A null id is hashed as an empty one and
    comes after the others in a tie; rows that repeat an id stay rows of their own, in any order
    in a tie. Without documents the result is empty; without target texts all target counts are
    0. Other columns are not read, whatever their names. A text is one row: a task holds several
    times the bytes of the longest one.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    kept = scratch.keep(features(docs, id_col, text_col, min_n, max_n, buckets), "features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")),
                      "id", "text", min_n, max_n, buckets)
    gain = gains(bucket_counts(kept, buckets), bucket_counts(wanted, buckets), buckets)
    kind = dict(kept.dtypes)["id"]
    weighed = kept.mapInArrow(_weights(gain),
                              f"id {kind}, n_words long, n_features long, weight long")
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + noise("id", seed))
                          .withColumn(ROW, F.monotonically_increasing_id()), "scored")
    able = scored.filter(F.col("n_words") >= min_words).select(
        (-F.col("score")).alias("_down"), F.col("id").isNull().alias("_none"), "id", ROW,
        F.lit(1).alias("_one"))
    drawn = able.count() * percent // 100
    places = (start_offsets(able, ["_down", "_none", "id"], "_one", 1)
              .filter(F.col("_start") <= drawn)
              .select(F.col(ROW).alias("_place"), F.col("_start").alias("rank")))
    return (scored.join(places, scored[ROW] == places["_place"], "left")
            .select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank"))
