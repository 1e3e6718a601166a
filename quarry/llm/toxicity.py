"""Toxicity by maximum-scoring segments.

Learning: every token is hashed to one of ``buckets`` ids. Background counts over all documents
are the Dirichlet prior of the log-odds between the toxic and the clean labelled sample (a
bounded, documented number of rows, chosen by the hash of the id). All these count the texts that
hold a token, not its repeats, and near copies of one label in the sample count as one text (several
least hashes of their five-word shingles agree; shorter texts must be equal), so a text that is
repeated is no evidence about its words. Log-odds that are within their standard error's ``z`` are noise and count nothing, and
every token pays ``drift``, so a score is negative on average and passages are local.

Scoring: the Ruzzo-Tompa scan finds all maximal scoring segments of a token sequence in linear
time. Their scores are calibrated as extreme values: lambda solves sum p exp(lambda s) = 1 over
the background, K is fitted on clean calibration rows, and a segment of score S in a text of m
tokens has the tail probability 1 - exp(-K m exp(-lambda S)). Passages are the segments that this
makes significant; the sum of all positive normalised scores lambda S - ln(K m) is turned into a probability by a logistic fit on calibration rows that the
log-odds have not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch
from quarry.llm.wordscan import slices

#: at most so many labelled rows are used to fit
TRAIN_ROWS = 40_000
#: size of the hashed vocabulary: the bound of what is collected and broadcast
BUCKETS = 1 << 18
#: weight of the background in the prior, and what it gives every bucket besides
PRIOR_TOKENS = 2_000.0
PRIOR_FLOOR = 0.5
Z = 2.5
DRIFT = 0.1
SIGNIFICANT = 0.05
#: min-hashes that copies in the sample have in common
AGREE = 3
#: words of a task that are remembered before the memory is emptied
CACHE = 200_000

WORD = re.compile(r"[^\W_]+")
PASSAGES = "array<struct<start:int,end:int,score:double,p_value:double>>"


class Buckets(dict):
    """token -> bucket of its lower-case form."""

    def __init__(self, buckets: int):
        super().__init__()
        self.n = buckets

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        b = self[token] = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % self.n
        return b

    def ids(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text or "")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass(frozen=True)
class Model:
    """Token scores by bucket, the extreme-value parameters and the logistic link."""

    weights: np.ndarray
    lam: float
    k: float
    slope: float
    bias: float
    significant: float = SIGNIFICANT

    def segments(self, ids: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Segments above what chance gives: (first token, token after the last, normalised score,
        p-value)."""
        found = []
        for a, b, s in maximal_segments(self.weights[ids]):
            normal = self.lam * s - np.log(self.k * len(ids))
            p = -np.expm1(-np.exp(-normal))
            if normal > 0:
                found.append((a, b, float(normal), float(p)))
        return found

    def evidence(self, ids: np.ndarray) -> float:
        return float(np.log1p(sum(s for _, _, s, _ in self.segments(ids))))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.slope * evidence))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) as (start, end, score), by position.
    Only positive scores start or end one, so the scan visits just those."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    after = np.cumsum(scores)
    done: list[list] = []          # [start, end, sum before, sum after, last smaller before]
    for i, right in zip(positive.tolist(), after[positive].tolist()):
        now = [i, i + 1, right - float(scores[i]), right, -1]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= now[2]:
                j = done[j][4]
            if j < 0 or done[j][3] >= now[3]:
                now[4] = j
                done.append(now)
                break
            now = [done[j][0], now[1], done[j][2], now[3], -1]
            del done[j:]
    return [(a, b, r - l) for a, b, l, r, _ in done]


def log_odds(toxic: np.ndarray, clean: np.ndarray, background: np.ndarray,
             prior: float = PRIOR_TOKENS, z: float = Z, drift: float = DRIFT) -> np.ndarray:
    """Token scores: log-odds with an informative Dirichlet prior, noise set to 0, less drift."""
    alpha = prior * background / max(background.sum(), 1) + PRIOR_FLOOR
    a, b = toxic + alpha, clean + alpha
    rest = prior + PRIOR_FLOOR * (background > 0).sum()
    delta = np.log(a / (toxic.sum() + rest)) - np.log(b / (clean.sum() + rest))
    delta[np.abs(delta) < z * np.sqrt(1 / a + 1 / b)] = 0
    return delta - drift


def extreme_value_lambda(weights: np.ndarray, background: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (1.0 where no token scores above zero)."""
    p = background / max(background.sum(), 1)
    if not ((weights > 0) & (p > 0)).any() or (p * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    total = lambda x: (p * np.exp(np.minimum(x * weights, 700))).sum()
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, bias) by Newton steps with a weak pull to no slope and a rare class."""
    design = np.column_stack((x, np.ones(len(x))))
    w, pull, at = np.zeros(2), np.array([0.01, 0.5]), np.array([0.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + pull * (w - at)
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of learning."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def _count(buckets: int):
    """Per bucket: tokens, and texts that hold one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Buckets(buckets)
        tokens, texts = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                kinds, n = np.unique(memory.ids(text), return_counts=True)
                tokens[kinds] += n
                texts[kinds] += 1
        hit = np.flatnonzero(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(tokens[hit]),
                                          pa.array(texts[hit])], names=["bucket", "n", "texts"])
    return run


def copy_key(ids: np.ndarray) -> int:
    """Name of a text in the sample: one hash of the ``AGREE`` min-hashes of its five-word
    shingles, or of all its tokens in order if it has fewer than five; -1 without tokens."""
    if not len(ids):
        return -1
    ids = ids.astype(np.uint64)
    width = 5 if len(ids) >= 5 else len(ids)
    mixed = np.full(len(ids) - width + 1, len(ids) if width < 5 else 5, np.uint64)
    for k in range(width):
        mixed = (mixed + ids[k:k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    key, full = 0, (1 << 64) - 1
    for salt in range(AGREE):
        h = (mixed ^ np.uint64(salt * 0x632BE59BD9B4E019 & full)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        key = (key ^ int(h.min())) * 0x9E3779B97F4A7C15 & full
    return key >> 1


def _copy_keys(buckets: int):
    """(id, y, fold, text) with the text's ``copy_key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Buckets(buckets)
        for batch in batches:
            keys = [copy_key(memory.ids(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())],
                                             names=["id", "y", "fold", "text", "key"])
    return run


def _dense(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, texts) by bucket over a table of texts: at most ``buckets`` rows are collected."""
    counts = rows.mapInArrow(_count(buckets), "bucket long, n long, texts long")
    tokens, texts = np.zeros(buckets), np.zeros(buckets)
    for bucket, n, t in counts.groupBy("bucket").agg(F.sum("n"), F.sum("texts")).collect():
        tokens[bucket], texts[bucket] = n, t
    return tokens, texts


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train_rows: int = TRAIN_ROWS,
          buckets: int = BUCKETS) -> Model:
    """Fit on at most ``train_rows`` labelled rows outside fold 0: folds 1 to 3 for the
    log-odds, fold 4 for the calibration. Background counts are over all documents. Without
    labelled rows nothing scores and every text gets the same low probability."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
              .withColumn("fold", fold("id")).filter("fold != 0")
              .orderBy(F.xxhash64("id"), "id").limit(train_rows))
    sample = texts.join(F.broadcast(chosen), "id").select(
        F.col("id").cast("long"), "y", F.col("fold").cast("int"), "text")
    sample = scratch.keep(
        sample.mapInArrow(_copy_keys(buckets), "id long, y int, fold int, text string, key long")
        .groupBy("key", "y").agg(F.min(F.struct("fold", "id", "y", "text")).alias("r"))
        .select("r.*"), "sample")
    tokens, background = _dense(texts.select("text"), buckets)
    toxic, clean = (_dense(sample.filter(f"fold < 4 AND y = {y}").select("text"), buckets)[1]
                    for y in (1, 0))
    weights = log_odds(toxic, clean, background)
    lam = extreme_value_lambda(weights, tokens)

    def best(batches):
        memory = Buckets(buckets)
        for batch in batches:
            y, m, s = batch.column(0).to_pylist(), [], []
            for text in batch.column(1).to_pylist():
                ids = memory.ids(text)
                m.append(float(max(len(ids), 1)))
                s.append(max((x for _, _, x in maximal_segments(weights[ids])), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(m), pa.array(s)],
                                             names=["y", "m", "s"])

    rows = np.array([tuple(r) for r in sample.filter("fold = 4").select("y", "text").mapInArrow(
        best, "y int, m double, s double").collect()]).reshape(-1, 3)
    clean = rows[rows[:, 0] == 0]
    k = len(clean) / (clean[:, 1] * np.exp(-lam * clean[:, 2])).sum() if len(clean) else 1e-3
    model = Model(weights, lam, k, 0.0, 0.0)

    def evidence(batches):
        memory = Buckets(buckets)
        for batch in batches:
            x = [model.evidence(memory.ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())],
                                             names=["y", "x"])

    xy = np.array([tuple(r) for r in sample.filter("fold = 4").select("y", "text").mapInArrow(
        evidence, "y int, x double").collect()]).reshape(-1, 2)
    slope, bias = logistic(xy[:, 1], xy[:, 0])
    scratch.drop(sample)
    return Model(weights, lam, k, slope, bias)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted as toxic. Texts are scored a few MB at a time
    and rows go in the same task, so a task holds little beside its batch; passages are not
    worked out."""
    columns, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Buckets(len(model.weights))
        for batch in batches:
            for i, j in slices(batch.column(place)):
                some = batch.slice(i, j - i)
                clean = [model.probability(model.evidence(memory.ids(t.as_py()))) < 0.5
                         for t in some.column(place)]
                yield some.filter(pa.array(clean, pa.bool_()))

    return docs.select(*columns).mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "") -> DataFrame:
    """``docs`` with ``{out}score`` (0 to 1), ``{out}predicted`` (1 from 0.5 on) and
    ``{out}passages``: the significant passages as code-point spans with the normalised score
    and p-value. Null and empty texts have no passage and the score of a text without one.
    Columns that already bear these names are replaced."""
    names = [f"{out}score", f"{out}predicted", f"{out}passages"]
    kept = docs.drop(*[n for n in names if n in docs.columns and n != text_col])
    buckets = len(model.weights)
    fields = [*kept.schema.fields, T.StructField(names[0], T.DoubleType()),
              T.StructField(names[1], T.IntegerType()),
              *T._parse_datatype_string(f"{names[2]} {PASSAGES}").fields]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                               ("score", pa.float64()), ("p_value", pa.float64())]))
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = model, Buckets(buckets)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(columns.index(text_col)).to_pylist():
                found = m.segments(memory.ids(text))
                scores.append(m.probability(float(np.log1p(sum(x[2] for x in found)))))
                found = [x for x in found if x[3] <= m.significant]
                at = [w.span() for w in WORD.finditer(text)] if found else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "p_value": p}
                              for a, b, s, p in found])
            s = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, s, pa.array([int(x >= 0.5) for x in scores], pa.int32()),
                 pa.array(spans, kind)], names=[*columns, *names])

    return kept.mapInArrow(run, T.StructType(fields))
