"""k-nearest-neighbour join of a query table against a vector table.

Three strategies, chosen by the caller:

* ``grid`` (default): corpus rows are dealt by hash to parts and queries to blocks; the task of
  a (part, block) cell keeps the part, streams the block past it, computes distances with numpy
  (float32 block products, a tile at a time, for the candidate set, exact float64 differences for
  the kept rows) and yields the best ``k`` per query. Both sides stay in the executors, whatever
  their size.
* ``broadcast``: for a small batch of queries. The batch is collected behind a check of its
  bytes (above the bound it is an error), broadcast once, and every task of the corpus scan
  keeps a running top ``k``, so the corpus is not shuffled.
* ``pivot``: Euclidean only. Rows in pivot cells are stored once and queries go to the cells that
  distance bounds cannot exclude (``operators.pivots``).

No pair of (query, vector) rows is ever materialised. A final ``row_number`` window (planned as
a partial + final ``WindowGroupLimit``) picks the global top ``k``, ties broken by lower ``idx``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ship_package, store

DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
PART_ROWS = 32768       # corpus rows of a part, and
BLOCK_ROWS = 4096       # queries that come to it as one group
#: a grid cell's rows and queries at most, its pairs, and cells, about
GRID_ROWS, CELL_PAIRS, CELLS = 1 << 17, 1 << 27, 256
#: a tile of estimates has so many rows and queries: 4 MB
TILE_ROWS, TILE_QUERIES = 4096, 256
#: candidates held before they are sifted, and compared at a time
PENDING, EXACT = 1 << 20, 1 << 15


def hit_schema(queries: DataFrame, qid_col: str) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema[qid_col].dataType),
                         T.StructField("idx", T.LongType()),
                         T.StructField("distance", T.DoubleType())])


def empty_hits(queries: DataFrame, qid_col: str) -> DataFrame:
    fields = hit_schema(queries, qid_col).fields
    return queries.sparkSession.createDataFrame([], T.StructType(
        [fields[0], T.StructField("rank", T.IntegerType()), *fields[1:]]))


def _as_matrix(values, dim: int | None = None) -> np.ndarray:
    """Rows of one length as a matrix, by one flat copy."""
    values = list(values)
    if not values:
        return np.zeros((0, dim or 0))
    lens = {len(v) for v in values}
    if len(lens) != 1 or (dim is not None and lens != {dim}):
        raise ValueError(f"vectors of different length: {sorted(lens)} (expected {dim})")
    return np.concatenate(values).astype(np.float64).reshape(len(values), -1)


def matrix(column, dim: int | None = None, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column as float64, or as they are (``kind`` None); null elements are
    NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if kind is not None or flat.dtype.kind != "f":
        flat = flat.astype(kind or np.float64)
    width = dim if dim is not None else (len(flat) // len(column) if len(column) else 0)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors of different length: {sorted(set(lengths.tolist()))} "
                         f"(expected {width})")
    return flat.reshape(len(column), width)


def select_topk(qi: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int):
    """Keep the ``k`` best (distance, id) rows of every query; NaN distances sort last."""
    order = np.lexsort((ids, d, qi))
    qi, ids, d = qi[order], ids[order], d[order]
    if len(qi) == 0:
        return qi, ids, d
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    counts = np.diff(np.r_[starts, len(qi)])
    rank = np.arange(len(qi)) - np.repeat(starts, counts)
    keep = rank < k
    return qi[keep], ids[keep], d[keep]


def few_copies(M: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``M`` without those equal to ``k`` rows of lower id, which no query has use for."""
    if len(M) <= k:
        return np.arange(len(M))
    words = np.ascontiguousarray(M).view(np.uint8).reshape(len(M), -1)
    words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)
    odd = np.random.default_rng(0).integers(1, 1 << 62, words.shape[1], np.uint64) * np.uint64(2)
    _, at, count = np.unique(((words ^ (words >> np.uint64(29))) * (odd + np.uint64(1))).sum(1),
                             return_inverse=True, return_counts=True)
    many = np.flatnonzero(count[at] > k)        # only these can have so many equals
    if not len(many):
        return np.arange(len(M))
    _, same = np.unique(words[many], axis=0, return_inverse=True)
    same = same.ravel()
    order = np.lexsort((ids[many], same))
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    rank = np.arange(len(many)) - np.repeat(starts, np.diff(np.r_[starts, len(many)]))
    keep = np.ones(len(M), bool)
    keep[many[order[rank >= k]]] = False
    return np.flatnonzero(keep)


def rounding(dim: int) -> float:
    """Relative error, at most, of a float32 product of rounded vectors, with room to spare."""
    return (dim + 8) * 1.2e-7


def flat_true(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` for a mask that is mostly false."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


class Nearest:
    """The candidates of some queries among rows that come block by block: those whose estimate
    is within its error of the ``k`` least. ``again``: a row may come again, in another block."""

    def __init__(self, n: int, k: int, slack: np.ndarray, again: bool = False):
        self.k, self.again = k, again
        self.slack = slack.astype(np.float32)       # by query
        self.best = np.full((n, k), np.inf, np.float32)
        self.rows = np.full((n, k), -1, np.int64)
        self.limit = np.full(n, np.inf, np.float32)
        self.found = []

    def add(self, at: np.ndarray, S: np.ndarray, rows: np.ndarray) -> None:
        """``S``: estimates of the queries ``at`` and ``rows``, none twice in a block."""
        limit = self.limit[at]
        if S.shape[1] > self.k and not np.isfinite(limit).all():
            own = np.partition(S, self.k - 1, axis=1)[:, self.k - 1] + self.slack[at]
            limit = np.minimum(limit, own)
        flat = flat_true(S <= limit[:, None])
        if not len(flat):
            return
        q, v = np.divmod(flat, S.shape[1])
        value, row, asked = S.ravel()[flat], rows[v], at[q]
        self.found.append((asked.astype(np.int32), row.astype(np.int32), value))
        self._merge(at, q, row, value)
        if sum(len(x[0]) for x in self.found[-64:]) > PENDING:
            self.found = [self.pending()]

    def _merge(self, at, q, row, value) -> None:
        starts = np.flatnonzero(np.r_[True, np.diff(q) > 0])
        size = np.diff(np.r_[starts, len(q)])
        line = np.repeat(np.arange(len(starts)), size)
        place = np.arange(len(q)) - np.repeat(starts, size)
        who = at[q[starts]]
        values = np.full((len(starts), size.max()), np.inf, np.float32)
        named = np.full(values.shape, -1, np.int64)
        values[line, place], named[line, place] = value, row
        for j in range(self.k if self.again else 0):        # a row counts once
            values[named == self.rows[who, j][:, None]] = np.inf
        values = np.concatenate((self.best[who], values), axis=1)
        named = np.concatenate((self.rows[who], named), axis=1)
        first = np.argpartition(values, self.k - 1, axis=1)[:, :self.k]
        self.best[who] = np.take_along_axis(values, first, 1)
        self.rows[who] = np.take_along_axis(named, first, 1)
        self.limit[who] = np.minimum(self.limit[who], self.best[who].max(1) + self.slack[who])

    def pending(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, estimate) of what is left by the bounds as they are, each pair once."""
        if not self.found:
            e = np.zeros(0, np.int32)
            return e, e, np.zeros(0, np.float32)
        q, v, s = (np.concatenate(x) for x in zip(*self.found))
        ok = s <= self.limit[q]
        q, v, s = q[ok], v[ok], s[ok]
        _, one = np.unique(q.astype(np.int64) << 32 | v, return_index=True)
        return q[one], v[one], s[one]


def exact_distances(Q: np.ndarray, V: np.ndarray, qi: np.ndarray, vi: np.ndarray, metric: str
                    ) -> np.ndarray:
    """Float64 distances of the pairs of rows ``qi``, ``vi``, some at a time."""
    out = np.empty(len(qi))
    for x in range(0, len(qi), EXACT):
        a, b = Q[qi[x:x + EXACT]], V[vi[x:x + EXACT]].astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            if metric == "cosine":
                an, bn = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
                d = 1.0 - np.einsum("ij,ij->i", a, b) / (an * bn)
                out[x:x + EXACT] = np.where((an == 0) | (bn == 0), np.nan, d)
            else:
                diff = a - b
                out[x:x + EXACT] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


class Block:
    """Vectors with their ids, ready for exact top-``k`` searches. Estimates are float32 block
    products, a tile at a time, so memory does not grow with the block times the queries; rows
    within their error of the ``k`` best are compared in float64."""

    def __init__(self, V: np.ndarray, ids: np.ndarray, k: int, metric: str,
                 one: np.ndarray | None = None):
        """``one``: the rows to keep, where the caller knows which ones are equal."""
        self.one = few_copies(V, ids, k) if one is None else one
        self.V, self.ids = V[self.one], ids[self.one].astype(np.int64)
        self.k, self.metric = k, metric
        norms = np.concatenate([np.zeros(0), *[np.sqrt(np.square(self.V[x:x + TILE_ROWS].astype(
            np.float64)).sum(1)) for x in range(0, len(self.V), TILE_ROWS)]])
        ok = np.isfinite(norms)
        if metric == "cosine":
            ok &= norms > 0
        self.fine, self.odd = np.flatnonzero(ok), np.flatnonzero(~ok)
        self.far = norms[self.fine].max(initial=0.0)
        self.scale = self.far or 1.0
        self.F = np.zeros((len(self.fine), V.shape[1] + 1), np.float32)
        for x in range(0, len(self.fine), TILE_ROWS):
            rows = self.fine[x:x + TILE_ROWS]
            each = norms[rows, None] if metric == "cosine" else self.scale
            part = self.V[rows] / each
            self.F[x:x + TILE_ROWS, :-1] = -part
            if metric != "cosine":
                self.F[x:x + TILE_ROWS, -1] = np.square(part).sum(1) / 2

    def asks(self, Q: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries as they are multiplied with ``F``, and twice the error of an estimate, at
        most. Queries are scaled apart from rows: only the order of a query's rows counts."""
        one = np.ones((len(Q), 1), np.float32)
        if self.metric == "cosine":
            X = (Q / norms[:, None]).astype(np.float32)
            return np.hstack((X, one)), np.full(len(Q), 4 * rounding(Q.shape[1]))
        X, far = Q / self.scale, norms / self.scale
        big = np.maximum(far, 1.0)              # a far query's products stay small
        slack = 4 * rounding(Q.shape[1]) * (far / big + 1 / big) + 1e-30
        return np.hstack((X / big[:, None], one / big[:, None])).astype(np.float32), slack

    def limits(self, norms: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Euclidean distances as estimates of the queries' rows, not below them; what is no
        number or too large for one is no limit."""
        with np.errstate(over="ignore", invalid="ignore"):
            far, reach = np.square(norms / self.scale), np.square(bound / self.scale)
            out = (reach - far + 1e-14 * (reach + far)) / (2 * np.maximum(norms / self.scale, 1.0))
        return np.where(np.isfinite(out) & (out < 1e38), out, np.inf)

    def topk(self, Q: np.ndarray, bound: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance): the ``k`` nearest rows of each query, NaN last, ties to
        the lower id. ``bound`` (Euclidean): rows beyond that distance may be left out; NaN is
        no bound."""
        parts = [self._tile(Q[s:s + TILE_QUERIES], s,
                            None if bound is None else bound[s:s + TILE_QUERIES])
                 for s in range(0, len(Q), TILE_QUERIES)]
        e = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip((e, e, np.zeros(0)), *parts))

    def _tile(self, Q: np.ndarray, first: int, bound: np.ndarray | None = None):
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt(np.square(Q).sum(1))
        ok = np.isfinite(norms)
        if self.metric == "cosine":
            ok &= norms > 0
        sane, rest = np.flatnonzero(ok), np.flatnonzero(~ok)
        X, slack = self.asks(Q[sane], norms[sane])
        near = Nearest(len(sane), self.k, slack)
        if bound is not None:
            near.limit = (self.limits(norms[sane], bound[sane]) + slack).astype(np.float32)
        at = np.arange(len(sane))
        for s in range(0, len(self.F) if len(sane) else 0, TILE_ROWS):
            near.add(at, X @ self.F[s:s + TILE_ROWS].T, np.arange(
                s, min(s + TILE_ROWS, len(self.F))))
        q, v, _ = near.pending()
        found = [self._best(Q, sane[q], self.fine[v])]
        # pairs with a distance that is not a number, or infinite
        for some, rows in ((sane, self.odd), (rest, np.arange(len(self.V)))):
            for s in range(0, len(rows) if len(some) else 0, TILE_ROWS):
                few = rows[s:s + TILE_ROWS]
                found.append(self._best(Q, np.repeat(some, len(few)), np.tile(few, len(some))))
        qi, i, d = self._kept(*(np.concatenate(x) for x in zip(*found)))
        return qi + first, i, d

    def _best(self, Q: np.ndarray, qi: np.ndarray, vi: np.ndarray):
        return self._kept(qi.astype(np.int64), self.ids[vi],
                          exact_distances(Q, self.V, qi, vi, self.metric))

    def _kept(self, qi, ids, d):
        return select_topk(qi, ids, d, self.k)


def block_topk(Q: np.ndarray, V: np.ndarray, ids: np.ndarray, k: int, metric: str):
    """Exact top-``k`` rows of one vector block for every query of ``Q``: (query_row, id,
    distance) arrays."""
    if not len(V) or not len(Q) or k <= 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    return Block(V, ids, k, metric).topk(Q)


def cell_hits(k: int, metric: str):
    """cogroup body: corpus rows (idx, v) and queries (query_id, q) of one cell -> hits."""
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": asked.query_id[:0], "idx": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="float64")})
        Q = _as_matrix(asked.q)
        V = _as_matrix(rows.v, Q.shape[1])
        qi, ids, dist = block_topk(Q, V, rows.idx.to_numpy(np.int64), k, metric)
        return pd.DataFrame({"query_id": asked.query_id.to_numpy()[qi], "idx": ids,
                             "distance": dist})
    return run


def final_topk(hits: DataFrame, k: int) -> DataFrame:
    """Global top-k per query with ``rank`` 1..k, ties broken by the lower idx."""
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("idx").asc())
    return (hits.withColumn("rank", F.row_number().over(w))
                .where(F.col("rank") <= k)
                .select("query_id", F.col("rank").cast("int").alias("rank"), "idx", "distance"))


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "euclidean",
        id_col: str = "idx", vec_col: str = "embedding", qid_col: str = "query_id",
        qvec_col: str = "embedding", strategy: str = "grid", part_rows: int | None = None,
        block_rows: int = GRID_ROWS,
        max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Exact kNN join: (query_id, rank, idx, distance), ``rank`` 1..min(k, corpus size). Rows
    without a vector on either side take no part."""
    ship_package(corpus.sparkSession)
    rows = corpus.select(F.col(id_col).alias("idx"), F.col(vec_col).alias("v")).where(
        F.col("v").isNotNull())
    asked = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("q")).where(
        F.col("q").isNotNull())
    if k <= 0:
        return empty_hits(queries, qid_col)
    if strategy == "broadcast":
        hits = _broadcast_hits(rows, asked, k, metric, max_broadcast_bytes)
    elif strategy == "pivot":
        if metric != "euclidean":
            raise ValueError("pivot bounds hold for Euclidean distances only")
        from quarry.operators.pivots import PivotIndex
        return PivotIndex.build(rows, vec_col="v", part_rows=part_rows or PART_ROWS).search(
            asked, k, qvec_col="q")
    elif strategy == "grid":
        hits = _grid_hits(rows, asked, k, metric, part_rows or GRID_ROWS, block_rows)
    else:
        raise ValueError(f"unknown strategy: {strategy!r}")
    return final_topk(hits, k)


def grid_shape(rows: int, asked: int, part_rows: int, block_rows: int) -> tuple[int, int]:
    """(parts, blocks): cells of about ``CELL_PAIRS`` pairs, about ``CELLS`` of them at most, with
    the fewest copies of rows and queries; parts and blocks have so many rows at most."""
    cells = max(1, min(CELLS, -(-rows * asked // CELL_PAIRS)))
    parts = max(-(-rows // part_rows), round((cells * rows / max(asked, 1)) ** 0.5), 1)
    parts = min(parts, max(cells, -(-rows // part_rows), 1))
    return parts, max(-(-asked // block_rows), -(-cells // parts), 1)


def _grid_hits(rows: DataFrame, asked: DataFrame, k: int, metric: str, part_rows: int,
               block_rows: int) -> DataFrame:
    asked = store(asked, "queries")
    parts, blocks = grid_shape(rows.count(), asked.count(), part_rows, block_rows)
    return dealt_cells(rows, asked, parts, blocks).mapInArrow(
        streamed(k, metric), hit_schema(asked, "query_id"))


def dealt_cells(rows: DataFrame, asked: DataFrame, parts: int, blocks: int) -> DataFrame:
    """Rows (idx, v) and queries (query_id, q) of the cells, each (part, block): sorted (cell,
    asks, idx, query_id, v, ...), rows first. Other columns that both tables have go along."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    more = [c for c in rows.columns if c != "v" and c in asked.columns]
    kinds = dict(rows.dtypes)["v"], dict(asked.dtypes)["q"]
    vector = kinds[0] if kinds[0] == kinds[1] else "array<double>"
    cell = (F.col("_part") * blocks + F.col("_block")).alias("cell")
    left = (rows.withColumn("_part", F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int"))
            .withColumn("_block", every(blocks))
            .select(cell, F.lit(0).alias("asks"), "idx",
                    F.lit(None).cast(dict(asked.dtypes)["query_id"]).alias("query_id"),
                    F.col("v").cast(vector).alias("v"), *more))
    right = (asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
             .withColumn("_part", every(parts))
             .select(cell, F.lit(1).alias("asks"), F.lit(None).cast("long").alias("idx"),
                     "query_id", F.col("q").cast(vector).alias("v"), *more))
    # a number of partitions is given, or small cells would share a task
    return (left.unionByName(right).repartition(parts * blocks, "cell")
            .sortWithinPartitions("cell", "asks"))


def cell_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(cell, asks, rows) for every run of a sorted stream (cell, asks, ...) in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1)])
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(key))):
            yield key[a, 0], key[a, 1], batch.slice(a, b - a)


def streamed(k: int, metric: str):
    """Sorted (cell, asks, idx, query_id, v): the rows of a cell, then its queries -> hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces, block = None, [], None
        for cell, asks, some in cell_runs(batches):
            if cell != number:
                number, pieces, block = cell, [], None
            if not asks:
                pieces.append((matrix(some.column(4), kind=None), np.asarray(some.column(2))))
                continue
            if block is None and pieces:
                V, ids = (np.concatenate(x) for x in zip(*pieces))
                block, pieces = Block(V, ids, k, metric), []
            if block is not None:
                qi, ids, dist = block.topk(matrix(some.column(4), block.V.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(3).take(pa.array(qi)), pa.array(ids), pa.array(dist)],
                    names=["query_id", "idx", "distance"])
    return run


def _broadcast_hits(rows: DataFrame, asked: DataFrame, k: int, metric: str,
                    max_bytes: int) -> DataFrame:
    stats = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d")).first()
    if stats["n"] * ((stats["d"] or 0) * 8 + 64) > max_bytes:
        raise ValueError(f"{stats['n']} queries exceed {max_bytes} broadcast bytes; "
                         "use strategy='grid'")
    batch = asked.toPandas()
    Q, names = _as_matrix(batch.q), batch.query_id.to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast((Q, names))

    def run(batches):
        Q, names = sent.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for pdf in batches:
            if len(pdf) and len(Q):
                V = _as_matrix(pdf.v, Q.shape[1])
                found = block_topk(Q, V, pdf.idx.to_numpy(np.int64), k, metric)
                best = select_topk(*(np.concatenate(x) for x in zip(best, found)), k)
        if len(best[0]):
            yield pd.DataFrame({"query_id": names[best[0]], "idx": best[1], "distance": best[2]})

    return rows.mapInPandas(run, hit_schema(asked, "query_id"))
