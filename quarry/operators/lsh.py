"""Approximate kNN by p-stable hashing with multi-probe.

Each of ``tables`` tables hashes a vector to ``bits`` numbers floor((a . x + b) / width), with a
close to normal. The projections are fixed: their components come from MD5, so any engine can
compute them anew. A query looks in its own bucket of every table and in the ``probes`` - 1
neighbouring buckets across the nearest boundaries.

Rows are stored once with their buckets and dealt to parts, queries to blocks. A task that has a
part keeps each table's buckets as a sorted array and streams a block of queries past it: each
bucket is compared with all queries that probe it by one block product, and the candidates of a
query over all tables, each once, are compared exactly. It yields the best ``k`` of a query; no
pair is ever a row. How much that spares is up to the data (``work``): neighbours must stand out
from the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.knn import (GRID_ROWS, PART_ROWS, TILE_QUERIES, TILE_ROWS, Block, Nearest,
                                  cell_runs, dealt_cells, empty_hits, exact_distances,
                                  final_topk, grid_shape, hit_schema, matrix, select_topk)
from quarry.session import ship_package, store

#: standard deviation of the sum of four bytes
SPREAD = 147.8


def component(table: int, bit: int, d: int) -> int:
    """Component d of a projection: the sum of the first four bytes of an MD5, less its mean."""
    return sum(hashlib.md5(f"{table}:{bit}:{d}".encode()).digest()[:4]) - 510


class Projections:
    def __init__(self, dim: int, tables: int, bits: int, width: float):
        self.dim, self.tables, self.bits, self.width = dim, tables, bits, width
        names = [(t, m) for t in range(tables) for m in range(bits)]
        self.a = np.array([[component(t, m, d) for d in range(dim)] for t, m in names], float)
        self.b = np.array([component(t, m, -1) % 1000 / 1000 * width for t, m in names])

    def places(self, X: np.ndarray) -> np.ndarray:
        """(rows, tables, bits): where vectors fall, in bucket widths."""
        y = (X @ self.a.T / SPREAD + self.b) / self.width
        return y.reshape(len(X), self.tables, self.bits)

    @staticmethod
    def codes(cells: np.ndarray) -> np.ndarray:
        """One number for the ``bits`` cells on the last axis. Equal cells have equal numbers; if
        unlike ones do, a row more is compared."""
        out = np.full(cells.shape[:-1], cells.shape[-1], np.uint64)
        for m in range(cells.shape[-1]):
            out = (out ^ cells[..., m].astype(np.int64).view(np.uint64)) * np.uint64(
                0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def own(self, X: np.ndarray) -> np.ndarray:
        """(rows, tables) codes of the vectors' buckets; components that are not finite count as
        0 there."""
        return self.codes(np.floor(self.places(np.where(np.isfinite(X), X, 0.0))))

    def probes(self, X: np.ndarray, n: int) -> np.ndarray:
        """(rows, tables, at most n) codes: the own bucket, then those across the nearest
        boundaries (ties: the lower bit, downwards first)."""
        y = self.places(np.where(np.isfinite(X), X, 0.0))
        cell = np.floor(y)
        gap = np.stack((y - cell, 1 - (y - cell)), -1).reshape(*y.shape[:2], -1)
        nearest = np.argsort(gap, axis=-1, kind="stable")[..., :max(n - 1, 0)]
        out = [self.codes(cell)]
        for p in range(nearest.shape[-1]):
            moved = cell.copy()
            bit, up = nearest[..., p] // 2, nearest[..., p] % 2
            at = np.take_along_axis(moved, bit[..., None], -1)
            np.put_along_axis(moved, bit[..., None], at + (2 * up - 1)[..., None], -1)
            out.append(self.codes(moved))
        return np.stack(out, -1)


def _lists(codes: np.ndarray) -> pa.Array:
    flat = codes.reshape(len(codes), -1)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


class LshIndex:
    def __init__(self, rows: DataFrame, projections: Projections, n: int, part_rows: int):
        self.rows, self.projections = rows, projections                      # (idx, v, codes)
        self.n, self.part_rows = n, part_rows
        self.parts = max(1, -(-n // part_rows))

    @classmethod
    def build(cls, corpus: DataFrame, dim: int, tables: int = 12, bits: int = 4,
              width: float = 1.0, id_col: str = "idx", vec_col: str = "embedding",
              part_rows: int = PART_ROWS) -> "LshIndex":
        """Hash every row of ``corpus`` that has a vector, of ``dim`` components."""
        ship_package(corpus.sparkSession)
        made = Projections(dim, tables, bits, width)
        rows = corpus.select(F.col(id_col).cast("long").alias("idx"),
                             F.col(vec_col).alias("v")).filter(F.col("v").isNotNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = made.own(matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(codes)],
                                                 names=["idx", "v", "codes"])
        kind = dict(rows.dtypes)["v"]
        stored = store(rows.mapInArrow(run, f"idx long, v {kind}, codes array<long>"), "hashed")
        return cls(stored, made, stored.count(), part_rows)

    def hits(self, queries: DataFrame, k: int, probes: int = 4, qid_col: str = "query_id",
             qvec_col: str = "embedding", counted: bool = False) -> DataFrame:
        """(query_id, idx, distance): each part's best rows of a query. ``counted``: with
        ``compared``, on the first of them, how many of its rows are in the query's buckets."""
        made, dim = self.projections, self.projections.dim
        asked = queries.select(F.col(qid_col).alias("query_id"),
                               F.col(qvec_col).alias("v")).filter(F.col("v").isNotNull())
        id_kind, kind = dict(asked.dtypes)["query_id"], dict(asked.dtypes)["v"]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = made.probes(matrix(batch.column(1), dim), probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(codes)],
                                                 names=["query_id", "v", "codes"])
        sent = asked.mapInArrow(probe, f"query_id {id_kind}, v {kind}, codes array<long>")
        parts, blocks = grid_shape(self.n, asked.count(), self.part_rows, GRID_ROWS)
        fields = hit_schema(asked, "query_id")
        if counted:
            fields = fields.add("compared", "long")
        return dealt_cells(self.rows, sent.withColumnRenamed("v", "q"), parts, blocks).mapInArrow(
            _streamed(k, dim, made.tables, counted), fields)

    def search(self, queries: DataFrame, k: int = 5, probes: int = 4, qid_col: str = "query_id",
               qvec_col: str = "embedding") -> DataFrame:
        """(query_id, rank, idx, distance): the nearest of the rows in the probed buckets, fewer
        than ``k`` if these hold fewer, ties to the lower idx. Query ids are unique."""
        if k <= 0:
            return empty_hits(queries, qid_col)
        return final_topk(self.hits(queries, k, probes, qid_col, qvec_col), k)

    def work(self, queries: DataFrame, k: int = 5, probes: int = 4, **columns) -> float:
        """Share of all pairs that a search compares."""
        rows, asked = self.rows.count(), queries.count()
        done = self.hits(queries, k, probes, counted=True, **columns).agg(F.sum("compared")).first()[0] or 0
        return done / (rows * asked) if rows and asked else 0.0


def _streamed(k: int, dim: int, tables: int, counted: bool):
    """Sorted (cell, asks, idx, query_id, v, codes): the rows of a cell, then its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces, part = None, [], None
        for cell, asks, some in cell_runs(batches):
            if cell != number:
                number, pieces, part = cell, [], None
            codes = some.column(5).flatten().to_numpy().reshape(len(some), tables, -1)
            if not asks:
                pieces.append((np.asarray(some.column(2)), matrix(some.column(4), dim, None),
                               codes[..., 0]))
                continue
            if part is None and pieces:
                part, pieces = Buckets(*(np.concatenate(x) for x in zip(*pieces)), k), []
            if part is None:
                continue
            qi, ids, dist = part.topk(matrix(some.column(4), dim), codes)
            out = [some.column(3).take(pa.array(qi)), pa.array(ids), pa.array(dist)]
            names = ["query_id", "idx", "distance"]
            if counted:
                first = np.append(True, qi[1:] != qi[:-1])[:len(qi)]
                compared = [len(part.marked(codes[q])) if f else 0 for q, f in zip(qi, first)]
                out, names = [*out, pa.array(compared, pa.int64())], [*names, "compared"]
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


class Buckets:
    """The rows of a part in the buckets of each table."""

    def __init__(self, ids: np.ndarray, V: np.ndarray, codes: np.ndarray, k: int):
        self.all = np.sort(codes, axis=0), np.argsort(codes, axis=0, kind="stable")
        # equal vectors are in the same buckets
        self.block, self.k = Block(V, ids, k, "euclidean"), k
        self.codes = codes[self.block.one]
        self.tables = []                # order of the fine rows, and bucket names and bounds
        for c in self.codes[self.block.fine].T:
            order = np.argsort(c, kind="stable")
            name, start = np.unique(c[order], return_index=True)
            self.tables.append((order, name, np.append(start, len(c))))

    def marked(self, codes: np.ndarray) -> np.ndarray:
        """Rows, with all copies, in the buckets (table, probe) of a query."""
        C, order = self.all
        near = np.zeros(len(C), bool)
        for t in range(len(codes)):
            low = np.searchsorted(C[:, t], codes[t], "left")
            high = np.searchsorted(C[:, t], codes[t], "right")
            for x, y in zip(low, high):
                near[order[x:y, t]] = True
        return np.flatnonzero(near)

    def topk(self, Q: np.ndarray, codes: np.ndarray):
        """(query row, id, distance) for queries with their (table, probe) codes."""
        block = self.block
        norms = np.sqrt(np.square(np.where(np.isfinite(Q), Q, 0.0)).sum(1))
        whole = np.isfinite(Q).all(1) & np.isfinite(norms)
        sane = np.flatnonzero(whole)
        X, slack = block.asks(Q[sane], norms[sane])
        near = Nearest(len(sane), self.k, slack, again=True)
        for t, (order, name, start) in enumerate(self.tables):
            if len(order) and len(sane):
                self._compare(near, X, codes[sane, t], block.F[order], order, name, start)
        q, v, _ = near.pending()
        q, v = sane[q], block.fine[v]
        found = [select_topk(q, block.ids[v], exact_distances(Q, block.V, q, v, "euclidean"),
                             self.k)]
        # distances that are not a number, or infinite, count where there are too few others
        few = np.ones(len(Q), bool)
        few[sane] = np.isinf(near.best).any(1) if len(block.odd) else False
        for x in np.flatnonzero(few):
            rows = block.odd if whole[x] else np.arange(len(block.V))
            hit = [np.isin(self.codes[rows, t], c) for t, c in enumerate(codes[x])]
            v = rows[np.any(hit, axis=0)]
            at = np.full(len(v), x)
            found.append((at, block.ids[v], exact_distances(Q, block.V, at, v, "euclidean")))
        return select_topk(*(np.concatenate(x) for x in zip(*found)), self.k)

    @staticmethod
    def _compare(near: Nearest, X, asked, rows, order, name, start) -> None:
        """All queries of a table's buckets with the rows there, bucket by bucket."""
        place = np.minimum(np.searchsorted(name, asked.ravel()), len(name) - 1)
        at = np.flatnonzero(name[place] == asked.ravel())
        at = at[np.argsort(place[at], kind="stable")]
        who, bucket = at // asked.shape[1], place[at]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(at) else []
        for a, b in zip(first, np.append(first[1:], len(at))):
            low, high = start[bucket[a]], start[bucket[a] + 1]
            for i in range(a, b, TILE_QUERIES):
                some = who[i:min(i + TILE_QUERIES, b)]
                mine = X[some]
                for j in range(low, high, TILE_ROWS):
                    end = min(j + TILE_ROWS, high)
                    near.add(some, mine @ rows[j:end].T, order[j:end])
