"""Approximate kNN by product quantisation with exact re-ranking.

A vector is cut into ``m`` stretches, each named by the nearest of at most 256 code vectors, so a
row is ``m`` bytes. Rows are dealt to parts and queries to blocks; a task that has a part keeps
its codes and streams a block past them. A row's estimate is the query's squared distance to the
code vectors that the row names: float32 block products with these tell which rows may be among
the best, and table look-ups of the squared distances to all code vectors add up the estimates of
those. The ``rerank`` best rows of a query are joined to their vectors, and exact distances decide
among them. The scan of a search reads ``m`` bytes a row in place of the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import l2_distance
from quarry.operators.knn import (CELL_PAIRS, CELLS, GRID_ROWS, Block, cell_runs, dealt_cells,
                                  empty_hits, few_copies, final_topk, matrix)
from quarry.session import ship_package, store

#: rows of which code vectors are learnt, at most
SAMPLE_ROWS = 20_000
#: codes of a part: 4 MB at 16 bytes
PART_ROWS = 1 << 18


def _squares(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Squared distances of stretches to code vectors, by differences, some rows at a time."""
    return np.concatenate([((X[i:i + 4096, None, :] - C[None]) ** 2).sum(2)
                           for i in range(0, len(X), 4096)] or [np.zeros((0, len(C)))])


def learn_codebooks(rows: DataFrame, m: int, codes: int = 256, id_col: str = "idx",
                    vec_col: str = "embedding", rounds: int = 8,
                    sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """(m, codes, stretch) code vectors: means of the ``sample_rows`` rows of least hash."""
    X = np.array([r[0] for r in rows.filter(F.col(vec_col).isNotNull()).orderBy(
        F.xxhash64(id_col), id_col).limit(sample_rows).select(vec_col).collect()], float)
    X = X[np.isfinite(X).all(1)]
    if not len(X) or X.shape[1] % m:
        raise ValueError(f"{m} stretches need vectors whose length they divide")
    books = []
    for part in np.split(X, m, axis=1):
        C = part[np.linspace(0, len(part) - 1, min(codes, len(part))).astype(int)]
        for _ in range(rounds):
            near = _squares(part, C).argmin(1)
            count = np.bincount(near, minlength=len(C))
            sums = np.zeros_like(C)
            np.add.at(sums, near, part)
            C = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], C)
        books.append(C)
    return np.array(books)


class PqIndex:
    def __init__(self, codebooks: np.ndarray, rows: DataFrame, vectors: DataFrame, n: int,
                 part_rows: int):
        self.codebooks = codebooks                  # (m, codes, stretch)
        self.rows, self.n = rows, n                 # (idx, code), and how many
        self.parts = max(1, -(-n // part_rows))
        self.vectors = vectors                      # (idx, v), read for re-ranking alone

    @classmethod
    def build(cls, corpus: DataFrame, codebooks=None, m: int = 16, codes: int = 256,
              id_col: str = "idx", vec_col: str = "embedding", part_rows: int = PART_ROWS
              ) -> "PqIndex":
        """Encode every row of ``corpus`` with a finite vector. ``codebooks``: given ones, of at
        most 256 code vectors a stretch."""
        ship_package(corpus.sparkSession)
        if codebooks is None:
            codebooks = learn_codebooks(corpus, m, codes, id_col, vec_col)
        books = np.asarray(codebooks, float)
        if books.ndim != 3 or books.shape[1] > 256:
            raise ValueError("codebooks are (stretches, at most 256 codes, components)")
        rows = corpus.select(F.col(id_col).cast("long").alias("idx"),
                             F.col(vec_col).alias("v")).filter(F.col("v").isNotNull())
        dim, width = books.shape[0] * books.shape[2], books.shape[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                X = matrix(batch.column(1), dim)
                fine = np.isfinite(X).all(1)
                code = np.stack([_squares(x, C).argmin(1).astype(np.uint8) for x, C in zip(
                    np.split(X[fine], width, axis=1), books)], 1)
                offsets = np.arange(len(code) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(fine)), pa.Array.from_buffers(
                        pa.binary(), len(code), [None, pa.py_buffer(offsets.tobytes()),
                                                 pa.py_buffer(code.tobytes())])],
                    names=["idx", "code"])
        stored = store(rows.mapInArrow(run, "idx long, code binary"), "codes")
        return cls(books, stored, rows, stored.count(), part_rows)

    def candidates(self, queries: DataFrame, n: int, qid_col: str = "query_id",
                   qvec_col: str = "embedding") -> DataFrame:
        """(query_id, idx, distance): the ``n`` best rows of each query by estimated squared
        distance, ties to the lower idx."""
        asked = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).cast(
            "array<double>").alias("q")).filter(F.col("q").isNotNull())
        id_kind = dict(asked.dtypes)["query_id"]
        # each part has ``n`` candidates a query, so parts are few and blocks many
        many = asked.count()
        cells = min(CELLS, -(-self.n * many // CELL_PAIRS))
        blocks = max(1, -(-many // GRID_ROWS), -(-cells // self.parts))
        rows = self.rows.withColumn("v", F.lit(None).cast("array<double>"))
        near = dealt_cells(rows, asked.withColumn("code", F.lit(None).cast("binary")), self.parts,
                           blocks).mapInArrow(_streamed(self.codebooks, n, self.n),
                                              f"query_id {id_kind}, idx long, distance double")
        best = Window.partitionBy("query_id").orderBy("distance", "idx")
        return near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= n).drop("n")

    def search(self, queries: DataFrame, k: int = 5, rerank: int = 100,
               qid_col: str = "query_id", qvec_col: str = "embedding") -> DataFrame:
        """(query_id, rank, idx, distance): the ``k`` nearest, by exact distance, of the
        ``rerank`` rows that the codes put first; ties to the lower idx. Query ids are unique."""
        if k <= 0:
            return empty_hits(queries, qid_col)
        asked = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).cast(
            "array<double>").alias("q"))
        found = self.candidates(queries, max(k, rerank), qid_col, qvec_col).drop("distance")
        exact = (found.join(self.vectors, "idx").join(asked, "query_id")
                 .select("query_id", "idx", l2_distance("q", F.col("v").cast("array<double>"))
                         .alias("distance")))
        return final_topk(exact, k)


class Coded(Block):
    """The codes of a part with their ids, ready for the ``n`` best estimates of queries."""

    def __init__(self, books: np.ndarray, codes: np.ndarray, ids: np.ndarray, n: int):
        named = np.concatenate([b[c] for b, c in zip(books.astype(np.float32), codes.T)], 1)
        super().__init__(named, ids, n, "euclidean", few_copies(codes, ids, n))
        self.books, self.codes = books, codes[self.one]

    def tables(self, Q: np.ndarray) -> np.ndarray:
        """(query, stretch, code): squared distances to all code vectors."""
        return np.stack([_squares(x, C) for x, C in zip(np.split(Q, len(self.books), axis=1),
                                                        self.books)], 1)

    def _best(self, Q: np.ndarray, qi: np.ndarray, vi: np.ndarray):
        tables, total = self.tables(Q), np.zeros(len(qi))
        for j in range(len(self.books)):
            total += tables[qi, j, self.codes[vi, j]]
        return self._kept(qi.astype(np.int64), self.ids[vi], total)


def _streamed(books: np.ndarray, n: int, rows: int):
    """Sorted (cell, asks, idx, query_id, q, code): the codes of a cell, then its queries."""
    m, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces, part = None, [], None
        for cell, asks, some in cell_runs(batches):
            if cell != number:
                number, pieces, part = cell, [], None
            if not asks:
                code = np.frombuffer(b"".join(some.column(5).to_pylist()), np.uint8)
                pieces.append((code.reshape(-1, m), np.asarray(some.column(2))))
                continue
            if part is None and pieces:
                part, pieces = Coded(books, *(np.concatenate(x) for x in zip(*pieces)), n), []
            if part is not None:
                at, ids, estimate = part.topk(matrix(some.column(4), m * width))
                if rows > n:            # no estimate is a number: no candidate is better
                    at, ids, estimate = (x[~np.isnan(estimate)] for x in (at, ids, estimate))
                yield pa.RecordBatch.from_arrays(
                    [some.column(3).take(pa.array(at)), pa.array(ids), pa.array(estimate)],
                    names=["query_id", "idx", "distance"])
    return run
