"""Exact top-k by inner product with M-trees.

The inner product becomes a metric by one more coordinate: with L the greatest squared norm of
all vectors, x' = (x, sqrt(L - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + L - 2 <q, x>,
so the nearest in the metric have the highest scores.

Rows are dealt by hash to parts of about ``part_rows`` vectors; every part is one M-tree whose
pages keep the pivots, covering radii and distances to the parent's pivot. Rows move once: the
task that has a part builds its tree once and streams all queries past it. Each query runs a
best-first search in each part's tree and yields at most k rows, which one window per query
merges. Distances are computed only for entries that the stored parent distances cannot rule
out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

PART_ROWS = 16384
#: queries whose results are sent on together
QUERY_BLOCK = 2048
LEAF = 256
FANOUT = 16


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has no null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


class MTree:
    """An M-tree over the rows of ``points``; pages are plain tuples.

    Inner page: (pivots' rows, pivots, radii, parent distances, children); leaf: (rows, parent
    distances). ``distances`` counts the metric computations of searches.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.points, self.leaf, self.fanout = points, leaf, fanout
        self.distances = 0
        self.reach = float((points ** 2).sum(1).max(initial=0.0))       # greatest squared norm
        self.root = self._page(np.arange(len(points)), np.zeros(len(points)))

    def _to(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[rows] - point) ** 2).sum(1), 0))

    def _page(self, rows: np.ndarray, parent: np.ndarray):
        """A page for ``rows`` whose distances to the pivot above are ``parent``."""
        if len(rows) <= self.leaf:
            return rows, parent
        pivots, near = [rows[0]], self._to(rows, self.points[rows[0]])
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < min(self.fanout, -(-len(rows) // self.leaf)) and near.max() > 0:
            pivots.append(rows[near.argmax()])      # the farthest row is the next pivot
            d = self._to(rows, self.points[pivots[-1]])
            closer = d < near
            owner[closer], near[closer] = len(pivots) - 1, d[closer]
        groups = [np.flatnonzero(owner == k) for k in range(len(pivots))]
        if len(pivots) == 1 or max(map(len, groups)) > 0.9 * len(rows):
            order = np.argsort(near, kind="stable")  # one dense ball: cut by distance
            half = len(order) // 2
            groups = [order[:half], order[half:]]
            pivots = [rows[g[0]] for g in groups]
        pivots = np.array(pivots)
        at = [self._to(rows[g], self.points[p]) for g, p in zip(groups, pivots)]
        above = parent[[np.flatnonzero(rows == p)[0] for p in pivots]]
        return (pivots, self.points[pivots], np.array([d.max() for d in at]), above,
                [self._page(rows[g], d) for g, d in zip(groups, at)])

    def search(self, query: np.ndarray, k: int, score, order: np.ndarray) -> list[tuple]:
        """The k best rows as (score, order key, row), best first: highest score, then the
        smallest key. ``score(rows)`` gives exact scores, -inf for rows that are no candidates;
        the metric only rules rows out, with a slack well above its rounding errors."""
        slack = 1e-7 * (1 + np.sqrt(max((query ** 2).sum(), self.reach)))
        best: list[tuple] = []          # heap, the worst on top
        limit = np.inf
        queue = [(0.0, 0, np.nan, self.root)]
        tick = 0
        while queue:
            low, _, to_parent, page = heapq.heappop(queue)
            if low > limit + slack:
                break
            if len(page) == 2:
                rows, parent = page
                if to_parent == to_parent:
                    rows = rows[np.abs(parent - to_parent) <= limit + slack]
                self.distances += len(rows)
                scores = score(rows)
                free = scores != -np.inf        # others must not set the limit
                rows, scores = rows[free], scores[free]
                if len(best) == k:
                    good = scores >= best[0][0]
                    rows, scores = rows[good], scores[good]
                if len(rows) > k:
                    first = np.lexsort((order[rows], -scores))[:k]
                    rows, scores = rows[first], scores[first]
                for s, r in zip(scores.tolist(), rows.tolist()):
                    item = (s, -order[r], r)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    limit = self._to(np.array([best[0][2]]), query)[0]
                continue
            _, pivots, radii, above, children = page
            keep = np.arange(len(radii))
            if to_parent == to_parent:
                keep = keep[np.abs(above - to_parent) - radii <= limit + slack]
            d = np.sqrt(((pivots[keep] - query) ** 2).sum(1))
            self.distances += len(keep)
            for i, x in zip(keep.tolist(), d.tolist()):
                low = max(x - radii[i], 0.0)
                if low <= limit + slack:
                    tick += 1
                    heapq.heappush(queue, (low, tick, x, children[i]))
        return sorted(best, reverse=True)


def _rows(column, dim: int | None = None) -> np.ndarray:
    """Vectors of an Arrow list column as rows of ``dim`` (or the greatest) length: shorter ones
    end in zeros, of longer ones the rest is left out."""
    size = np.diff(column.offsets.to_numpy())
    dim = int(size.max(initial=0)) if dim is None else dim
    out = np.zeros((len(column), dim))
    flat, row = column.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = place < dim
    out[row[inside], place[inside]] = flat[inside]
    return out


class Part:
    """The tree of one part, its vectors and ids."""

    def __init__(self, batches: list[pa.RecordBatch], top: float, leaf: int, fanout: int):
        dim = max(int(np.diff(b.column(3).offsets.to_numpy()).max(initial=0)) for b in batches)
        self.x = np.concatenate([_rows(b.column(3), dim) for b in batches])
        self.ids = pa.concat_arrays([b.column(2) for b in batches])
        keys = self.ids.to_numpy(zero_copy_only=False).astype(float)    # nulls are NaN and last
        self.by_id = np.argsort(keys, kind="stable")
        self.order = np.empty(len(keys), np.int64)
        self.order[self.by_id] = np.arange(len(keys))
        self.sorted = keys[self.by_id]
        lift = np.sqrt(np.maximum(top - (self.x ** 2).sum(1), 0))
        self.tree = MTree(np.column_stack((self.x, lift)), leaf, fanout)

    def search(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        out = []
        for qid, query in zip(asked.column(2).to_pylist(),
                              _rows(asked.column(3), self.x.shape[1])):
            mine = self.by_id[slice(*(np.searchsorted(self.sorted, qid, side)
                                      for side in ("left", "right")))]

            def score(rows, query=query, mine=mine):
                s = self.x[rows] @ query
                if len(mine):
                    s[np.isin(rows, mine)] = -np.inf
                return s

            out += [(qid, r, int(s)) for s, _, r in self.tree.search(
                np.append(query, 0.0), k, score, self.order)]
        qid, row, s = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(qid, pa.int64()), self.ids.take(pa.array(row, pa.int64())),
             pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])


def _searched(k: int, top: float, query_block: int, leaf: int, fanout: int):
    """Sorted (part, asks, id, v): the rows of a part (asks 0), then its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1)])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(key))):
                if key[a, 0] != number:
                    number, pieces, part = key[a, 0], [], None
                some = batch.slice(a, b - a)
                if not key[a, 1]:
                    pieces.append(some)
                    continue
                if part is None and pieces:
                    part, pieces = Part(pieces, top, leaf, fanout), []
                for i in range(0, some.num_rows if part is not None else 0, query_block):
                    yield part.search(some.slice(i, query_block), k)
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = 256.0, part_rows: int = PART_ROWS,
          query_block: int = QUERY_BLOCK, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query's ``k`` highest scores.

    The score is the integer inner product of the components floor(scale * x); it is exact
    while it stays under 2^53. Ties go to the smaller id (a null id comes last). Rows that bear
    the query's id are not its candidates. Vectors that are null or hold null or non-finite
    components take no part; a shorter vector counts as if it ended in zeros. Of queries that
    repeat an id the least vector is taken; queries without id are left out. Other columns are
    not read.
    """
    scratch = Scratch(vectors.sparkSession, "mtree")
    cells = lambda df: df.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
        .alias("v"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    items = scratch.keep(cells(vectors), "vectors")
    n, top = items.agg(F.count("*"), F.max(square(F.col("v")))).first()
    asked = scratch.keep(cells(queries).filter("id IS NOT NULL").groupBy("id")
                         .agg(F.min("v").alias("v")), "queries")
    parts = max(1, -(-n // part_rows))
    dealt = items.select(F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("part"),
                         F.lit(0).alias("asks"), "id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
                        .alias("part"), F.lit(1).alias("asks"), "id", "v")
    found = (dealt.unionByName(sent).repartition("part").sortWithinPartitions("part", "asks")
             .mapInArrow(_searched(k, float(top or 0.0), query_block, leaf, fanout),
                         "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
