"""Exact kNN by pivot cells against plain distances of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn as K
from quarry.operators.pivots import PivotIndex


def tables(spark, X, Q):
    rows = spark.createDataFrame([(i, None if v is None else [float(x) for x in v])
                                  for i, v in enumerate(X)], "idx long, embedding array<double>")
    asked = spark.createDataFrame([(i, None if v is None else [float(x) for x in v])
                                   for i, v in enumerate(Q)],
                                  "query_id long, embedding array<double>")
    return rows, asked


def truth(X, Q, k):
    out = []
    for i, q in enumerate(Q):
        if q is None:
            continue
        d = [(np.sqrt(((np.asarray(v) - np.asarray(q)) ** 2).sum()), j)
             for j, v in enumerate(X) if v is not None]
        d = sorted(d, key=lambda x: (np.isnan(x[0]), x[0] if x[0] == x[0] else 0, x[1]))[:k]
        out += [(i, r + 1, j, round(x, 9) if x == x else "nan") for r, (x, j) in enumerate(d)]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["idx"],
                   round(r["distance"], 9) if r["distance"] == r["distance"] else "nan")
                  for r in df.collect())


def clustered(rng, n, centres, spread=0.05):
    return centres[rng.integers(0, len(centres), n)] + rng.normal(0, spread, (n, centres.shape[1]))


@pytest.mark.parametrize("n_pivots,part_rows,block_rows", [(1, 10_000, 10_000), (12, 16, 5),
                                                           (12, 10_000, 3), (300, 7, 1000)])
def test_equals_all_pairs(spark, n_pivots, part_rows, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    X = list(clustered(rng, 240, centres)) + [np.zeros(8)] * 20      # equal rows: ties by idx
    Q = list(clustered(rng, 60, centres)) + [np.zeros(8), rng.normal(0, 9, 8)]
    rows, asked = tables(spark, X, Q)
    index = PivotIndex.build(rows, n_pivots, part_rows=part_rows)
    assert found(index.search(asked, 5, block_rows=block_rows)) == truth(X, Q, 5)


def test_null_vectors_nan_and_few_rows(spark):
    X = [[0.0, 0.0], None, [3.0, 4.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    Q = [[0.0, 0.0], None, [3.0, 4.0]]
    rows, asked = tables(spark, X, Q)
    got = found(PivotIndex.build(rows, 4).search(asked, 10))
    # infinite rows come after finite ones, NaN last
    assert [r[2] for r in got if r[0] == 0] == [0, 2, 4, 3]
    assert [r[2] for r in got if r[0] == 2] == [2, 0, 4, 3]
    assert {r[0] for r in got} == {0, 2}


def test_empty_tables_and_no_neighbours(spark):
    rows, asked = tables(spark, [[1.0, 2.0]], [[1.0, 2.0]])
    none = rows.limit(0)
    assert PivotIndex.build(none, 3).search(asked, 3).collect() == []
    assert PivotIndex.build(rows, 3).search(asked.limit(0), 3).collect() == []
    assert PivotIndex.build(rows, 3).search(asked, 0).collect() == []
    odd, _ = tables(spark, [[float("nan"), 0.0]], [])
    assert len(PivotIndex.build(odd, 3).search(asked, 3).collect()) == 1


def test_the_strategy_of_knn_agrees_with_the_grid(spark):
    from testdata_paths import SF001
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("idx"), "embedding")
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding")
    assert found(K.knn(rows, asked, 7, strategy="pivot")) == found(K.knn(rows, asked, 7))
    with pytest.raises(ValueError):
        K.knn(rows, asked, 7, metric="cosine", strategy="pivot")


def test_bounds_exclude_far_cells_and_rows_stay(spark):
    rng = np.random.default_rng(5)
    centres = 10 * rng.normal(0, 1, (16, 8))
    X = list(clustered(rng, 800, centres))
    rows, asked = tables(spark, X, X[:200])
    index = PivotIndex.build(rows, 16)
    work = index.work(asked, 5)
    assert work["pairs"] < 0.25 and work["row_copies"] <= 1.0
    assert found(index.search(asked, 5)) == truth(X, X[:200], 5)
    # a search whose queries go everywhere copies no row either
    assert PivotIndex.build(rows, 1).work(asked, 5)["row_copies"] == 1.0


def test_queries_are_copied_per_unit_where_bounds_exclude_little(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(0, 1, (3000, 32))                 # random: nearly every cell is open
    rows, asked = tables(spark, X, X[:40])
    index = PivotIndex.build(rows, 64)
    work = index.work(asked, 5)
    assert len(index.cells) > 40 and work["pairs"] > 0.5 and work["query_copies"] < 6
    assert found(index.search(asked, 5)) == truth(X, X[:40], 5)


def test_probes_come_in_small_batches():
    from quarry.operators import pivots as P
    rng = np.random.default_rng(7)
    pivots = rng.normal(0, 1, (500, 4))
    cells = P.Cells(pivots, {c: (1000, 0.0, 9.0, 1) for c in range(500)}, 10_000)
    n = 5000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(list(rng.normal(0, 1, (n, 4)))),
         pa.array(np.full(n, np.nan)), pa.array(np.zeros(n), pa.int32()),
         pa.array(np.zeros(n), pa.int32())], names=["query_id", "q", "tau", "unit", "cell"])
    sizes = [b.num_rows for b in P._other_probes(cells)(iter([batch]))]
    assert sum(sizes) == n * cells.units and max(sizes) <= P.SENT * cells.units
    assert 500 * 1000 / 10_000 <= cells.units < 120


def test_bundles_hold_every_cell_once():
    from quarry.operators.pivots import bundles
    rng = np.random.default_rng(8)
    size = {c: int(n) for c, n in enumerate(rng.integers(1, 90, 60))} | {-1: 7, 60: 400}
    held = bundles(rng.normal(0, 1, (61, 3)), size, 100)
    assert sorted(c for some in held for c in some) == sorted(size)
    assert [-1] in held and [60] in held
    assert all(len(some) == 1 or sum(size[c] for c in some) <= 100 for some in held)
    assert bundles(np.zeros((0, 0)), {}, 100) == []


def test_a_bound_leaves_out_only_what_is_beyond_it():
    rng = np.random.default_rng(9)
    X = np.concatenate((rng.normal(0, 1, (500, 6)), np.zeros((3, 6)), 1e6 * np.ones((1, 6))))
    Q = np.concatenate((X[:60], np.zeros((2, 6)), 1e3 * rng.normal(0, 1, (20, 6))))
    block = K.Block(X, np.arange(len(X)), 7, "euclidean")
    pairs = np.indices((len(Q), len(X))).reshape(2, -1)
    every = K.exact_distances(Q, X, *pairs, "euclidean").reshape(len(Q), len(X))
    for bound in (np.sort(every, axis=1)[:, 6], np.sort(every, axis=1)[:, 2], np.full(82, np.nan),
                  np.zeros(82), np.full(82, np.inf)):
        q, i, d = block.topk(Q, bound)
        ok = ~(d > bound[q])
        got = [list(zip(i[ok & (q == x)], d[ok & (q == x)])) for x in range(len(Q))]
        for x, row in enumerate(every):
            best = sorted(zip(row, range(len(X))))[:7]
            assert [(j, e) for e, j in best if not e > bound[x]] == [
                (j, row[j]) for j, _ in got[x]]
