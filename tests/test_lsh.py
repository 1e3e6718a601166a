"""Multi-probe hashing against plain buckets and exact search."""

import numpy as np
import pytest

from quarry.operators import knn as K
from quarry.operators.ann import recall_at_k
from quarry.operators.lsh import LshIndex, Projections


def frame(spark, V, name="idx"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v])
                                  for i, v in enumerate(V)], f"{name} long, embedding array<double>")


def test_recall_on_clustered_vectors_for_a_small_share_of_the_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 16))
    V = centres[rng.integers(0, 40, 1200)] + rng.normal(0, 0.1, (1200, 16))
    rows, asked = frame(spark, V), frame(spark, V[:100], "query_id")
    index = LshIndex.build(rows, 16, tables=8, bits=6, width=2.0, part_rows=500)
    assert index.parts == 3
    recall = recall_at_k(index.search(asked, 10, probes=6), K.knn(rows, asked, 10))
    assert recall >= 0.9 and index.work(asked, 10, probes=6) < 0.3


def test_equals_the_buckets_by_hand(spark):
    rng = np.random.default_rng(2)
    V = list(rng.normal(0, 1, (150, 5))) + [np.zeros(5)] * 4
    made = Projections(5, 3, 2, 1.5)
    index = LshIndex.build(frame(spark, V), 5, tables=3, bits=2, width=1.5, part_rows=40)
    got = sorted((r["query_id"], r["rank"], r["idx"]) for r in index.search(
        frame(spark, V, "query_id"), 4, probes=3).collect())
    X = np.array(V)
    cells = np.floor(made.places(X)).astype(int)
    frac = made.places(X) - cells
    want = []
    for q in range(len(V)):
        near = set()
        for t in range(3):
            gaps = sorted((g, 2 * m + up) for m in range(2)
                          for up, g in ((0, frac[q, t, m]), (1, 1 - frac[q, t, m])))[:2]
            buckets = [tuple(cells[q, t])]
            for _, x in gaps:
                b = list(cells[q, t])
                b[x // 2] += 2 * (x % 2) - 1
                buckets.append(tuple(b))
            near |= {i for i in range(len(V)) if tuple(cells[i, t]) in buckets}
        best = sorted((np.sqrt(((X[i] - X[q]) ** 2).sum()), i) for i in near)[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)


def test_nulls_empty_tables_and_lengths(spark):
    V = [[0.0, 0.0], None, [float("nan"), 1.0]]
    rows = frame(spark, V)
    index = LshIndex.build(rows, 2, tables=4, bits=1, width=50.0)
    got = [r["idx"] for r in index.search(frame(spark, [[0.0, 0.0]], "query_id"), 5).collect()]
    assert sorted(got) == [0, 2]
    assert index.search(frame(spark, V, "query_id").limit(0), 5).collect() == []
    assert LshIndex.build(rows.limit(0), 2).search(frame(spark, V, "query_id"), 5).collect() == []
    assert index.search(frame(spark, V, "query_id"), 0).collect() == []
    with pytest.raises(Exception):
        LshIndex.build(frame(spark, [[1.0]]), 2)
