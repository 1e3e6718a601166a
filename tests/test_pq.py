"""Product quantisation against its definition and exact search."""

import numpy as np
import pytest

from quarry.operators import knn as K
from quarry.operators.ann import recall_at_k
from quarry.operators.pq import PqIndex


def frame(spark, V, name="idx"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v])
                                  for i, v in enumerate(V)], f"{name} long, embedding array<double>")


def test_candidates_follow_the_codes(spark):
    rng = np.random.default_rng(1)
    V, books = rng.normal(0, 1, (130, 6)), rng.normal(0, 1, (3, 5, 2))
    Q = rng.normal(0, 1, (7, 6))
    index = PqIndex.build(frame(spark, V), books, part_rows=40)
    assert index.parts == 4
    got = sorted((r["query_id"], r["idx"], round(r["distance"], 9))
                 for r in index.candidates(frame(spark, Q, "query_id"), 12).collect())
    cut = lambda x, j: x[2 * j:2 * j + 2]
    coded = [np.concatenate([min(books[j], key=lambda c: ((cut(v, j) - c) ** 2).sum())
                             for j in range(3)]) for v in V]
    want = []
    for q, x in enumerate(Q):
        best = sorted((((x - c) ** 2).sum(), i) for i, c in enumerate(coded))[:12]
        want += [(q, i, round(d, 9)) for d, i in best]
    assert got == sorted(want)


def test_recall_with_learnt_codes_and_exact_distances(spark):
    rng = np.random.default_rng(2)
    V = rng.normal(0, 1, (900, 16))
    rows, asked = frame(spark, V), frame(spark, V[:60], "query_id")
    index, exact = PqIndex.build(rows, m=8, codes=32, part_rows=300), K.knn(rows, asked, 5)
    assert recall_at_k(index.search(asked, 5, rerank=60), exact) >= 0.9
    key = lambda r: (r["query_id"], r["rank"], r["idx"], round(r["distance"], 9))
    assert sorted(map(key, index.search(asked, 5, rerank=900).collect())) == sorted(
        map(key, exact.collect()))
    assert index.rows.selectExpr("max(octet_length(code))").first()[0] == 8


def test_edges(spark):
    V = [[0.0, 1.0], None, [float("nan"), 1.0], [2.0, 3.0]]
    index = PqIndex.build(frame(spark, V), np.zeros((1, 1, 2)))
    got = [r["idx"] for r in index.search(frame(spark, [[2.0, 3.0]], "query_id"), 5).collect()]
    assert got == [3, 0]
    none = frame(spark, V).limit(0)
    assert PqIndex.build(none, np.zeros((1, 1, 2))).search(
        frame(spark, V, "query_id"), 5).collect() == []
    assert index.search(frame(spark, V, "query_id").limit(0), 5).collect() == []
    for books in (np.zeros((1, 300, 2)), np.zeros((2, 2))):
        with pytest.raises(ValueError):
            PqIndex.build(frame(spark, V), books)
    with pytest.raises(ValueError):
        PqIndex.build(frame(spark, [[1.0, 2.0, 3.0]]), m=2)
