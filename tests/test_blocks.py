"""Tiled block products against plain distances, and how cells are dealt."""

import tracemalloc

import numpy as np
import pytest

from quarry.operators import knn as K
from quarry.operators.lsh import LshIndex
from quarry.operators.pq import PqIndex


def plain(Q, V, ids, k, metric):
    out = []
    for n, q in enumerate(Q):
        with np.errstate(all="ignore"):
            if metric == "cosine":
                den = np.sqrt((V * V).sum(1)) * np.sqrt((q * q).sum())
                d = np.where(den == 0, np.nan, 1 - V @ q / den)
            else:
                d = np.sqrt(((V - q) ** 2).sum(1))
        order = np.lexsort((ids, np.round(d, 9)))[:k]
        out += [(n, int(ids[i])) for i in order]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_tiles_equal_plain_distances(metric, monkeypatch):
    monkeypatch.setattr(K, "TILE_ROWS", 16)
    monkeypatch.setattr(K, "TILE_QUERIES", 7)
    monkeypatch.setattr(K, "PENDING", 50)
    rng = np.random.default_rng(3)
    V, Q = rng.normal(0, 1, (300, 6)), rng.normal(0, 1, (40, 6))
    V[20:90], V[90] = V[20], 0                      # many copies, and a zero vector
    Q[3], Q[4] = V[20], 0
    ids = rng.permutation(300)
    qi, found, _ = K.block_topk(Q, V, ids, 5, metric)
    assert list(zip(qi.tolist(), found.tolist())) == plain(Q, V, ids, 5, metric)
    V[5, 2], V[6, 1], Q[7, 0] = np.nan, np.inf, np.nan
    qi, found, dist = K.block_topk(Q, V[:8], ids[:8], 8, "euclidean")
    assert len(qi) == 40 * 8
    assert all(np.isnan(dist[qi == n][-1]) and dist[qi == n][-2] == np.inf for n in range(7))


def test_memory_does_not_grow_with_pairs():
    rng = np.random.default_rng(4)
    V = rng.normal(0, 1, (32768, 16))
    V[:3000] = V[0]                                 # ties are not compared one by one
    tracemalloc.start()
    K.block_topk(V[:512], V, np.arange(len(V)), 10, "euclidean")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def frame(spark, V, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(V)],
                                 f"{name} long, embedding array<double>")


def tasks(df):
    return df.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).filter(bool).count()


def test_few_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    V = np.random.default_rng(5).normal(0, 1, (400, 8))
    rows, asked = frame(spark, V, "idx"), frame(spark, V, "query_id")
    key = lambda r: (r["query_id"], r["rank"], r["idx"], round(r["distance"], 9))
    books = V[:16].reshape(16, 4, 2).transpose(1, 0, 2)

    def results():
        lsh, pq = LshIndex.build(rows, 8, tables=3, bits=2), PqIndex.build(rows, books)
        found = [K.knn(rows, asked, 3), lsh.search(asked, 3), pq.search(asked, 3, 20)]
        parted = [lsh.hits(asked, 3), pq.candidates(asked, 20)]
        return [sorted(map(key, x.collect())) for x in found], [tasks(parted[0])]
    one, few = results()
    for module in ("knn", "pq"):
        monkeypatch.setattr(f"quarry.operators.{module}.CELL_PAIRS", 8000)
    monkeypatch.setattr(K, "CELL_PAIRS", 8000)
    many, more = results()
    assert one == many and few == [1] and more[0] > 8


def test_copies_share_buckets(spark):
    V = np.repeat(np.random.default_rng(6).normal(0, 1, (5, 4)), 60, axis=0)
    index = LshIndex.build(frame(spark, V, "idx"), 4, tables=4, bits=2)
    got = {}
    for r in index.search(frame(spark, V[::60], "query_id"), 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["idx"]
    assert {q: [x[r] for r in sorted(x)] for q, x in got.items()} == {
        q: list(range(60 * q, 60 * q + 7)) for q in range(5)}
