import math

import numpy as np
import pytest

from quarry.llm import lattice as L
from quarry.llm import mtree as M


def _clusters(seed=0, n=150, dim=64, spread=0.02, copies=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        v /= np.linalg.norm(v)
        rows.append(v)
        for _ in range(i % copies):
            rows.append(v + rng.normal(size=dim) * spread * rng.uniform(0.2, 2.2))
    return [r.astype(np.float32).tolist() for r in rows]


ODD = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63,
       [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]


def test_e8_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    roots = L.e8_roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots ** 2).sum(1), 2)
    x = rng.normal(size=(300, 8)) * 3
    p = L.e8_decode(x)
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()
    near = ((x[:, None] - p[:, None] - roots) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-9).all()


@pytest.mark.parametrize("block", [4, 1024])
def test_links_are_verified_and_recall_is_high(frame, block):
    vectors = _clusters() + ODD
    vectors += [vectors[0], vectors[0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[3]), (3, vectors[3])]
    df = frame(rows, "vec_id long, embedding array<float>", clash=("cell", "node", "v"))
    got = L.near_vectors(df, block=block).collect()
    assert len(got) == len(rows)
    links = np.zeros(len(rows), int)
    unit = [None if v is None or not v or any(x is None or not math.isfinite(x) for x in v)
            or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float))
            for _, v in rows]
    for i, a in enumerate(unit):
        links[i] = sum(b is not None and i != j and a is not None and len(a) == len(b)
                       and a @ b >= 0.9 for j, b in enumerate(unit))
    want = sorted(zip([(-1 if i is None else i) for i, _ in rows], links.tolist()))
    have = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in got)
    assert [w[0] for w in want] == [h[0] for h in have]
    assert all(h[1] <= w[1] for h, w in zip(have, want))
    assert sum(h[1] for h in have) >= 0.98 * sum(w[1] for w in want)
    by_id = {r.vec_id: r for r in got}
    assert by_id[0].component_id == 0 and by_id[0].kept and by_id[0].n_links >= 2
    for i in range(len(vectors) - 2 - len(ODD), len(vectors) - 5):
        assert by_id[i].n_links == 0 and by_id[i].kept
    assert by_id[len(vectors) - 1].component_id == 0


def test_recall_on_the_threshold():
    rng = np.random.default_rng(2)
    x = L.unit_rows(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z = L.unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * z
    a, b = (L.cells(v, L.TABLES, L.PROBES, L.CELL, L.SEED) for v in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.9


def _brute_top(rows, queries, k):
    quant = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in quant:
        if q in queries:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in quant if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"part_rows": 40, "query_block": 3},
                                     {"leaf": 4, "fanout": 3}])
def test_top_k_equals_brute_force(frame, options):
    vectors = _clusters(3, 90, 16, copies=4) + [[0.5] * 16] * 30 + ODD
    rows = list(enumerate(vectors))
    queries = {i for i, _ in rows if i % 10 == 0} | {len(rows) - 3}
    df = frame(rows, "vec_id long, embedding array<float>", clash=("rank", "score", "part"))
    asked = df.filter(f"vec_id % 10 = 0 OR vec_id = {len(rows) - 3}")
    got = sorted(tuple(r) for r in M.top_k(df, asked, k=5, **options).collect())
    assert got == _brute_top(rows, queries, 5)


def test_the_tree_rules_out_most_of_clustered_data():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 8)) * 100
    x = np.repeat(centres, 100, 0) + rng.normal(size=(5000, 8))
    tree = M.MTree(x, leaf=50, fanout=8)
    for q in centres[:20]:
        best = tree.search(q, 5, lambda rows: -((x[rows] - q) ** 2).sum(1), np.arange(5000))
        want = np.argsort(((x - q) ** 2).sum(1))[:5]
        assert [r for _, _, r in best] == want.tolist()
    assert tree.distances < 0.2 * 20 * 5000


def test_empty_tables(frame):
    df = frame([], "vec_id long, embedding array<float>")
    assert L.near_vectors(df).count() == 0 and M.top_k(df, df).count() == 0
    one = frame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert M.top_k(one, one).count() == 0


@pytest.mark.parametrize("n", [5, 6])
def test_the_own_row_sets_no_limit(n):
    """Isolated groups of exactly k and k + 1 vectors of equal norm, the query among them."""
    rng = np.random.default_rng(6)
    rows = []
    for c in range(40):
        near = rng.normal(size=16) + 0.001 * rng.normal(size=(n, 16))
        rows += (1000 * near / np.linalg.norm(near, axis=1)[:, None]).tolist()
    points, k = np.array(rows), 5
    lift = np.sqrt(np.maximum((points ** 2).sum(1).max() - (points ** 2).sum(1), 0))
    tree = M.MTree(np.column_stack((points, lift)), leaf=n, fanout=16)
    order = np.arange(len(points))
    for own in range(0, len(points), 7):
        scores = np.where(order == own, -np.inf, points @ points[own])
        found = tree.search(np.append(points[own], 0.0), k, lambda r, s=scores: s[r], order)
        assert [r for _, _, r in found] == np.lexsort((order, -scores))[:k].tolist()
