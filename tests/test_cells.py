"""Cells of an IVF index that is kept in shape as skewed rows are added."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, knn as K
from quarry.operators.ann import IvfIndex, local_centres, recall_at_k


def frame(spark, V, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(V)],
                                 "idx long, embedding array<double>")


def test_ten_skewed_appends_leave_no_overfull_cell(spark):
    rng = np.random.default_rng(1)
    V = rng.normal(0, 1, (400, 6))
    index = IvfIndex.build(frame(spark, V), nlist=8)
    q = frame(spark, rng.normal(0, 1, (40, 6))).withColumnRenamed("idx", "query_id")
    for n in range(10):
        more = rng.normal(0, 0.15, (80, 6)) + np.eye(6)[0] * (n % 2)     # two crowded places
        index = index.refresh(frame(spark, more, len(V))).maintain(50)
        V = np.concatenate((V, more))
        sizes = index.cell_sizes()
        assert max(sizes.values()) <= 100 and sum(sizes.values()) == len(V)
    assert index.assigned.select("idx").distinct().count() == len(V)
    # half the cells find what half the cells of an index that is trained anew find
    nprobe, exact = len(index.ids) // 2, K.knn(frame(spark, V), q, k=5)
    kept = recall_at_k(index.search(q, k=5, nprobe=nprobe), exact)
    anew = IvfIndex.build(frame(spark, V), nlist=len(index.ids))
    assert kept >= 0.9 and kept >= recall_at_k(anew.search(q, k=5, nprobe=nprobe), exact) - 0.05
    assert recall_at_k(index.search(q, k=5, nprobe=len(index.ids)), exact) == 1.0


def test_equal_vectors_stay_together_and_small_cells_dissolve(spark):
    V = np.concatenate((np.zeros((300, 3)), np.eye(3), 5 + np.random.default_rng(2).normal(
        0, 1, (60, 3))))
    centres = [[0, 0, 0], [1, 0, 0], [0, 1, 0], [5, 5, 5]]
    index = IvfIndex.build(frame(spark, V), centroids=centres)
    assert sorted(index.maintain(200).cell_sizes().values()) == [60, 303]
    sizes = index.maintain(40).cell_sizes()
    assert sum(sizes.values()) == len(V) and max(sizes.values()) == 300
    assert len(local_centres(np.zeros((9, 2)), 4)) == 1


def test_a_stored_index_is_versioned(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    path = str(tmp_path / "ivf")
    V = rng.normal(0, 1, (200, 4))
    IvfIndex.build(frame(spark, V), nlist=2).save(path)
    put = ann.put_if_absent

    def die(*_):
        raise OSError("gone")
    monkeypatch.setattr(ann, "put_if_absent", die)
    with pytest.raises(OSError):
        IvfIndex.load(spark, path).refresh(frame(spark, V[:50], 200), path=path)
    with pytest.raises(OSError):
        IvfIndex.load(spark, path).maintain(20, path=path)
    monkeypatch.setattr(ann, "put_if_absent", put)
    index = IvfIndex.load(spark, path)
    assert index.version == 1 and index.assigned.count() == 200 and index.last_idx == 199
    index = index.refresh(frame(spark, V[:50], 200), path=path).maintain(20, path=path)
    assert index.version > 2 and max(index.cell_sizes().values()) <= 40
    again = IvfIndex.load(spark, path)
    assert sorted(r[0] for r in again.assigned.select("idx").collect()) == list(range(250))
    assert again.assigned.select("cell").distinct().where(
        ~F.col("cell").isin([int(c) for c in again.ids])).count() == 0
