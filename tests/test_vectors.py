import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine_similarity, hash_embed, l2_distance
from quarry.operators import knn as knn_ops
from quarry.operators.ann import IvfIndex, recall_at_k


def _vecs(spark, rows, name="idx"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_cosine_zero_vector_is_nan(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])],
                               "a array<float>, b array<float>")
    out = [r[0] for r in df.select(cosine_similarity("a", "b")).collect()]
    assert math.isnan(out[0]) and out[1] == pytest.approx(1.0)


def test_hash_embed_empty_text_is_zero_vector(spark):
    df = spark.createDataFrame([("",), ("!!! ...",), ("Dog dog cat",)], "t string")
    rows = [r[0] for r in df.select(hash_embed("t", 16)).collect()]
    assert rows[0] == [0.0] * 16 and rows[1] == [0.0] * 16
    assert len(rows[2]) == 16 and sum(x * x for x in rows[2]) == pytest.approx(1.0, 1e-6)


def test_knn_k_larger_than_corpus_and_ties(spark):
    corpus = _vecs(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])
    q = _vecs(spark, [(10, [1.0, 0.0])], "query_id")
    rows = knn_ops.knn(corpus, q, k=5).orderBy("rank").collect()
    assert [r["idx"] for r in rows] == [1, 3, 2]  # equal distances: lower idx first
    assert [r["rank"] for r in rows] == [1, 2, 3]


def test_knn_k_zero_and_empty_corpus(spark):
    corpus = _vecs(spark, [(1, [1.0, 0.0])])
    q = _vecs(spark, [(10, [1.0, 0.0])], "query_id")
    assert knn_ops.knn(corpus, q, k=0).count() == 0
    empty = _vecs(spark, [])
    assert knn_ops.knn(empty, q, k=3).count() == 0


def test_knn_matches_native_distance_and_blocking(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    corpus = _vecs(spark, data)
    q = _vecs(spark, data[:40], "query_id")
    one = knn_ops.knn(corpus, q, k=7)
    blocked = knn_ops.knn(corpus, q, k=7, max_broadcast_bytes=2000)  # forces query blocks
    a = sorted(tuple(r) for r in one.collect())
    b = sorted(tuple(r) for r in blocked.collect())
    assert a == b and len(a) == 40 * 7
    # distances equal the native column function
    pairs = (q.withColumnRenamed("embedding", "qe").crossJoin(corpus)
             .select("query_id", "idx", l2_distance("qe", "embedding").alias("d")))
    best = {(r["query_id"], r["idx"]): r["d"] for r in pairs.collect()}
    for qid, rank, idx, dist in a:
        assert dist == pytest.approx(best[(qid, idx)], abs=1e-12)


def test_knn_rejects_mixed_lengths(spark):
    corpus = _vecs(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])])
    q = _vecs(spark, [(10, [1.0, 0.0])], "query_id")
    with pytest.raises(Exception):
        knn_ops.knn(corpus, q, k=2).collect()


def test_ivf_recall_floor(spark):
    from testdata_paths import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = knn_ops.knn(corpus, q, k=10)
    idx = IvfIndex.build(corpus, nlist=8)
    assert recall_at_k(idx.search(q, k=10, nprobe=8), exact) == pytest.approx(1.0)
    assert recall_at_k(idx.search(q, k=10, nprobe=4), exact) > 0.6


def test_ivf_refresh_assigns_new_rows(spark):
    from testdata_paths import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    first = e.where("label < 5").select(F.col("vec_id").alias("idx"), "embedding")
    second = e.where("label >= 5").select(F.col("vec_id").alias("idx"), "embedding")
    idx = IvfIndex.build(first, nlist=4).refresh(second)
    assert idx.assigned.count() == e.count()
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    hits = idx.search(q, k=5, nprobe=4)  # all cells probed: exact
    assert recall_at_k(hits, knn_ops.knn(corpus, q, k=5)) == pytest.approx(1.0)


def test_pandas_embedder_plugin(spark):
    from quarry.functions.embedders import PandasEmbedder, trigram_embedder
    df = spark.createDataFrame([("hello world",), ("",)], "t string")
    rows = [r[0] for r in df.select(trigram_embedder(16)(F.col("t"))).collect()]
    assert len(rows[0]) == 16 and sum(x * x for x in rows[0]) == pytest.approx(1.0, 1e-5)
    bad = PandasEmbedder("bad", 4, lambda: (lambda texts: np.zeros((len(texts), 3))))
    with pytest.raises(Exception):
        df.select(bad(F.col("t"))).collect()


def test_ivf_blocked_queries_equal_single_block(spark):
    from testdata_paths import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    idx = IvfIndex.build(corpus, nlist=8)
    one = sorted(tuple(r) for r in idx.search(q, k=5, nprobe=3).collect())
    many = sorted(tuple(r) for r in idx.search(q, k=5, nprobe=3, part_rows=20,
                                                block_rows=30).collect())
    assert one == many and len(one) == 500 * 5


def test_knn_cosine_metric(spark):
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(size=6) * (i % 3 + 1)).astype(np.float32).tolist())
            for i in range(120)]
    corpus = _vecs(spark, data)
    q = _vecs(spark, data[:10], "query_id")
    got = sorted(tuple(r) for r in knn_ops.knn(corpus, q, k=4, metric="cosine").collect())
    pairs = (q.withColumnRenamed("embedding", "qe").crossJoin(corpus)
             .select("query_id", "idx", (1 - cosine_similarity("qe", "embedding")).alias("d")))
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy("d", "idx")
    brute = (pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 4")
             .select("query_id", "rank", "idx", "d").collect())
    assert [(r[0], r[1], r[2]) for r in got] == sorted((r[0], r[1], r[2]) for r in brute)
    for a, b in zip(got, sorted(tuple(r) for r in brute)):
        assert a[3] == pytest.approx(b[3], abs=1e-9)


def test_ivf_training_uses_every_row(spark, monkeypatch):
    from testdata_paths import SF01
    from pyspark.ml.clustering import KMeans
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    seen = []
    fit = KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: seen.append(rows.count()) or
                        fit(self, rows))
    idx = IvfIndex.build(corpus, nlist=22)
    assert idx.centroids.shape[0] == 22 and idx.assigned.count() == 500
    IvfIndex.build(corpus, nlist=4, sample_fraction=0.5)    # only if the caller asks for it
    assert seen[0] == 500 and seen[1] < 500
    with pytest.raises(ValueError):
        IvfIndex.build(corpus)


def test_knn_strategies_agree_and_the_broadcast_bound_holds(spark):
    from testdata_paths import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    q = e.select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), "embedding")
    rows = lambda **o: sorted(tuple(r) for r in knn_ops.knn(corpus, q, k=3, **o).collect())
    assert rows() == rows(part_rows=70, block_rows=90) == rows(strategy="broadcast")
    with pytest.raises(ValueError):
        knn_ops.knn(corpus, q, k=3, strategy="broadcast", max_broadcast_bytes=10_000)


def test_ivf_save_load_refresh(spark, tmp_path):
    from testdata_paths import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    first = e.where("label < 5").select(F.col("vec_id").alias("idx"), "embedding")
    second = e.where("label >= 5").select(F.col("vec_id").alias("idx"), "embedding")
    path = str(tmp_path / "ivf")
    IvfIndex.build(first, nlist=4).save(path)
    loaded = IvfIndex.load(spark, path)
    refreshed = loaded.refresh(second, path=path)
    assert refreshed.assigned.count() == e.count()
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    hits = refreshed.search(q, k=3, nprobe=4)
    assert recall_at_k(hits, knn_ops.knn(corpus, q, k=3)) == pytest.approx(1.0)


def test_ivf_estimate_recall(spark):
    from testdata_paths import SF01
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("idx"), "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    idx = IvfIndex.build(corpus, nlist=8)
    assert idx.estimate_recall(corpus, q, k=5, nprobe=8, fraction=0.1) == pytest.approx(1.0)
    assert 0.0 < idx.estimate_recall(corpus, q, k=5, nprobe=1, fraction=0.2) <= 1.0


def test_batches_of_like_length_stay_within_the_budget_and_keep_the_order(spark):
    from quarry.functions.embedders import PandasEmbedder, length_batches, token_length
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 60, 500).tolist() + [900]
    batches = length_batches(lengths, 256)
    assert sorted(np.concatenate(batches).tolist()) == list(range(501))
    assert all(max(lengths[r] for r in b) * len(b) <= 256 or len(b) == 1 for b in batches)
    assert length_batches([], 10) == []
    texts = ["w " * int(n) for n in rng.integers(0, 40, 300)] + [None, ""]

    def load():
        def encode(batch):
            cost = max(token_length(t) for t in batch) * len(batch)
            assert cost <= 128 or len(batch) == 1
            return [[float(len(t)), float(len(batch))] for t in batch]
        return encode
    emb = PandasEmbedder("lengths", 2, load, batch_tokens=128)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["e"] for r in df.select("i", emb("t").alias("e")).collect()}
    assert [got[i][0] for i in range(len(texts))] == [len(t or "") for t in texts]
    assert max(e[1] for e in got.values()) > 1


def test_buckets_are_counted_without_a_copy_of_the_batch(spark):
    import tracemalloc

    import pyarrow as pa

    from quarry.functions.vectors import _count_buckets
    size, dim = np.arange(4000) % 601, 64
    flat = np.random.default_rng(7).integers(0, dim, size.sum()).astype(np.int32)
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).slice(1)
    count = _count_buckets(dim).func
    tracemalloc.start()
    got = count(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 and len(got) == 3999
    for n in (0, 511, 512, 3998):
        want = np.bincount(flat[ends[n + 1]:ends[n + 2]], minlength=dim).tolist()
        assert got[n].as_py() == want
    assert count(pa.array([None, [1, 1]], pa.list_(pa.int32()))).to_pylist() == [
        [0.0] * dim, [0.0, 2.0] + [0.0] * (dim - 2)]
