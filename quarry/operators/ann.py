"""Approximate kNN with an inverted-file (IVF) index.

Build: ``nlist`` centroids, learnt with ``pyspark.ml`` KMeans from all rows (or from the caller's
``sample_fraction``) or given; every vector gets the cell of its nearest centroid.
Search: each query is joined to its ``nprobe`` nearest cells; a cell's rows and the queries that
probe it meet in one cogrouped block product, large cells and crowds of queries cut into several.
So the work is the probed share of the full product, and it all happens in the executors; only
the centroids (nlist x dim) are sent to every task.

An index knows the highest idx that it covers: a search over a corpus that has grown since also
looks at the newer rows, exactly, so nothing is lost between refreshes. Report recall against
exact search whenever the approximate path is used.

``maintain`` keeps cells near a target size as rows are added: overfull cells are split around
local centres, small ones dissolve, and only their rows and those of neighbouring cells are
assigned anew, under new cell numbers. A stored index is versioned: rows are added in folders of
their own, and one small model file per version, put only if absent, tells which folders and
cells are in force. A writer that dies leaves the index as it was.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import knn as knn_ops
from quarry.plans.commit_log import put_if_absent
from quarry.session import remove_path, ship_package, store

MODEL = ("version long, centroids array<array<double>>, ids array<int>, last_idx long, "
         "folders array<string>")
ASSIGNED = "idx long, v array<double>, cell int"
#: rows of an overfull cell from which its new centres are learnt, and cells around a changed one
#: whose rows are assigned anew
SPLIT_SAMPLE, NEIGHBOURS = 4096, 6


def nearest_cells(centroids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of every row, nearest first, ties to the lower cell."""
    d2 = ((vectors * vectors).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :]
          - 2.0 * vectors @ centroids.T)
    return np.argsort(d2, axis=1, kind="stable")[:, :min(n, len(centroids))]


def local_centres(V: np.ndarray, n: int, rounds: int = 2) -> np.ndarray:
    """At most ``n`` centres of the rows of ``V``, of about equally many rows: cut in two across
    the direction of greatest variance, again and again, then means. Equal rows have one."""
    def halves(W: np.ndarray, parts: int) -> list[np.ndarray]:
        mean = W.mean(0)
        if parts <= 1 or not np.ptp(W, axis=0).any():
            return [mean]
        along = (W - mean) @ np.linalg.eigh(np.cov(W.T).reshape(W.shape[1], -1))[1][:, -1]
        low = along <= np.quantile(along, (parts // 2) / parts)
        if low.all():
            low = along < along.max()
        return halves(W[low], parts // 2) + halves(W[~low], parts - parts // 2)

    centres = np.array(halves(V, n))
    for _ in range(rounds):
        near = nearest_cells(centres, V, 1)[:, 0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = V[near == c].mean(0)
    return np.unique(centres, axis=0)


class IvfIndex:
    def __init__(self, centroids: np.ndarray, assigned: DataFrame, last_idx: int, ids=None,
                 version: int = 0, folders=()):
        self.centroids = np.asarray(centroids, dtype=np.float64)    # cells x dim
        # number of each centroid's cell
        self.ids = np.arange(len(self.centroids)) if ids is None else np.asarray(ids, np.int64)
        self.assigned = assigned                                    # (idx, v, cell)
        self.last_idx = last_idx
        self.version, self.folders = version, list(folders)         # of a stored index

    @staticmethod
    def assign(centroids: np.ndarray, rows: DataFrame, id_col: str = "idx",
               vec_col: str = "embedding", ids=None) -> DataFrame:
        """(idx, v, cell) for every row with a vector."""
        names = np.arange(len(centroids)) if ids is None else np.asarray(ids)

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    V = knn_ops._as_matrix(pdf.v, centroids.shape[1])
                    yield pdf.assign(cell=names[nearest_cells(centroids, V, 1)[:, 0]])
        ship_package(rows.sparkSession)
        return rows.where(F.col(vec_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("idx"),
            F.col(vec_col).cast("array<double>").alias("v")).mapInPandas(run, ASSIGNED)

    @classmethod
    def train(cls, corpus: DataFrame, nlist: int, seed: int = 42, max_iter: int = 20,
              sample_fraction: float | None = None, vec_col: str = "embedding") -> np.ndarray:
        """``nlist`` KMeans centroids of all rows, or of a seeded sample if a fraction is given."""
        rows = corpus.select(vec_col).where(F.col(vec_col).isNotNull())
        if sample_fraction is not None:
            rows = rows.sample(fraction=sample_fraction, seed=seed)
        km = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="_features",
                    predictionCol="cell", initMode="k-means||")
        model = km.fit(rows.select(array_to_vector(F.col(vec_col)).alias("_features")))
        return np.asarray(model.clusterCenters(), dtype=np.float64)

    @classmethod
    def build(cls, corpus: DataFrame, nlist: int | None = None,
              centroids: np.ndarray | None = None, id_col: str = "idx",
              vec_col: str = "embedding", path: str | None = None, **training) -> "IvfIndex":
        """Index every row, with ``centroids`` if they are given, else with ``nlist`` learnt
        ones. ``path``: where to keep the index."""
        if (nlist is None) == (centroids is None):
            raise ValueError("give either nlist or centroids")
        if centroids is None:
            centroids = cls.train(corpus, nlist, vec_col=vec_col, **training)
        centroids = np.asarray(centroids, dtype=np.float64)
        index = cls._stored(centroids, cls.assign(centroids, corpus, id_col, vec_col))
        return index.save(path) if path is not None else index

    @classmethod
    def _stored(cls, centroids: np.ndarray, assigned: DataFrame, ids=None) -> "IvfIndex":
        assigned = store(assigned, "cells")
        return cls(centroids, assigned, assigned.agg(F.max("idx")).first()[0] or 0, ids)

    def save(self, path: str) -> "IvfIndex":
        """Keep the index under ``path``, in place of one that is there."""
        spark = self.assigned.sparkSession
        folder = _add_rows(self.assigned, path)
        remove_path(spark, f"{path}/model")
        return self._put(path, [folder], 1)

    def _put(self, path: str, folders: list, version: int) -> "IvfIndex":
        """Put the model of a version, which brings ``folders`` into force, and load it."""
        spark = self.assigned.sparkSession
        put_if_absent(spark, f"{path}/model/{version:020d}.json", {
            "version": version, "centroids": self.centroids.tolist(),
            "ids": [int(x) for x in self.ids], "last_idx": int(self.last_idx),
            "folders": folders})
        return IvfIndex.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> "IvfIndex":
        """The newest version of a stored index: the cells of its model, in its folders. Both are
        partitions, so rows that a later version has replaced are not read."""
        models = spark.read.schema(MODEL).json(f"{path}/model")
        m = models.agg(F.max_by(F.struct(*models.columns), "version").alias("m")).first()["m"]
        rows = (spark.read.schema(ASSIGNED + ", folder string").parquet(f"{path}/cells")
                .where(F.col("folder").isin(m["folders"]) & F.col("cell").isin(m["ids"])))
        return cls(np.array(m["centroids"]), rows.drop("folder"), m["last_idx"], m["ids"],
                   m["version"], m["folders"])

    def refresh(self, new_rows: DataFrame, id_col: str = "idx", vec_col: str = "embedding",
                path: str | None = None) -> "IvfIndex":
        """Add rows with the same centroids; training anew is a new ``build``. ``path``: where
        this index is kept, which gets a new version with the rows."""
        added = self._stored(self.centroids, self.assign(
            self.centroids, new_rows, id_col, vec_col, self.ids), self.ids)
        last = max(self.last_idx, added.last_idx)
        both = IvfIndex(self.centroids, self.assigned.unionByName(added.assigned), last, self.ids)
        if path is None:
            return both
        return both._put(path, [*self.folders, _add_rows(added.assigned, path)],
                         self.version + 1)

    def cell_sizes(self) -> dict:
        """Rows of each cell, at most one entry per centroid."""
        return {int(c): 0 for c in self.ids} | {r["cell"]: r["count"] for r in
                                                self.assigned.groupBy("cell").count().collect()}

    def maintain(self, target_rows: int, path: str | None = None, rounds: int = 8) -> "IvfIndex":
        """Dissolve cells of under a quarter of ``target_rows`` rows, then split those of over
        twice as many until none is left or nothing changes (a cell of equal vectors stays as it
        is: a search cuts it in parts). ``path``: where this index is kept, which gets a new
        version per round."""
        index, sizes = self, self.cell_sizes()
        under = [c for c, n in sizes.items() if n < target_rows / 4][:len(sizes) - 1]
        if under:
            index = index._rebalanced(sizes, [], under, target_rows, path)
            sizes = index.cell_sizes()
        for _ in range(rounds):
            over = [c for c, n in sizes.items() if n > 2 * target_rows]
            if not over:
                break
            index = index._rebalanced(sizes, over, [], target_rows, path)
            before, sizes = sorted(sizes.values()), index.cell_sizes()
            if sorted(sizes.values()) == before:
                break
        return index

    def _rebalanced(self, sizes: dict, over: list, under: list, target: int,
                    path: str | None) -> "IvfIndex":
        rows, place = self.assigned, {int(c): n for n, c in enumerate(self.ids)}
        pick = Window.partitionBy("cell").orderBy(F.xxhash64("idx"), "idx")
        parts = F.coalesce(*[F.when(F.col("cell") == c, -(-sizes[c] // target)) for c in over],
                           F.lit(1)) if over else F.lit(1)

        def centres(pdf: pd.DataFrame) -> pd.DataFrame:
            found = local_centres(knn_ops._as_matrix(pdf.v), int(pdf.parts.iloc[0]))
            return pd.DataFrame({"c": list(found)})
        ship_package(rows.sparkSession)
        # a bounded sample of each cell decides where its new centres are, never who is in it
        sample = (rows.where(F.col("cell").isin(over)).withColumn("n", F.row_number().over(pick))
                  .where(F.col("n") <= SPLIT_SAMPLE).withColumn("parts", parts))
        new = [r["c"] for r in sample.groupBy("cell").applyInPandas(
            centres, "c array<double>").collect()] if over else []
        gone = set(over) | set(under)
        near = nearest_cells(self.centroids, self.centroids[[place[c] for c in gone]],
                             NEIGHBOURS + 1)
        around = {int(self.ids[n]) for n in near.ravel()} - gone
        kept = [c for c in map(int, self.ids) if c not in gone and c not in around]
        # changed cells get new numbers, so their earlier rows are out of force
        fresh = [*[self.centroids[place[c]] for c in sorted(around)], *new]
        first = int(self.ids.max()) + 1
        centroids = np.array([*[self.centroids[place[c]] for c in kept], *fresh])
        ids = [*kept, *range(first, first + len(fresh))]
        moved = store(self.assign(centroids, rows.where(F.col("cell").isin([*gone, *around])),
                                  "idx", "v", ids), "moved")
        stay = rows.where(F.col("cell").isin(kept))
        index = IvfIndex(centroids, stay.unionByName(moved), self.last_idx, ids)
        if path is None:
            return index
        return index._put(path, [*self.folders, _add_rows(moved, path)], self.version + 1)

    def estimate_recall(self, corpus: DataFrame, queries: DataFrame, fraction: float, k: int = 10,
                        nprobe: int = 4, seed: int = 42, qid_col: str = "query_id",
                        qvec_col: str = "embedding") -> float | None:
        """recall@k against exact search on a seeded sample of the queries; None if the sample
        is empty."""
        sample = store(queries.sample(fraction=fraction, seed=seed), "sample")
        if sample.isEmpty():
            return None
        approx = self.search(sample, k=k, nprobe=nprobe, qid_col=qid_col, qvec_col=qvec_col)
        exact = knn_ops.knn(corpus.select("idx", "embedding"), sample, k=k, qid_col=qid_col,
                            qvec_col=qvec_col)
        return recall_at_k(approx, exact)

    def hits(self, queries: DataFrame, k: int, nprobe: int, metric: str = "euclidean",
             qid_col: str = "query_id", qvec_col: str = "embedding",
             part_rows: int = knn_ops.PART_ROWS,
             block_rows: int = knn_ops.BLOCK_ROWS) -> DataFrame:
        """Partial hits (query_id, idx, distance) of the probed cells."""
        centroids, ids = self.centroids, self.ids

        def probe(batches):
            for pdf in batches:
                if len(pdf):
                    Q = knn_ops._as_matrix(pdf.q, centroids.shape[1])
                    near = ids[nearest_cells(centroids, Q, nprobe)]
                    at = np.repeat(np.arange(len(pdf)), near.shape[1])
                    yield pd.DataFrame({"query_id": pdf.query_id.to_numpy()[at],
                                        "q": pdf.q.to_numpy()[at], "cell": near.ravel()})

        asked = queries.select(F.col(qid_col).alias("query_id"),
                               F.col(qvec_col).cast("array<double>").alias("q")).where(
                                   F.col("q").isNotNull())
        schema = T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])
        probes = store(asked.mapInPandas(probe, schema), "probes")
        # one row per cell, at most nlist: how often its rows and its queries are cut
        cut = self.assigned.groupBy("cell").agg(
            F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts")).join(
            probes.groupBy("cell").agg(
                F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks")), "cell")
        cut = F.broadcast(store(cut, "cuts"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = (self.assigned.join(cut, "cell")
                .withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int"))
                .withColumn("block", every("blocks")).select("cell", "part", "block", "idx", "v"))
        right = (probes.join(cut, "cell")
                 .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
                 .withColumn("part", every("parts"))
                 .select("cell", "part", "block", "query_id", "q"))
        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            knn_ops.cell_hits(k, metric), knn_ops.hit_schema(asked, "query_id"))

    def search(self, queries: DataFrame, k: int = 5, nprobe: int = 4, metric: str = "euclidean",
               qid_col: str = "query_id", qvec_col: str = "embedding",
               newer: DataFrame | None = None, **sizes) -> DataFrame:
        """Top ``k`` of the probed cells and, exactly, of the rows of ``newer`` (idx, embedding)
        above the highest indexed idx."""
        if k <= 0:
            return knn_ops.empty_hits(queries, qid_col)
        hits = self.hits(queries, k, nprobe, metric, qid_col, qvec_col, **sizes)
        if newer is not None:
            fresh = newer.where(F.col("idx") > self.last_idx)
            hits = hits.unionByName(knn_ops.knn(
                fresh, queries, k, metric, qid_col=qid_col, qvec_col=qvec_col).drop("rank"))
        return knn_ops.final_topk(hits, k)


def _add_rows(assigned: DataFrame, path: str) -> str:
    """Write rows to a folder of their own among the index's cells; its name."""
    folder = uuid.uuid4().hex
    assigned.repartition("cell").write.partitionBy("cell").parquet(f"{path}/cells/folder={folder}")
    return folder


def recall_at_k(approx: DataFrame, exact: DataFrame) -> float:
    """Share of exact (query, idx) hits that the approximate result also returns."""
    a = approx.select("query_id", "idx")
    e = exact.select("query_id", "idx")
    row = e.join(a, ["query_id", "idx"], "left_semi").count(), e.count()
    return row[0] / row[1] if row[1] else 1.0
