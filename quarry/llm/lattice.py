"""Near-duplicate vectors by lattice hashing.

In each of ``tables`` tables a vector is projected to 8 random directions and decoded to the
nearest point of the E8 lattice; it occupies that cell and the ``probes - 1`` neighbouring
lattice cells that its projection is nearest to. Two vectors are compared if they share a cell
of some table, by cosine in double precision. A pair that shares several cells counts in the
first of them only, so direct links are counted exactly and without a list of pairs.

Equal vectors are one row with a weight. Cells of two or more vectors become groups; large
groups are cut into blocks whose pairs are groups of their own. A group yields counts per vector
and the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.mtree import usable
from quarry.llm.shared import Scratch, pairs_within, sorted_groups, spanning_edges
from quarry.llm.simhash import block_pairs

THRESHOLD = 0.9
TABLES = 6
PROBES = 6
CELL = 1.0
BLOCK = 1024
SEED = 20


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring lattice points."""
    roots = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            roots.append(v)
    roots += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8)
              if sum(x < 0 for x in s) % 2 == 0]
    return np.array(roots)


def e8_decode(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row: the nearer of the two D8 cosets' nearest points."""
    def d8(x):
        near = np.rint(x)
        off = x - near
        worst = np.abs(off).argmax(1)
        rows = np.arange(len(x))
        odd = near.sum(1) % 2 != 0
        near[rows[odd], worst[odd]] += np.where(off[rows[odd], worst[odd]] >= 0, 1.0, -1.0)
        return near
    whole, half = d8(points), d8(points - 0.5) + 0.5
    nearer = ((points - half) ** 2).sum(1) < ((points - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def cells(unit: np.ndarray, tables: int, probes: int, cell: float, seed: int) -> np.ndarray:
    """(rows, tables * probes) cell keys of unit vectors: for each table the decoded cell first,
    then its neighbours from the nearest on."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    roots = e8_roots()
    out = []
    for t in range(tables):
        y = unit @ rng.normal(size=(dim, 8)) / cell
        mix = rng.integers(1, 1 << 62, 8, dtype=np.int64) | 1
        home = e8_decode(y)
        far = -2 * (y - home) @ roots.T + (roots ** 2).sum(1)
        steps = np.argsort(far, axis=1, kind="stable")[:, :probes - 1]
        points = np.concatenate((home[:, None], home[:, None] + roots[steps]), 1)
        key = ((2 * points).astype(np.int64) * mix).sum(-1) * tables
        out.append(key - key % tables + t)      # a cell's key also names its table
    return np.concatenate(out, 1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / np.where(top > 0, top, 1)
    norm = np.sqrt((scaled ** 2).sum(1, keepdims=True))
    return scaled / np.where(norm > 0, norm, 1)


def _matrix(column: pa.ChunkedArray, kind=float) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind).reshape(len(column), -1)


def _keys(tables: int, probes: int, cell: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            dims = rows.column("v").combine_chunks().value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = rows.filter(pa.array(dims == dim)).combine_chunks()
                keys = cells(unit_rows(_matrix(part.column("v"))), tables, probes, cell, seed)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]),
                    pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(part.column("node").to_numpy()), flat],
                                                 names=["node", "cells"])
    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a)) / math.sqrt(math.fsum(b * b))


def _links(threshold: float, tables: int, small: int = 48):
    """Sorted groups (dim, cell, i, j, node, mine, weight, v, cells) -> (node, links, other): counts
    of links, and edges."""
    def near(raw, unit, a, b):
        cos = np.einsum("ij,ij->i", unit[a], unit[b])
        return verdict(raw, a, b, cos)

    def verdict(raw, a, b, cos):
        ok = cos >= threshold
        for k in np.flatnonzero(np.abs(cos - threshold) < 1e-12):   # rounding could decide
            ok[k] = exact_cosine(raw[a[k]], raw[b[k]]) >= threshold
        return a[ok], b[ok]

    def blocks(raw, unit, s, t):
        for x in range(s, t, BLOCK):
            rows = np.arange(x, min(x + BLOCK, t))
            cos = unit[rows] @ unit[s:t].T
            p, q = np.nonzero(cos >= threshold - 1e-12)
            later = q + s > rows[p]
            yield verdict(raw, rows[p[later]], q[later] + s, cos[p[later], q[later]])

    def first_shared(cell, keys, a, b):
        """Whether ``cell`` is the first, by table and key, of the cells that a and b share."""
        table = np.mod(cell[a], tables)
        per = keys.shape[1] // tables
        own = np.ones(len(a), bool)
        for t in range(tables):
            ka, kb = keys[a][:, t * per:(t + 1) * per], keys[b][:, t * per:(t + 1) * per]
            same = ka[:, :, None] == kb[:, None, :]
            own &= ~((t < table) & same.any((1, 2)))
            least = np.where(same.any(2), ka, np.iinfo(np.int64).max).min(1)
            own &= (t != table) | (least == cell[a])
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in sorted_groups(batches, 4):
            dims = rows.column("dim").to_numpy()[starts[:-1]]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(dims)) + 1, [len(dims)]))
            for x, y in zip(cuts[:-1], cuts[1:]):       # vectors of one length at a time
                part = rows.slice(starts[x], starts[y] - starts[x])
                yield from of_one_length(part.combine_chunks(), starts[x:y + 1] - starts[x])

    def of_one_length(rows, starts) -> Iterator[pa.RecordBatch]:
        col = {n: rows.column(n).to_numpy() for n in ("cell", "i", "j", "node", "mine",
                                                      "weight")}
        raw = _matrix(rows.column("v"))
        keys = _matrix(rows.column("cells"), np.int64)
        unit = unit_rows(raw)
        size = np.diff(starts)
        few = size <= small
        found = []
        for s, t in _runs(starts, few):
            a, b = pairs_within(starts[s:t + 1])
            for x in range(0, len(a), 1 << 18):
                found.append(near(raw, unit, a[x:x + (1 << 18)], b[x:x + (1 << 18)]))
        for g in np.flatnonzero(~few):
            found += blocks(raw, unit, starts[g], starts[g + 1])
        counts, ea, eb = np.zeros(len(raw), np.int64), [], []
        for a, b in found:
            for x in range(0, len(a), 1 << 18):
                p, q = a[x:x + (1 << 18)], b[x:x + (1 << 18)]
                ok = (col["i"][p] == col["j"][p]) | (col["mine"][p] != col["mine"][q])
                p, q = p[ok], q[ok]
                own = first_shared(col["cell"], keys, p, q)
                p, q = p[own], q[own]
                np.add.at(counts, p, col["weight"][q])
                np.add.at(counts, q, col["weight"][p])
                if len(p):
                    x1, x2 = spanning_edges(col["node"][p], col["node"][q])
                    ea.append(x1)
                    eb.append(x2)
        hit = np.flatnonzero(counts)
        if len(hit):
            a, b = spanning_edges(np.concatenate(ea), np.concatenate(eb))
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((col["node"][hit], a))),
                pa.concat_arrays([pa.array(counts[hit]), none(len(a))]),
                pa.concat_arrays([none(len(hit)), pa.array(b)])],
                names=["node", "links", "other"])

    def _runs(starts, few):
        """Runs of neighbouring small groups, as (first group, group after the last)."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], few.astype(int), [0]))))
        return list(zip(edge[::2], edge[1::2]))
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES,
                 cell: float = CELL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per vector: id, n_links (other rows at a cosine of ``threshold`` or more that the
    hash found), component_id (smallest id reachable by links), kept (whether that is its own).

    Every reported link is verified, so none is below the threshold; what the hash misses is
    its recall, measured in the tests. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors of unlike length do not link. Repeated
    rows link with each other. A null id counts as none when the smallest is taken; a row whose
    component has no id at all is kept. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "lattice")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    distinct = scratch.keep(
        rows.filter(fit).groupBy("v")
        .agg(F.min("id").alias("least"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()), "distinct")
    keyed = scratch.keep(distinct.select("node", "v").mapInArrow(
        _keys(tables, probes, cell, seed), "node long, cells array<long>"), "cells")
    placed = keyed.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = block_pairs(placed.join(shared, "cell"), "size", "node", block)
    parts = F.ceil(F.col("size") / F.lit(block))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    groups = (dealt.withColumn("mine", mine).drop("size")
              .join(distinct.select("node", "weight", "v"), "node").join(keyed, "node")
              .select(F.size("v").alias("dim"), "cell", "i", "j", "node", "mine", "weight", "v",
                      "cells")
              .repartition("dim", "cell", "i", "j")
              .sortWithinPartitions("dim", "cell", "i", "j"))
    found = scratch.keep(groups.mapInArrow(_links(threshold, tables),
                                           "node long, links long, other long"), "found")
    degree = found.filter("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    parted = connected_components(
        found.filter("other IS NOT NULL").select(F.col("node").alias("a"),
                                                 F.col("other").alias("b")), scratch)
    told = (distinct.join(parted, "node", "left").join(degree, "node", "left")
            .withColumn("root", F.coalesce("component", "node")))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = scratch.keep(told.join(least, "root").select(
        "v", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "told")
    linked = rows.filter(fit).join(told, "v").select("id", "n_links", "component_id")
    alone = rows.filter(~fit | fit.isNull()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
