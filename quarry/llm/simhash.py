"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Fingerprints are exact: every word shingle of the whole text is hashed (XXH64) and each bit is
decided by majority. Links are found by a covering family of bit masks: every bit position gets
a random vector of r + 1 bits, mask v keeps the positions whose vector has an odd
inner product with v. For two fingerprints that differ in at most r positions some v is
orthogonal to all the differing positions' vectors, so they agree under that mask: no pair
within the radius is ever missed, and each of the 2^(r+1) - 1 masks keeps about half the bits.

Equal fingerprints are one row before any masking. Masked values shared by two or more distinct
fingerprints form buckets; a bucket above ``block`` rows is cut into blocks and its pairs of
blocks become separate groups. A group is compared in numpy and yields only the edges of a
spanning forest, never all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.components import connected_components
from quarry.llm.shared import Scratch, fresh, growing, majority_bits

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
BLOCK = 2048


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def text_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of every shingle of ``shingle`` words, A-Z in lower case, words parted by ASCII
    white space; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    view, h = memoryview(line), xxhash.xxh64_intdigest
    return [h(view[a:b], SEED) for a, b in zip(starts, stops)]


def _fingerprints(shingle: int, text_col: str, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            out, hashes, offsets = [], [], [0]
            for i, text in enumerate(texts):
                hashes += text_hashes(text, shingle)
                offsets.append(len(hashes))
                if len(hashes) >= 1 << 18 or i == len(texts) - 1:
                    out.append(majority_bits(np.array(hashes, np.uint64), np.array(offsets)))
                    hashes, offsets = [], [0]
            marks = _signed(np.concatenate(out)) if out else np.zeros(0, np.int64)
            names = [n for n in batch.schema.names if n != out_col]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(marks, pa.int64())],
                names=[*names, out_col])
    return run


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE_WORDS,
                 out_col: str = "fp") -> DataFrame:
    """``docs`` with the 64-bit SimHash of ``text_col`` as a long column (null or blank text: 0).
    ``text_col`` stays; a column that is already named ``out_col`` is replaced."""
    kept = docs.drop(out_col) if out_col in docs.columns else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.LongType())])
    return kept.mapInArrow(_fingerprints(shingle, text_col, out_col), schema)


def covering_masks(radius: int, bits: int = 64, seed: int = SEED) -> list[int]:
    """The 2^(radius + 1) - 1 masks of the covering family, as signed longs."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(bits)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << i for i, x in enumerate(vectors) if bin(v & x).count("1") % 2)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    return masks


def forest(near: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(root, members) of every component with two or more nodes of a boolean adjacency
    matrix; the root is the member of least index."""
    free = np.ones(len(near), bool)
    for root in range(len(near)):
        if not free[root]:
            continue
        free[root] = False
        front, members = np.array([root]), []
        while len(front):
            front = np.flatnonzero(near[front].any(0) & free)
            free[front] = False
            members.append(front)
        members = np.concatenate(members)
        if len(members):
            yield root, members


def _bucket_edges(radius: int):
    def edges(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        fps = np.unique(fps)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        return [(np.full(len(m), fps[r]), fps[m]) for r, m in forest(near)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)
        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(i)).astype(np.int64)
                                    for i in range(4)])
            rows = np.concatenate((rest, rows))
            new = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1)))
            starts = np.flatnonzero(new)
            rest = rows[starts[-1]:]          # may go on in the next batch
            yield from emit(rows[:starts[-1]], starts[:-1], starts[1:])
        if len(rest):
            yield from emit(rest, np.array([0]), np.array([len(rest)]))

    def emit(rows, starts, stops) -> Iterator[pa.RecordBatch]:
        fps = rows[:, 3].view(np.uint64) if len(rows) else np.zeros(0, np.uint64)
        fps = np.ascontiguousarray(fps)
        size = stops - starts
        two = starts[size == 2]
        a, b = fps[two], fps[two + 1]
        ok = np.bitwise_count(a ^ b) <= radius
        found = [(a[ok], b[ok])]
        for s, t in zip(starts[size > 2], stops[size > 2]):
            found += edges(fps[s:t])
        left = np.concatenate([x for x, _ in found])
        if len(left):
            right = np.concatenate([y for _, y in found])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(left)), pa.array(_signed(right))],
                                             names=["a", "b"])
    return run


def block_pairs(rows: DataFrame, size: str, item: str, block: int) -> DataFrame:
    """Cut groups of ``size`` rows into blocks of about ``block``, by the hash of ``item``, and
    deal every row to the pairs of blocks that hold it: adds ``i`` and ``j`` (i <= j). Any two
    rows of a group meet in some pair; a group that fits in one block stays whole."""
    parts = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("_parts")).cast("int")
    return (rows.withColumn("_parts", parts).withColumn("_mine", mine)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumn("i", F.least("_mine", "_other"))
            .withColumn("j", F.greatest("_mine", "_other"))
            .drop("_parts", "_mine", "_other"))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """distinct (fp long, no repeats) -> edges (a, b) between fingerprints at ``radius`` or
    fewer differing bits that connect all that are linked, directly or by others."""
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                      for k, m in enumerate(covering_masks(radius))])
    masked = (distinct.select("fp", F.explode(masks).alias("m"))
              .select("fp", F.xxhash64("m.k", "m.v").alias("bucket")))
    shared = masked.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = masked.join(growing(shared), "bucket")
    dealt = (block_pairs(rows, "size", "fp", block).select("bucket", "i", "j", "fp")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    return dealt.mapInArrow(_bucket_edges(radius), "a long, b long").distinct()


def fingerprint_groups(marked: DataFrame, scratch: Scratch, id_col: str = "doc_id",
                       radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """marked (id, fp) -> (fp, component_id): the smallest id over all fingerprints that can be
    reached by links (null only if all those ids are null)."""
    distinct = scratch.keep(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    parts = scratch.keep(
        connected_components(fingerprint_links(distinct.select("fp"), radius, block), scratch),
        "parts")
    placed = distinct.join(growing(parts), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.keep(placed.join(growing(roots), "root").select("fp", "component_id"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                    block: int = BLOCK) -> DataFrame:
    """One row per document: id, fp (long), component_id.

    Null, empty and blank texts have fingerprint 0 and link like any other; repeated rows are
    repeated in the result; a null id counts as none when the smallest id is taken. Other
    columns of ``docs`` are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(
        fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        .select("id", "fp"), "marked")
    groups = fingerprint_groups(marked, scratch, "id", radius, block)
    return marked.join(growing(groups), "fp").select(
        F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                         block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: the one of smallest id, and
    of rows that repeat that id any one. A null id comes last."""
    scratch = Scratch(docs.sparkSession, "simhash")
    columns = docs.columns
    fp, row = fresh("fp", columns), fresh("row", columns)
    stored = scratch.keep(fingerprints(docs, text_col, shingle, fp).withColumn(
        row, F.monotonically_increasing_id()), "stored")
    slim = stored.select(F.col(fp).alias("fp"), F.col(id_col).alias("id"),
                         F.col(row).alias("row"))
    groups = fingerprint_groups(slim, scratch, "fp", radius, block)
    first = F.struct(F.col("id").isNull(), "id", "row")
    kept = slim.join(growing(groups), "fp").groupBy("component_id").agg(F.min(first).alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return stored.join(growing(kept), row, "left_semi").select(*columns)
