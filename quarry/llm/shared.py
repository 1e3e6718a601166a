"""Helpers that several operators share: stored intermediate tables, text access in Arrow
batches, and packed per-bit counters."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, with the package shipped to the executors."""
    checkpoint_dir(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column bears it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def growing(df: DataFrame) -> DataFrame:
    """``df``, one side of a join whose sides both grow with the input, so that neither is
    broadcast. Spark sizes a stored table by its compressed files, and rows that an explode makes
    by those it reads, so it may hold a table for small that does not fit in the driver."""
    return df.hint("merge")


class Scratch:
    """Intermediate tables in the folder of ``spark.checkpoint.dir``.

    ``keep(df, name)`` writes Parquet and rereads it, which cuts the lineage and survives lost
    executors; ``drop(df)`` deletes such a table once nothing lazy depends on it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship_package(spark)
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column: one flat uint8 array and n + 1 offsets;
    nulls are empty. No copy unless the column has nulls or chunks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


#: byte value -> its 8 bits, each in a byte of its own
_SPREAD = np.ascontiguousarray(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
).view(np.uint64).ravel()


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each segment ``hashes[offsets[i]:offsets[i + 1]]`` of 64-bit values, the value whose
    bits are set in over half of the segment's values (0 for an empty segment).

    Eight 8-bit counters are packed in one machine word, so runs of at most 255 values are
    added by one ``add.reduceat`` per byte lane; the runs' counts are then added up.
    """
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    lens = np.diff(offsets)
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    runs = -(-lens[full] // 255)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    within = np.arange(runs.sum()) - np.repeat(first, runs)
    starts = np.repeat(offsets[:-1][full], runs) + 255 * within
    lanes = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(full), 64), bool)
    for lane in range(8):
        words = _SPREAD[lanes[:, lane]]
        part = np.add.reduceat(words, starts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(part.astype(np.int64), first, axis=0)
        bits[:, lane * 8:lane * 8 + 8] = 2 * total > lens[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def sorted_groups(batches, keys: int):
    """Cut a stream of batches that is sorted by its first ``keys`` columns into tables of whole
    groups: yields (table, starts), where ``starts`` has the first row of each group and the
    row count at its end. A group may go over several batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        starts = group_starts(now, keys)
        if len(starts) > 1:
            cut = starts[-1]
            yield now.slice(0, cut).combine_chunks(), starts
        else:
            cut = 0
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def group_starts(rows: pa.Table, keys: int) -> np.ndarray:
    """First row of each run of equal values in the first ``keys`` (integer) columns."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for i in range(keys):
        col = rows.column(i).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (a < b) inside each group, for groups given by their bounds."""
    size = np.diff(starts)
    last = np.repeat(starts[1:], size)
    row = np.arange(starts[0], starts[-1])
    after = last - row - 1
    a = np.repeat(row, after)
    first = np.cumsum(after) - after
    return a, a + 1 + np.arange(len(a)) - np.repeat(first, after)


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) that connect exactly what the given links connect, one for each
    node but the least of every component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]
