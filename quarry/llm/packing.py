"""Best-fit packing of documents into bins of a fixed number of tokens.

Bins are ordered by residual room and carry bitmaps of the sources and duplicate clusters that
they hold. An item takes the tightest bin that fits and conflicts with neither bitmap: the
search starts at the successor of its length and goes on to ever roomier bins; without one a new
bin is opened. Items come longest first. Documents are dealt to shards of about ``shard_rows``
by hash, each packed on its own, so the bins of one shard are all that a task holds; only ids,
lengths, sources and clusters move, never texts.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 4096
#: bins of shard s are numbered from s * SHARD_BINS
SHARD_BINS = 1 << 32


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """items: (length, source, cluster), each length from 1 to ``capacity``; sources and clusters
    may be None, which conflicts with nothing. Returns (bin, offset) per item, in the order given.
    """
    order: list[tuple[int, int]] = []               # (residual, bin), ascending
    held: list[tuple[int, int]] = []                # per bin: source bitmap, cluster bitmap
    source_bit: dict = {}
    cluster_bit: dict = {}
    out = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect.bisect_left(order, (length, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(held)
            held.append((0, 0))
        held[b] = held[b][0] | s, held[b][1] | c
        out.append((b, capacity - room))
        if room > length:
            bisect.insort(order, (room - length, b))
    return out


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "cluster", "source", "piece"], kind="stable",
                              ascending=[False, True, True, True, True], na_position="last")
        some = pdf[pdf.length > 0]                  # the others take no room and come last
        twice = some.cluster.duplicated(keep=False) & some.cluster.notna()
        sources = some.source.where(some.source.notna(), None)
        clusters = some.cluster.astype(object).where(twice, None)   # others conflict with none
        placed = best_fit(list(zip(some.length.tolist(), sources, clusters)), capacity)
        shard = int(pdf["shard"].iloc[0])
        none = [None] * (len(pdf) - len(some))
        return pd.DataFrame({
            "id": pdf.id.to_numpy(), "piece": pdf.piece.to_numpy(),
            "length": pdf.length.to_numpy(),
            "bin": pd.array([shard * SHARD_BINS + b for b, _ in placed] + none, "Int64"),
            "offset": pd.array([o for _, o in placed] + none, "Int64")}).astype({"id": "Int64"})
    return run


def exact_cluster(text: Column) -> Column:
    """Cluster of a text: the hash of its words in lower case, parted by single blanks."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.xxhash64(words)


def token_length(text: Column) -> Column:
    """Tokens of a text: words and single signs, as the library's default counter has them."""
    count = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    return count.cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", length: Column | None = None,
         cluster: Column | None = None, capacity: int = CAPACITY,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: id, piece (from 0), start (its first token), length,
    bin, offset (its place in the bin).

    ``length`` and ``cluster`` are columns of ``docs``; by default tokens of ``text_col`` and its
    words' hash. A document above ``capacity`` tokens is cut: its first pieces fill bins of their
    own and the rest is packed. No bin holds two items of one source or one cluster; a null
    source or cluster conflicts with nothing. A document without tokens takes no room: it is
    returned as piece 0 of length 0 with null bin and offset. Repeated rows are packed each for
    itself; rows with a null id keep it. The result does not depend on the order of the input.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        (cluster if cluster is not None else exact_cluster(F.col(text_col))).alias("cluster"),
        F.coalesce(length if length is not None else token_length(F.col(text_col)),
                   F.lit(0)).cast("long").alias("n"))
    shards = max(1, -(-docs.count() // shard_rows))
    pieces = rows.withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)) - 1)))
    start = F.col("piece") * capacity
    pieces = pieces.select(
        "id", "source", "cluster", "piece",
        F.least(F.lit(capacity), F.col("n") - start).cast("long").alias("length"),
        F.pmod(F.xxhash64("id", "cluster", "n"), F.lit(shards)).alias("shard"))
    packed = pieces.groupBy("shard").applyInPandas(
        _pack_shard(capacity), "id long, piece long, length long, bin long, offset long")
    return packed.select(
        F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start"), "length", "bin", "offset")
