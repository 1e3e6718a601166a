"""Dense sequence numbers (``idx`` 1, 2, 3, ...) in an explicit order, without a one-partition
sort, plus ``next_idx``.

The batch is stored once with a unique row key. Narrow (order columns, row key, count) rows are
range-partitioned and stored once too, so the local running sums and the totals per range are
read from the same ranges whatever the optimizer does. The numbers join back on the row key
alone: repeated or null order values neither multiply nor lose rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import store

ROW = "_row"


def keyed(df: DataFrame, name: str = "batch") -> DataFrame:
    """``df`` stored with a unique row key."""
    return store(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def start_offsets(stored: DataFrame, order_cols, count_col: str, offset=0,
                  num_ranges: int | None = None) -> DataFrame:
    """(_row, _start) for a table with a row key: the sum of ``count_col`` over all rows before
    the row in ``order_cols`` order, plus ``offset`` (an int or a one-value Column). Nulls come
    first and ties go by row key, that is by arrival."""
    spark = stored.sparkSession
    order = [F.col(c).asc_nulls_first() for c in order_cols] + [F.col(ROW).asc()]
    n = num_ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = stored.select(*order_cols, ROW, F.col(count_col).cast("long").alias("_n"))
    ranged = store(narrow.repartitionByRange(n, *order).withColumn(
        "_r", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_r").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = ranged.groupBy("_r").agg(F.sum("_n").alias("_t"))
    # at most ``n`` rows: a single-partition window over them is cheap and the result has a
    # proven size bound for the broadcast.
    prior = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_r", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_base"))
    off = offset if not isinstance(offset, (int, float)) else F.lit(int(offset))
    return (local.join(F.broadcast(base), "_r")
                 .select(ROW, (F.col("_base") + F.col("_local") + off).alias("_start")))


def assign_dense_ids(df: DataFrame, order_cols, array_col: str, id_name: str = "idx",
                     offset=0, pos_name: str = "pos") -> DataFrame:
    """Explode ``array_col`` of every row into rows numbered ``offset+1 ...`` densely, in
    ``order_cols`` order then array position. Rows stay whole until after the join, so one
    huge array is one row in the shuffle, not a skewed key of many rows.

    The join builds on the narrow (row key, start) side, so the rows themselves are streamed
    and the explode keeps their parallelism.
    """
    stored = keyed(df.withColumn("_cnt", F.size(array_col)))
    starts = start_offsets(stored, list(order_cols), "_cnt", offset)
    joined = stored.join(starts.hint("shuffle_hash"), ROW).drop("_cnt", ROW)
    others = [c for c in joined.columns if c not in (array_col, "_start")]
    return (joined.select(*others, "_start",
                          F.posexplode_outer(array_col).alias("_p", "_e"))
                  .where(F.col("_p").isNotNull())
                  .select(*others,
                          (F.col("_start") + F.col("_p") + 1).alias(id_name),
                          F.col("_p").cast("int").alias(pos_name),
                          F.col("_e").alias(array_col)))


def next_idx(corpus: DataFrame, id_col: str = "idx") -> DataFrame:
    """One row ``next_idx = max(idx) + 1``; an empty corpus gives 1."""
    return corpus.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("long").alias("next_idx"))
