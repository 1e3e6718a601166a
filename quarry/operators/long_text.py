"""Greedy cuts of texts that are larger than a task, given as rows of lines or sentences.

A text is a run of rows (doc, pos, cost). Where a piece that starts at row i ends follows from
the prefix sums alone: at the first row whose sum reaches a bound that depends on i. So every row
gets a pointer to the start after its piece, all of them by one sorted merge of sums and bounds in
key ranges. Which rows are starts then follows from the first rows of the texts by doubling: the
pointers are joined with themselves until none is left, and the marks go from the longest jumps
to the shortest. Every step is a join or a sort over rows; no text is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.numbering import ROW, keyed, start_offsets
from quarry.session import discard, store


def _placed(rows: DataFrame) -> DataFrame:
    """rows (doc, pos, cost) with ``r``, their number in (doc, pos) order from 0, and ``before``,
    the sum of all costs before."""
    stored = keyed(rows.withColumn("_one", F.lit(1)), "lines")
    order = ["doc", "pos"]
    number = start_offsets(stored, order, "_one").withColumnRenamed("_start", "r")
    sums = start_offsets(stored, order, "cost").withColumnRenamed("_start", "before")
    return store(stored.drop("_one").join(number, ROW).join(sums, ROW).drop(ROW), "placed")


def _first_at(rows: DataFrame, bound: Column, strict: bool) -> DataFrame:
    """(r, at, doc_at, last_at): for every row, the number of the first row whose sum is at least
    ``bound`` (above it, if ``strict``), with its text and whether it ends it. Nulls: none is."""
    some = rows.sparkSession
    none = F.lit(None)
    hit = F.struct("r", "doc", "last")
    sums = rows.select((F.col("before") + F.col("cost")).alias("key"), F.lit(1).alias("kind"),
                       none.cast("long").alias("asks"), hit.alias("hit"))
    asked = rows.select(bound.alias("key"), F.lit(2 if strict else 0).alias("kind"),
                        F.col("r").alias("asks"), none.cast(sums.schema["hit"].dataType)
                        .alias("hit"))
    parts = max(1, int(some.conf.get("spark.sql.shuffle.partitions")))
    dealt = store(sums.unionByName(asked).repartitionByRange(parts, "key", "kind").withColumn(
        "range", F.spark_partition_id()), "events")
    ahead = Window.partitionBy("range").orderBy(F.desc("key"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    here = F.last("hit", ignorenulls=True).over(ahead)
    # one row per range: the first sum of the ranges after it
    firsts = dealt.groupBy("range").agg(F.min_by("hit", F.when(
        F.col("hit").isNotNull(), F.col("key"))).alias("first"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("range", F.last("first", ignorenulls=True).over(later).alias("after"))
    found = (dealt.withColumn("here", here).filter(F.col("asks").isNotNull())
             .join(F.broadcast(after), "range").withColumn("at", F.coalesce("here", "after")))
    return found.select(F.col("asks").alias("r"), F.col("at.r").alias("at"),
                        F.col("at.doc").alias("doc_at"), F.col("at.last").alias("last_at"))


def _starts(rows: DataFrame, jumps: DataFrame) -> DataFrame:
    """(r): the first rows of the texts, and all that jumps (r, to) lead to from them."""
    levels = [store(jumps.filter(F.col("to").isNotNull()), "jumps")]
    while True:
        one = levels[-1]
        two = one.select(F.col("r").alias("to"), F.col("to").alias("beyond"))
        longer = store(one.join(two, "to").select("r", F.col("beyond").alias("to")), "jumps")
        if longer.isEmpty():
            break
        levels.append(longer)
    marks = store(rows.filter("pos = 0").select("r"), "marks")
    for level in reversed(levels):
        more = marks.join(level, "r").select(F.col("to").alias("r"))
        old, marks = marks, store(marks.unionByName(more), "marks")
        discard(old)
    discard(*levels, longer)
    return marks


def _pieces(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, piece, first, n_rows, cost): the piece that begins at each mark, numbered in its
    text by the place of its mark among all."""
    at = rows.select("r", "doc", "pos", "before", F.lit(1).alias("_one"))
    begun = keyed(at.join(marks, "r"), "begun")
    place = start_offsets(begun, ["r"], "_one").withColumnRenamed("_start", "n")
    begun = store(begun.drop("_one").join(place, ROW).drop(ROW), "numbered")
    first = begun.filter("pos = 0").select("doc", F.col("n").alias("n0"))
    following = begun.select((F.col("n") - 1).alias("n"), F.col("r").alias("r1"),
                             F.col("before").alias("before1"))
    end = rows.agg(F.max("r").alias("r"), F.max(F.col("before") + F.col("cost")).alias("all"))
    end = end.first()
    return (begun.join(first, "doc").join(following, "n", "left").select(
        "doc", (F.col("n") - F.col("n0")).cast("int").alias("piece"),
        F.col("pos").alias("first"),
        (F.coalesce("r1", F.lit((end["r"] or 0) + 1)) - F.col("r")).alias("n_rows"),
        (F.coalesce("before1", F.lit(end["all"] or 0)) - F.col("before")).alias("cost")))


def _closed(rows: DataFrame) -> DataFrame:
    """Rows that know whether they are the last of their text, and its whole cost."""
    texts = rows.groupBy("doc").agg(F.max("pos").alias("_last"), F.sum("cost").alias("whole"))
    return rows.join(texts, "doc").withColumn("last", F.col("pos") == F.col("_last")).drop("_last")


def split_lines(lines: DataFrame, n_parts: int) -> DataFrame:
    """lines (doc, pos, cost), pos from 0 without gaps and costs above 0 -> (doc, part,
    first_line, n_lines, n_bytes): as ``splitting.split_parts``, with a text's lines in rows. A
    part closes at the line with which its bytes reach floor(bytes of the text / n_parts); the
    bytes of the text are ``size`` where the lines have that column, else the sum of costs."""
    sized = "size" in lines.columns
    rows = lines.select("doc", F.col("pos").cast("long").alias("pos"),
                        F.col("cost").cast("long").alias("cost"),
                        *([F.col("size").cast("long").alias("size")] if sized else []))
    rows = _closed(_placed(rows))
    target = F.floor(F.col("size" if sized else "whole") / F.lit(n_parts))
    rows = store(rows, "rows")
    # a target of 0 closes every line
    bound = F.col("before") + F.greatest(target, F.lit(1))
    ends = _first_at(rows, bound, strict=False)
    to = F.when((F.col("doc_at") == F.col("doc")) & ~F.col("last_at"), F.col("at") + 1)
    jumps = rows.select("r", "doc").join(ends, "r").select("r", to.alias("to"))
    return _pieces(rows, _starts(rows, jumps)).select(
        "doc", F.col("piece").alias("part"), F.col("first").cast("int").alias("first_line"),
        F.col("n_rows").cast("int").alias("n_lines"), F.col("cost").alias("n_bytes"))


def pack_sentences(sentences: DataFrame, limit: int) -> DataFrame:
    """sentences (doc, pos, cost), pos from 0 without gaps and costs above 0 -> (doc, chunk_no,
    first_sentence, n_sentences, n_tokens): as ``chunking.chunkify``, with a text's sentences in
    rows. A chunk takes sentences while their costs stay within ``limit``, and one at least."""
    rows = store(_closed(_placed(sentences.select(
        "doc", F.col("pos").cast("long").alias("pos"), F.col("cost").cast("long").alias("cost")))),
        "rows")
    ends = _first_at(rows, F.col("before") + F.lit(limit), strict=True)
    after = F.greatest("at", F.col("r") + 1)
    same = F.col("doc_at") == F.col("doc")
    # a sentence above the limit is a chunk of its own, unless it is the last one anyway
    to = F.when(same & ((F.col("at") > F.col("r")) | ~F.col("last_at")), after)
    jumps = rows.select("r", "doc").join(ends, "r").select("r", to.alias("to"))
    return _pieces(rows, _starts(rows, jumps)).select(
        "doc", F.col("piece").alias("chunk_no"), F.col("first").cast("int").alias(
            "first_sentence"), F.col("n_rows").cast("int").alias("n_sentences"),
        F.col("cost").cast("int").alias("n_tokens"))
