"""Paged documents given as a table (doc, page_no, text): fixed-size page groups, one entry
per page, and clamped page ranges. Pages are concatenated in page order with no separator; a
page whose text is missing (NULL) is skipped and the rest kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGES_PER_ENTRY = 100


def ordered_concat(order: Column, text: Column) -> Column:
    """Aggregate: texts concatenated in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"),
                                                                         text.alias("t")))),
                                    lambda x: x["t"]), "")


def page_groups(pages: DataFrame, doc_col: str = "doc", page_col: str = "page_no",
                text_col: str = "text", pages_per_entry: int = DEFAULT_PAGES_PER_ENTRY
                ) -> DataFrame:
    """(doc, entry_no, first_page, text): pages 1..N form entry 0, N+1..2N entry 1, ...

    Groups hold at most ``pages_per_entry`` pages, so one huge document is spread over many
    groups (and tasks) rather than one.
    """
    p = pages.where(F.col(text_col).isNotNull()).withColumn(
        "entry_no", F.floor((F.col(page_col) - 1) / F.lit(pages_per_entry)).cast("int"))
    return (p.groupBy(doc_col, "entry_no")
             .agg(F.min(page_col).alias("first_page"),
                  ordered_concat(F.col(page_col), F.col(text_col)).alias("text")))


def pages_each(pages: DataFrame, doc_col: str = "doc", page_col: str = "page_no",
               text_col: str = "text") -> DataFrame:
    """One entry per page (N = 1): no aggregation needed, each page once, in order."""
    return (pages.where(F.col(text_col).isNotNull())
                 .select(doc_col, (F.col(page_col) - 1).cast("int").alias("entry_no"),
                         F.col(page_col).alias("first_page"), F.col(text_col).alias("text")))


def page_range(pages: DataFrame, first: int, last: int, doc_col: str = "doc",
               page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """(doc, first_page, last_page, text): inclusive range, bounds clamped to 1..n (n = last
    page of the document); a reversed range is read in flipped order bounds."""
    n = pages.groupBy(doc_col).agg(F.max(page_col).alias("_n"))  # partial + final aggregate
    # every selected page lies in 1..max(first, last): prune the rest before the join (the
    # bound also reaches the Parquet scan), so a huge document sends only its range
    lo = F.greatest(F.lit(first), F.lit(1))
    hi = F.least(F.lit(last), F.col("_n"))
    bounds = n.select(doc_col, F.least(lo, hi).alias("first_page"),
                      F.greatest(lo, hi).alias("last_page"))
    sel = (pages.where(F.col(text_col).isNotNull() & (F.col(page_col) >= 1) &
                       (F.col(page_col) <= F.lit(max(first, last))))
                .join(bounds, doc_col)
                .where(F.col(page_col).between(F.col("first_page"), F.col("last_page"))))
    return (sel.groupBy(doc_col, "first_page", "last_page")
               .agg(ordered_concat(F.col(page_col), F.col(text_col)).alias("text")))
