"""Paged text files: one folder per document, its pages parted by form feeds.

Pages are numbered by where they are in the files. A file may be read in several splits, so a
page's number is its place in its split, which is as large as a split and no larger, plus the
pages of the document's earlier splits, which are counted per split. No document is ever in one
task as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORM_FEED = "\f"


def write_paged(pages: DataFrame, path: str, doc_col: str = "doc", page_col: str = "page_no",
                text_col: str = "text", file_pages: int = 0) -> None:
    """Write pages in ``page_col`` order as ``<path>/doc=<doc>/``, at most ``file_pages`` pages a
    file (0: any number). A null page is written as an empty one; a form feed inside a page,
    which would end it, as a blank."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), FORM_FEED, " ")
    (pages.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("_page"),
                  text.alias("value"))
     .repartition("doc").sortWithinPartitions("doc", "_page").drop("_page")
     .write.mode("errorifexists").option("lineSep", FORM_FEED)
     .option("maxRecordsPerFile", file_pages).partitionBy("doc").text(path))


def read_paged(spark: SparkSession, path: str, doc_type: str = "string") -> DataFrame:
    """(doc, page_no, text) of a folder of paged files, pages numbered from 1 in file order."""
    rows = (spark.read.schema(f"value string, doc {doc_type}").option("lineSep", FORM_FEED)
            .text(path)
            .select("doc", F.col("value").alias("text"),
                    F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_row")))
    split = ["doc", "_file", "_block"]
    place = F.row_number().over(Window.partitionBy(*split).orderBy("_row"))
    # one row per split
    counts = rows.groupBy(*split).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("doc").orderBy("_file", "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    begun = counts.withColumn("_begun", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    numbered = rows.withColumn("_place", place).join(begun, split)
    return numbered.select("doc", (F.col("_begun") + F.col("_place")).alias("page_no"), "text")
