"""The corpus pipeline: from ``documents`` to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor
kept. All but the last return the columns of ``documents``.

1. toxicity: documents that the segment search predicts as toxic go.
2. line dedup: lines that repeat an earlier line, exactly or nearly, go; so do documents of
   which nothing but such lines is left.
3. SimHash near-dedup: one document of each group stays.
4. secret scan: secret values are replaced by a mark; all documents stay.
5. best-fit packing: one row per piece of a document, with its bin and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import lines, packing, secret_crf, simhash, toxicity
from quarry.llm.shared import Scratch, table


def _count_chars(docs: DataFrame) -> DataFrame:
    """n_chars as it is after the text has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _count_chars(lines.drop_lines(docs, **lines.WHOLE))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _count_chars(secret_crf.redact(docs, secret_crf.learn(docs)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_documents),
]

#: Trained models and similarity groups are beyond SQL; the tests hold each stage against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(docs, "_scratch_path"):
            scratch.drop(docs)
        docs = after
    return docs
