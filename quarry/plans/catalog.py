"""Corpus names from a listing of file names: strip the extension, strip a ``_data``
suffix, keep distinct names, leave out ``.DS_Store``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED_NAMES = (".DS_Store",)


def strip_extension(name) -> Column:
    """``a.b.c`` -> ``a.b``; a leading-dot name such as ``.DS_Store`` stays whole."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def strip_suffix(name, suffix: str = "_data") -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, f"{suffix}$", "")


def corpus_names(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """(corpus_name): distinct names (one aggregate, partial + final)."""
    names = files.select(strip_suffix(strip_extension(name_col)).alias("corpus_name"))
    return names.where(~F.col("corpus_name").isin(*IGNORED_NAMES)).distinct()


def list_corpora(spark, folder: str) -> DataFrame:
    """Corpus names found in a folder of corpus files."""
    files = (spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")))
    return corpus_names(files)
