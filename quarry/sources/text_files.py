"""Whole-file text source: each file is one document; a file that cannot be read gives ''."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _uri(column) -> F.Column:
    """File URIs with one slash after the scheme, however they were written."""
    return F.regexp_replace(column, "^([a-z0-9]+):/+(?=[^/])", "$1:/")


def _located(spark: SparkSession, paths) -> list[tuple[str, str, bool]]:
    """(path, URI, whether it exists) of each path; a relative one is resolved."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        try:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            fs = hp.getFileSystem(conf)
            out.append((p, fs.makeQualified(hp).toUri().toString(), bool(fs.exists(hp))))
        except Exception:  # an unreadable location counts as missing
            out.append((p, p, False))
    return out


def read_text_docs(spark: SparkSession, paths, names=None) -> DataFrame:
    """(doc_name, path, text), one row per entry of ``paths``, a list that the caller holds (use
    ``read_text_dir`` for folders). ``names`` defaults to the paths. A file that is missing or
    cannot be read has ``text = ''``; a file that is listed twice has two rows."""
    paths = list(paths)
    names = list(names) if names is not None else paths
    located = _located(spark, paths)
    wanted = spark.createDataFrame(
        [(n, p, u) for n, (p, u, _) in zip(names, located)],
        "doc_name string, path string, _key string").withColumn("_key", _uri("_key"))
    # paths are names here, not patterns
    found = sorted({re.sub(r"([][{}*?\\])", r"\\\1", p) for p, _, ok in located if ok})
    if not found:
        return wanted.select("doc_name", "path", F.lit("").alias("text"))
    read = (spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
            .text(found, wholetext=True)
            .select(_uri(F.col("_metadata.file_path")).alias("_key"), "value")
            .groupBy("_key").agg(F.first("value").alias("value")))
    return wanted.join(read, "_key", "left").select(
        "doc_name", "path", F.coalesce("value", F.lit("")).alias("text"))


def read_listed(listed: DataFrame, root: str, name_col: str = "doc_name",
                path_col: str = "path") -> DataFrame:
    """(doc_name, path, text), one row per row of ``listed``, whose paths are relative to
    ``root``: a list of any length, joined to the files that Spark finds there. A path where no
    file is, or a null one, has ``text = ''``."""
    spark = listed.sparkSession
    base = _located(spark, [root])[0][1].rstrip("/")
    head = F.length(_uri(F.lit(base))) + 2
    files = (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", True)
             .option("ignoreMissingFiles", True).text(root, wholetext=True)
             .select(_uri(F.col("_metadata.file_path")).alias("_uri"), "value")
             .select(F.col("_uri").substr(head, F.length("_uri")).alias("_at"), "value")
             # URIs are encoded, listed paths are not
             .withColumn("_at", F.url_decode(F.regexp_replace("_at", r"\+", "%2B"))))
    return listed.select(F.col(name_col).alias("doc_name"), F.col(path_col).alias("path")).join(
        files, F.col("path") == F.col("_at"), "left").select(
        "doc_name", "path", F.coalesce("value", F.lit("")).alias("text"))


def read_text_dir(spark: SparkSession, location: str, recursive: bool = True) -> DataFrame:
    """(doc_name, path, text) for every file under a folder or glob: one file = one
    document, ``doc_name`` = file name without extension. Spark lists and splits the files
    (no driver loop over paths); use ``read_text_docs`` when an explicit list must keep
    missing files as empty documents."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    df = reader.text(location, wholetext=True)
    path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"^(.+)\.[^.]+$", "$1")
         .alias("doc_name"),
        path.alias("path"), F.col("value").alias("text"))
