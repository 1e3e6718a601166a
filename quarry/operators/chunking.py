"""Sentences, token counts and token-bounded chunks.

All work is per document and map-side: one row per document carries its sentence array, the
token cost of every sentence and the packed chunks; ``posexplode`` turns them into rows. No
shuffle is needed, so a very long document costs one task but never a skewed exchange.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import (DEFAULT_CHUNK_TOKENS, let, pack_chunks,
                                   sentence_chunk_numbers, sentence_split, token_count)

# A sentence-array counter maps array<string> -> array<int>; the default stays native.
ArrayCounter = Callable[[Column], Column]


def default_counter(sentences: Column) -> Column:
    return F.transform(sentences, token_count)


def sentence_struct(text: Column, counter: ArrayCounter = default_counter) -> Column:
    """``struct<s: array<string>, c: array<int>>``: sentences and their token costs, each
    computed once per row."""
    return let(sentence_split(text), lambda s: F.struct(s.alias("s"), counter(s).alias("c")))


def with_sentences(df: DataFrame, text_col: str = "text",
                   counter: ArrayCounter = default_counter) -> DataFrame:
    """Adds ``_sents: array<string>`` and ``_costs: array<int>`` per row."""
    if counter is default_counter:
        return (df.withColumn("_sc", sentence_struct(F.col(text_col), counter))
                  .withColumn("_sents", F.col("_sc.s")).withColumn("_costs", F.col("_sc.c"))
                  .drop("_sc"))
    # pandas_udf counters cannot run inside a lambda: split first, count on the array.
    return (df.withColumn("_sents", sentence_split(F.col(text_col)))
              .withColumn("_costs", counter(F.col("_sents"))))


def sentences(df: DataFrame, id_cols=("doc_id",), text_col: str = "text",
              counter: ArrayCounter = default_counter) -> DataFrame:
    """(id..., sent_no, sentence, n_tokens), sentence order kept by ``sent_no`` (0-based)."""
    ids = [F.col(c) for c in id_cols]
    return (with_sentences(df.select(*ids, F.col(text_col)), text_col, counter)
            .select(*ids, F.posexplode_outer(F.arrays_zip(F.col("_sents").alias("s"),
                                                    F.col("_costs").alias("n"))))
            .where(F.col("pos").isNotNull())
            .select(*ids, F.col("pos").cast("int").alias("sent_no"),
                    F.col("col.s").alias("sentence"), F.col("col.n").alias("n_tokens")))


def token_counts(df: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                 counter: ArrayCounter = default_counter) -> DataFrame:
    """(id..., n_sentences, n_tokens) per document, computed in-row (no shuffle)."""
    ids = [F.col(c) for c in id_cols]
    return (with_sentences(df.select(*ids, F.col(text_col)), text_col, counter)
            .select(*ids, F.size("_sents").alias("n_sentences"),
                    F.aggregate("_costs", F.lit(0).cast("bigint"),
                                lambda a, x: a + x).alias("n_tokens")))


def with_chunks(df: DataFrame, text_col: str = "text", limit: int = DEFAULT_CHUNK_TOKENS,
                counter: ArrayCounter = default_counter) -> DataFrame:
    """Adds ``_chunks: array<struct<chunk, n_tokens, first_sentence, n_sentences>>``.
    """
    base = with_sentences(df, text_col, counter)
    return (base.withColumn("_chunks", pack_chunks(F.col("_sents"), F.col("_costs"), limit))
                .drop("_sents", "_costs"))


def chunkify(df: DataFrame, id_cols=("doc_id",), text_col: str = "text",
             limit: int = DEFAULT_CHUNK_TOKENS,
             counter: ArrayCounter = default_counter) -> DataFrame:
    """(id..., chunk_no, chunk, n_tokens): greedy packing of whole sentences up to ``limit``
    tokens; an over-long sentence is its own chunk; an empty text yields no chunk."""
    ids = [F.col(c) for c in id_cols]
    return (with_chunks(df.select(*ids, F.col(text_col)), text_col, limit, counter)
            .select(*ids, F.posexplode_outer("_chunks"))
            .where(F.col("pos").isNotNull())
            .select(*ids, F.col("pos").cast("int").alias("chunk_no"),
                    F.col("col.chunk").alias("chunk"), F.col("col.n_tokens").alias("n_tokens")))


def chunk_numbers(df: DataFrame, id_cols=("doc_id",), text_col: str = "text",
                  limit: int = DEFAULT_CHUNK_TOKENS,
                  counter: ArrayCounter = default_counter) -> DataFrame:
    """(id..., sent_no, chunk_no, n_tokens): the running-sum-with-reset assignment of every
    sentence to its chunk."""
    ids = [F.col(c) for c in id_cols]
    base = with_sentences(df.select(*ids, F.col(text_col)), text_col, counter)
    return (base.withColumn("_cn", sentence_chunk_numbers(F.col("_costs"), limit))
                .select(*ids, F.posexplode_outer(F.arrays_zip(F.col("_cn").alias("c"),
                                                        F.col("_costs").alias("n"))))
                .where(F.col("pos").isNotNull())
                .select(*ids, F.col("pos").cast("int").alias("sent_no"),
                        F.col("col.c").alias("chunk_no"), F.col("col.n").alias("n_tokens")))
