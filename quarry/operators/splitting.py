"""Split texts into byte-balanced parts of whole lines, and append text to a dataset.

Greedy rule per text: target = floor(bytes / n_parts); lines are added in order, each line
costing its UTF-8 bytes plus one newline; a part closes as soon as its bytes reach the target
and the counter restarts at 0. The number of parts is data-dependent (it can differ from
``n_parts``); ``n_parts`` above the size gives a target of 0, i.e. one line per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let


def text_lines(text: Column) -> Column:
    """Lines as a line reader sees them: parted by ``\\n`` or ``\\r\\n``, no trailing empty
    line after a final newline, no line at all for an empty text."""
    parts = F.split(text, "\r?\n", -1)
    return (F.when(F.length(text) == 0, F.array().cast("array<string>"))
             .when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1))
             .otherwise(parts))


def part_closings(costs: Column, target: Column) -> Column:
    """0-based indices of the lines that close a part."""
    init = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("i"),
                    F.array().cast("array<int>").alias("ends"))

    def step(s, c):
        acc = s["acc"] + c
        return F.when(acc >= target, F.struct(F.lit(0).cast("long").alias("acc"),
                                              (s["i"] + 1).alias("i"),
                                              F.array_append(s["ends"], s["i"]).alias("ends"))
                      ).otherwise(F.struct(acc.alias("acc"), (s["i"] + 1).alias("i"),
                                           s["ends"].alias("ends")))

    return F.aggregate(costs, init, step, lambda s: s["ends"])


def part_spans(text, n_parts: int) -> Column:
    """``array<struct<part:int, first_line:int, n_lines:int, n_bytes:long>>``."""
    text = F.col(text) if isinstance(text, str) else text

    def with_lines(lines):
        return let(F.transform(lines, lambda l: (F.octet_length(l) + 1).cast("long")),
                   lambda costs: with_costs(lines, costs))

    def with_costs(lines, costs):
        target = F.floor(F.octet_length(text) / F.lit(n_parts)).cast("long")
        n = F.size(lines)

        def from_ends(ends):
            # part p covers lines (ends[p-1]+1 .. ends[p]); the tail after the last end is a
            # final part when lines remain
            stops = F.when((F.size(ends) == 0) | (F.element_at(ends, -1) < n - 1),
                           F.array_append(ends, n - 1)).otherwise(ends)
            return F.transform(stops, lambda e, p: let(
                F.when(p == 0, F.lit(0)).otherwise(stops[p - 1] + 1),
                lambda first: F.struct(
                    p.alias("part"), first.alias("first_line"),
                    (e - first + 1).alias("n_lines"),
                    F.aggregate(F.slice(costs, first + 1, e - first + 1),
                                F.lit(0).cast("long"), lambda a, x: a + x).alias("n_bytes"))))

        return F.when(n == 0, F.array().cast(
            "array<struct<part:int,first_line:int,n_lines:int,n_bytes:bigint>>")).otherwise(
            let(part_closings(costs, target), from_ends))

    return let(text_lines(text), with_lines)


def split_parts(df: DataFrame, n_parts: int, id_cols=("doc_id",), text_col: str = "text"
                ) -> DataFrame:
    """(ids..., part, first_line, n_lines, n_bytes): the parts of every text."""
    ids = [F.col(c) for c in id_cols]
    return (df.select(*ids, F.explode_outer(part_spans(text_col, n_parts)).alias("p"))
              .where(F.col("p").isNotNull())
              .select(*ids, "p.part", "p.first_line", "p.n_lines", "p.n_bytes"))


def part_lines(df: DataFrame, n_parts: int, id_cols=("doc_id",), text_col: str = "text"
               ) -> DataFrame:
    """(ids..., part, line_no, line): every line with its part, ready for
    ``write.partitionBy(part).text``."""
    ids = [F.col(c) for c in id_cols]
    spans = part_spans(text_col, n_parts)
    lines = text_lines(F.col(text_col))
    rows = df.select(*ids, lines.alias("_l"), spans.alias("_s"))
    exploded = rows.select(*ids, "_l", F.explode_outer("_s").alias("p")).where(
        F.col("p").isNotNull())
    return exploded.select(
        *ids, F.col("p.part").alias("part"),
        F.explode(F.arrays_zip(
            F.sequence(F.col("p.first_line"), F.col("p.first_line") + F.col("p.n_lines") - 1)
             .alias("line_no"),
            F.slice("_l", F.col("p.first_line") + 1, F.col("p.n_lines")).alias("line")))
         .alias("z")).select(*ids, "part", "z.line_no", "z.line")


def write_parts(df: DataFrame, n_parts: int, path: str, id_cols=("doc_id",),
                text_col: str = "text") -> None:
    """Write the parts as text, one folder per part number, lines in their order within each
    text's share of a file."""
    ids = [F.col(c) for c in id_cols]
    (part_lines(df, n_parts, id_cols, text_col).repartition("part", *ids)
     .sortWithinPartitions("part", *ids, "line_no").select("part", F.col("line").alias("value"))
     .write.mode("errorifexists").partitionBy("part").text(path))


def read_parts(spark, path: str) -> DataFrame:
    """(part, line) of parts written by ``write_parts``."""
    return spark.read.schema("value string, part int").option("lineSep", "\n").text(path).select(
        "part", F.col("value").alias("line"))


def append_text(df: DataFrame, path: str, value_col: str = "value") -> None:
    """Append the text column verbatim to a text dataset (created when missing)."""
    df.select(F.col(value_col).alias("value")).write.mode("append").text(path)
