"""URL filtering by hashed expressions, with DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions, but only into those whose
label count and path length occur among the rules; expressions meet the rules in an equi-join
on the first bytes of their SHA-256, the full digest confirms, and the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: hex digits of the digest that the join key has (4 bytes)
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty for null and where ``://`` is missing."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty as for ``url_host``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _expressions(hosts: list[int], paths: list[int]) -> Column:
    labels, path = _labels(F.col("host")), F.col("path")
    each = [F.when((F.size(labels) >= n) & (F.length(path) >= m),
                   F.struct(F.array_join(F.slice(labels, -n, n), ".").alias("host"),
                            F.left(path, F.lit(m)).alias("path")))
            for n in hosts for m in paths]
    return F.explode(F.array_compact(F.array(*each)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` (columns that are named like the new ones are
    replaced) with host, path, rule and verdict.

    rules: host, path, verdict (``allow`` or ``block``). A rule fits a URL whose host is the
    rule's or a subdomain of it and whose path starts with the rule's path. The longest rule
    (host and path together, then the longer host) wins; where the same rule is given with both
    verdicts, ``block`` does. Rules with a null or empty host or a null path are left out. A URL
    that no rule fits, a null one and one without ``://`` get ``default`` and a null rule.

    The result depends on (host, path) alone, so each distinct pair is expanded once, and the
    pages join back on the pair. Only the distinct label counts and path lengths of the rules
    reach the driver (both bounded by the longest possible URL).
    """
    rules = (rules.select("host", "path", "verdict").filter("host != '' AND path IS NOT NULL")
             .groupBy("host", "path")
             .agg(F.max(F.col("verdict") == "block").alias("blocks")))
    hosts = sorted(r[0] for r in rules.select(F.size(_labels(F.col("host")))).distinct()
                   .toLocalIterator())
    paths = sorted(r[0] for r in rules.select(F.length("path")).distinct().toLocalIterator())
    table = rules.select(
        F.left(_digest(F.col("host"), F.col("path")), F.lit(PREFIX_DIGITS)).alias("prefix"),
        _digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"),
        F.struct((F.length("host") + F.length("path")).alias("n"),
                 F.length("host").alias("h")).alias("rank"),
        F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))

    new = ("host", "path", "rule", "verdict")
    parted = pages.drop(*[c for c in new if c in pages.columns and c != url_col]).select(
        "*", url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"))
    if url_col in new:
        parted = parted.drop(url_col)
    distinct = (parted.filter("_host != ''").select(F.col("_host").alias("host"),
                                                    F.col("_path").alias("path")).distinct())
    expanded = distinct.select("host", "path", _expressions(hosts or [1], paths or [0]).alias("e"))
    hashed = expanded.select("host", "path", _digest(F.col("e.host"), F.col("e.path")).alias("d"))
    hits = (hashed.withColumn("p", F.left("d", F.lit(PREFIX_DIGITS)))
            .join(table, (F.col("p") == F.col("prefix")) & (F.col("d") == F.col("digest"))))
    best = (hits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p"))
            .agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("best")))
    return (parted.join(best, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")),
                        "left")
            .select(*[c for c in parted.columns if c not in ("_host", "_path")],
                    F.col("_host").alias("host"), F.col("_path").alias("path"),
                    F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))
