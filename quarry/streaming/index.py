"""An index that follows its corpus: the commit log read as a stream.

Every commit of a corpus is a file of its log, so the log is a file stream whose offsets are
commits. A micro-batch of commits brings the stored index up to the corpus: the rows above the
highest idx that the index covers. Ids are dense and a commit takes its ids at once, so nothing
is passed over whatever the order in which commits arrive; and a micro-batch that is run again
finds nothing left to add. The rows themselves never go through the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ann import IvfIndex
from quarry.plans.commit_log import ROW
from quarry.plans.corpus import Corpus
from quarry.session import scratch_path


def commit_stream(corpus: Corpus, commits_per_trigger: int | None = None) -> DataFrame:
    """The commit rows of a corpus as a streaming DataFrame."""
    reader = corpus.spark.readStream.schema(ROW)
    if commits_per_trigger:
        reader = reader.option("maxFilesPerTrigger", commits_per_trigger)
    return reader.json(f"{corpus.path}/commits")


def catch_up(corpus: Corpus, index_path: str) -> IvfIndex:
    """The stored index with all rows that the corpus has above it."""
    index = IvfIndex.load(corpus.spark, index_path)
    if corpus.next_idx() - 1 <= index.last_idx:
        return index
    rows = corpus.chunks().where(F.col("idx") > index.last_idx).select("idx", "embedding")
    return index.refresh(rows, path=index_path)


def follow(corpus: Corpus, index_path: str, checkpoint: str | None = None,
           target_rows: int | None = None, commits_per_trigger: int | None = None):
    """Bring the index at ``index_path`` up to every commit that is there (``availableNow``);
    with the same ``checkpoint``, a later call goes on from there. ``target_rows``: keep its
    cells near that size."""
    def batch(commits: DataFrame, _: int) -> None:
        index = catch_up(corpus, index_path)
        if target_rows is not None:
            index.maintain(target_rows, path=index_path)

    query = (commit_stream(corpus, commits_per_trigger).writeStream.foreachBatch(batch)
             .option("checkpointLocation", checkpoint or scratch_path(corpus.spark, "follow"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
