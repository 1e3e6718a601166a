"""Incremental ingest: new documents arriving as files become corpus chunks.

``readStream`` over the document files -> ``foreachBatch`` runs the batch ingest (chunk,
number from the corpus' ``next_idx``, embed, append). There is no event time, so no
watermark. Micro-batch ``n`` is written as corpus batch ``s<n>``: a replay after a failure
(the checkpoint re-delivers the same files for the same id) rewrites exactly that batch with
the same ids, so nothing is lost or duplicated. ``foreachBatch`` runs batches one at a time
(single writer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.corpus import Corpus
from quarry.session import scratch_path

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ingest_stream(spark: SparkSession, source_glob: str, corpus: Corpus, to_docs,
                  checkpoint: str | None = None, schema: str = DOC_SCHEMA,
                  order_cols=("doc_id",), max_files_per_trigger: int | None = None):
    """Run the stream until the available files are consumed (``availableNow``).

    ``to_docs(batch_df) -> DataFrame(order cols..., doc_name, text)`` shapes a batch.
    """
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_glob)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        corpus.append_documents(to_docs(batch), order_cols=order_cols,
                                batch=f"s{batch_id:012d}")

    q = (stream.writeStream.foreachBatch(write_batch)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
