"""Incremental append as a stream of files; each batch is the idempotent batch append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import append


def append_stream(spark: SparkSession, incoming: str, index_path: str, checkpoint: str, schema: str, *, once: bool = True):
    """Appends files that arrive in ``incoming``; a batch that is replayed adds nothing.

    The index bears the number of the last batch under the checkpoint's name, in the same
    commit as the batch's rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        append(batch.dropDuplicates(["chunk_id"]), index_path, mark=(checkpoint, number))

    writer = spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
