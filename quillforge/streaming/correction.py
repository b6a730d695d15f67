"""Streaming correction: a stateless stream-static join whose static side is read anew in every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.correct import correct_text
from ..sources.publish import current_version, open_catalog


def correct_stream(spark: SparkSession, stream: DataFrame, catalog_path: str, sink, checkpoint: str, text_col: str = "text", id_col: str = "doc_id", **trigger):
    """Start a query that corrects each micro-batch with the version current at its start.

    `sink(df, batch_id, version)` gets the corrected rows; a version published meanwhile is picked up by the next batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = current_version(session, catalog_path)
        sink(correct_text(batch, open_catalog(session, catalog_path), text_col, id_col), batch_id, version)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
