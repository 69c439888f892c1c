"""An extension: a stream of rows into staging, one append per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..layout import DatasetID, Layout
from ..plans.staging import stage
from ..schema import DatasetSchema


def stage_stream(stream: DataFrame, id: DatasetID, schema: DatasetSchema, layout: Layout, checkpoint: str, **trigger) -> StreamingQuery:
    """Start it. The batch's number is its rows' sequence, so of a replayed batch's rows one of each key still wins."""

    def write(batch: DataFrame, number: int) -> None:
        stage(batch, id, schema, layout, sequence=number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
