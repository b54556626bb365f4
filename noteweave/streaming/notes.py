"""The row-local part of the clinical pipeline on a stream of notes.

Extraction, overlap resolution and assertions look at one document at a time, so a
stream needs no state.  What compares documents (linking of distinct mentions, dedup,
metrics) runs on each micro-batch or stays with batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Config, entities, linked


def stream_entities(spark: SparkSession, path: str, schema: str = "doc_id long, text string", config: Config | None = None) -> DataFrame:
    """A streaming DataFrame of entities of the Parquet files that arrive in path."""
    return entities(spark.readStream.schema(schema).parquet(path), config)


def link_stream(stream: DataFrame, sink: str, checkpoint: str, config: Config | None = None, once: bool = True) -> StreamingQuery:
    """Write linked entities to a Parquet sink, micro-batch by micro-batch; a batch that is
    run again replaces its own folder, so results are exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        linked(batch, config).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
