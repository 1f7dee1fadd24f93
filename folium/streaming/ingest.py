"""Streaming ingest of sections (an extension): new files in a folder are upserted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folium.operators.store import ParquetStore
from folium.schemas import SECTIONS


def section_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SECTIONS).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def ingest(stream: DataFrame, store: ParquetStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one upsert; a batch that is run again changes nothing, as keys decide."""

    def upsert(batch: DataFrame, _: int) -> None:
        store.upsert(batch)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
