"""Job state kept over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.jobs import job_state


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def keep_state(events: DataFrame, job: str, write, checkpoint: str) -> StreamingQuery:
    """Hands each batch's changed jobs to write(batch, batch_id), then ends when the input is used up."""
    return job_state(events, job).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
