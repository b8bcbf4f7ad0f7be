"""Documents that arrive in a folder are put into a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``name, content`` of files as they appear."""
    return spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def ingest(stream: DataFrame, engine: Engine, base: str, checkpoint: str) -> DataStreamWriter:
    """A writer that puts each micro-batch; a batch that is replayed after a failure changes
    nothing, since putting is idempotent."""
    return stream.writeStream.foreachBatch(lambda batch, _: engine.put_documents(base, batch)).option("checkpointLocation", checkpoint)
