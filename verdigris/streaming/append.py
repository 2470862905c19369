"""Vectors that arrive as files are appended to a stored table, batch by batch, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.ordinal import with_ordinal
from verdigris.operators.store import stored_vector

INPUT = "image_path string, label string, vector array<float>"


def append_stream(spark: SparkSession, source: str, target: str, checkpoint: str, distance: str = "cosine") -> StreamingQuery:
    """Reads new Parquet files of source (INPUT) and writes them to target as partition batch=<id>; a batch that is run
    again replaces its own partition. Ordinals are given when the table is read."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("vector", stored_vector("vector", distance)).withColumn("label", F.nullif("label", F.lit("")))
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(INPUT).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """record_idx, image_path, label, vector in order of arrival."""
    rows = spark.read.parquet(target)
    return with_ordinal(rows, "batch", "image_path").select("record_idx", "image_path", "label", "vector")
