"""Streams of vote files: an extension beyond the batch engine.

Arriving files are normalised like batch ones; late rows are admitted up to the watermark, exact
repeats within it are dropped, and totals are kept per window. State is bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows and sum per tumbling (or sliding) window and keys."""
    at = F.col(time).cast("timestamp")
    w = F.window("__t", window, slide) if slide else F.window("__t", window)
    out = stream.withColumn("__t", at).withWatermark("__t", late).groupBy(w.alias("w"), *keys)
    return out.agg(F.count(F.lit(1)).alias("linhas"), F.sum(value).alias("total")).select(F.col("w.start").alias("de"), F.col("w.end").alias("ate"), *keys, "linhas", "total")


def without_repeats(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def refresh(stream: DataFrame, target: str, checkpoint: str, partition: str = "ANO_ELEICAO") -> StreamingQuery:
    """Append each batch to the partitioned fact table; Spark's file sink makes every batch once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy(partition).outputMode("append").trigger(availableNow=True).start()
