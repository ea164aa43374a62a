"""Structured Streaming forms: rolling metrics, de-duplicated requests, file-drop ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking


def rolling_metrics(events: DataFrame, span: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and values by window and type; a window closes when events are ``late`` beyond it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", span), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "calls", "total"
    )


def single_flight(requests: DataFrame, late: str) -> DataFrame:
    """The first request of each key within the watermark; the user is part of the key."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "username"])


def ingest_files(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Documents dropped as Parquet into ``source`` become chunks under ``sink``, each batch once."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def chunk(batch: DataFrame, epoch: int) -> None:
        chunks = chunking.pack(chunking.sections(chunking.line_blocks(batch)))
        chunks.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/epoch={epoch:08d}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
