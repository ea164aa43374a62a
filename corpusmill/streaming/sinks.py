"""Sinks that a replayed batch leaves unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import METRICS_KEPT
from ..operators import metrics


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose table was written to the end."""
    files, target = _folder(spark, path)
    if not files.exists(target):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath() for s in files.listStatus(target)]
    return sorted(int(p.getName().split("=")[1]) for p in names if files.exists(done(p, "_SUCCESS")))


def merge_metrics(batch: DataFrame, epoch: int, path: str, most: int = METRICS_KEPT) -> None:
    """Writes a batch's rows under its epoch, and the tail of the last ``most`` different metrics after it.

    The tail of an epoch comes from the tail of the epoch before and the batch alone, so a batch that is written again,
    after a failure at any point, leaves what it left the first time. Rows are numbered by ``seq`` as ``metrics.dedupe``
    needs it; of metrics with one key the first stays.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
    new = spark.read.schema(batch.schema).parquet(f"{path}/rows/epoch={epoch}")
    before = [e for e in _epochs(spark, f"{path}/tail") if e < epoch]
    tail = new.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/tail/epoch={before[-1]}")) if before else new
    metrics.dedupe(tail, most).write.mode("overwrite").parquet(f"{path}/tail/epoch={epoch}")
    for old in before[:-1]:
        files, target = _folder(spark, f"{path}/tail/epoch={old}")
        files.delete(target, True)


def latest_metrics(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The tail after the last batch; empty, with the columns of ``like``, before the first."""
    done = _epochs(spark, f"{path}/tail")
    return spark.read.schema(like.schema).parquet(f"{path}/tail/epoch={done[-1]}") if done else like.limit(0)


def all_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every batch, with its epoch."""
    return spark.read.parquet(f"{path}/rows").withColumn("epoch", F.col("epoch").cast("long"))


def write_metrics(events: DataFrame, path: str, checkpoint: str, most: int = METRICS_KEPT) -> StreamingQuery:
    """Runs a stream of metrics into ``path`` until what is there was read."""
    sink = lambda batch, epoch: merge_metrics(batch, epoch, path, most)
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
