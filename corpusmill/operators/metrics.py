"""Usage metrics and load-test summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COST_PER_MILLION, METRICS_KEPT, METRICS_LATEST

LABELS = {"hour": "HH:mm", "day": "HH:00", "week": "yyyy-MM-dd", "month": "yyyy-MM-dd"}


def within(rows: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Rows with a readable time from ``start`` on (and before ``end``)."""
    ts = F.col("ts")
    rows = rows.where(ts.isNotNull() & (ts >= F.lit(start).cast("timestamp_ntz")))
    return rows if end is None else rows.where(ts < F.lit(end).cast("timestamp_ntz"))


def summary(rows: DataFrame) -> DataFrame:
    """Calls, token sums and cost of all rows."""
    total = F.sum(F.col("prompt_tokens") + F.col("reply_tokens"))
    return rows.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("reply_tokens"), F.lit(0)).alias("reply_tokens"),
        F.coalesce(total, F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(total, F.lit(0)) / 1e6 * COST_PER_MILLION, 4).alias("cost"),
    )


def buckets(rows: DataFrame, span: str) -> DataFrame:
    """Calls and tokens by time label; labels leave the date out for short spans, as a chart shows them."""
    label = F.date_format("ts", LABELS[span])
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt_tokens") + F.col("reply_tokens")).alias("tokens"))


def dedupe(rows: DataFrame, most: int = METRICS_KEPT) -> DataFrame:
    """First row of each id, or of time, category and operation where the id is missing; the last ``most`` in order."""
    key = F.coalesce(F.col("metric_id"), F.concat_ws(":", F.col("ts").cast("string"), "category", "operation"))
    first = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("seq"))).where("_n = 1")
    return first.orderBy(F.desc("seq")).limit(most).drop("_key", "_n")


def latest(rows: DataFrame, most: int = METRICS_LATEST) -> DataFrame:
    return rows.orderBy(F.desc("seq")).limit(most)


def load_summary(rows: DataFrame) -> DataFrame:
    """Successes, failures and latencies of the successes, by tool."""
    ok = F.col("status") == "success"
    time = F.when(ok, F.col("ms"))
    return rows.groupBy("tool").agg(
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.round(F.avg(time), 6).alias("avg_ms"), F.round(F.max(time), 6).alias("max_ms")
    )


def interleave(questions: DataFrame, stage_sizes: list[int], tools: list[str]) -> DataFrame:
    """Round robin over batches, cut into stages of the given sizes, tools dealt in turn within a stage."""
    turn = F.row_number().over(Window.partitionBy("batch_id").orderBy("question_index"))
    order = F.row_number().over(Window.orderBy("turn", "batch_id"))  # as many rows as a test run has requests
    ends = [sum(stage_sizes[: i + 1]) for i in range(len(stage_sizes))]
    placed = questions.withColumn("turn", turn).withColumn("position", order).where(F.col("position") <= ends[-1])
    stage = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e < F.col("position"))) + 1
    staged = placed.withColumn("stage", stage)
    offset = F.col("position") - 1 - F.get(F.array(*(F.lit(e) for e in [0, *ends])), F.col("stage") - 1)
    return staged.withColumn("tool", F.get(F.array(*(F.lit(t) for t in tools)), F.pmod(offset, F.lit(len(tools))).cast("int"))).drop("turn")
