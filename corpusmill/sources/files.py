"""File sources: question banks, sheets as text, metrics logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_kind(name: Column) -> Column:
    """Reader of an uploaded file, by its suffix."""
    suffix = F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1)
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("ppt", "pptx"), "pptx").when(suffix.isin("xls", "xlsx"), "excel").when(
        suffix.isin("mp4", "mkv", "mov"), "video"
    )


def questions(lines: DataFrame) -> DataFrame:
    """(path, question_index, question) from (path, line_no, line): a numbered line opens a question, others go on with it."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = r"^\s*(\d{1,3})\.\s*(.*)$"
    rows = lines.withColumn("n", F.sum(F.col("line").rlike(start).cast("int")).over(w)).where((F.col("n") > 0) & (F.trim("line") != ""))
    body = F.trim(F.when(F.col("line").rlike(start), F.regexp_extract("line", start, 2)).otherwise(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy("path", F.col("n").cast("int").alias("question_index")).agg(F.trim(joined).alias("question"))


def sheet_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of CSV files, whole, the header kept as data."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def table_text(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """CSV lines of a table: null becomes empty, values with commas, quotes or line ends are quoted."""
    quoted = []
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted.append(F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v))
    return rows.select(*key, F.concat_ws(",", *quoted).alias("line"))


def metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of metrics; lines that can't be read are left out."""
    schema = "metric_id string, ts string, category string, operation string, model_name string, duration_ms double, metadata map<string,string>, _corrupt_record string"
    return spark.read.schema(schema).json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")
