"""Lexical index and search: BM25 over (batch_id, chunk_id, text)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_EPSILON, BM25_K1, SPARSE_TOP_K
from ..functions.stem import stem_lists
from ..functions.text import STOP_WORDS, once, terms


class Bm25Index(NamedTuple):
    postings: DataFrame  # batch_id, chunk_id, term, tf
    doc_len: DataFrame  # batch_id, chunk_id, dl
    stats: DataFrame  # batch_id, n_chunks, avgdl
    idf: DataFrame  # batch_id, term, df, idf


def tokens_of(text: Column, stop_words=STOP_WORDS, stems: bool = True) -> Column:
    """The terms that are indexed: without stop words, and their stems."""
    found = terms(text, stop_words or ("",), 1 if stems else 2)
    return stem_lists(found) if stems else found


def build(chunks: DataFrame, stop_words=STOP_WORDS, stems: bool = True) -> Bm25Index:
    """Statistics of each batch; chunks without terms don't count. Each row is a chunk, so its terms are counted where it lies."""
    tokens = chunks.select("batch_id", "chunk_id", once(tokens_of(F.col("text"), stop_words, stems)).alias("terms")).where(F.size("terms") > 0)
    postings = tokens.select("batch_id", "chunk_id", F.explode("terms").alias("term")).groupBy("batch_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    doc_len = tokens.select("batch_id", "chunk_id", F.size("terms").cast("long").alias("dl"))
    stats = doc_len.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("batch_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return Bm25Index(postings, doc_len, stats, weighted(df, stats))


def weighted(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(batch_id, term, df, idf): negative weights become a share of the batch's mean."""
    raw = df.join(stats, "batch_id").withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.groupBy("batch_id").agg((BM25_EPSILON * F.avg("raw")).alias("floor"))
    return raw.join(floor, "batch_id").select("batch_id", "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def wanted(queries: DataFrame, stop_words=STOP_WORDS, stems: bool = True) -> DataFrame:
    """(query_id, batch_id, term, qtf) of the queries' texts."""
    lists = queries.select("query_id", "batch_id", once(tokens_of(F.col("text"), stop_words, stems)).alias("terms"))
    found = lists.select("query_id", "batch_id", F.explode("terms").alias("term"))
    return found.groupBy("query_id", "batch_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def saturated(tf: Column, dl: Column, avgdl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """What a term adds to the score of a chunk, before its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def best(scored: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top_k) & (F.col("score") > 0))


def write(index: Bm25Index, path: str) -> None:
    """The index as tables, postings and weights by batch and term, so that a search reads the terms it needs."""
    for name, df in index._asdict().items():
        keys = ["batch_id", "term"] if "term" in df.columns else ["batch_id"]
        df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in Bm25Index._fields))


def search(
    index: Bm25Index, queries: DataFrame, top_k: int = SPARSE_TOP_K, k1: float = BM25_K1, b: float = BM25_B, stop_words=STOP_WORDS, stems: bool = True
) -> DataFrame:
    """(query_id, batch_id, chunk_id, score, rank): the best chunks of each query's batch, positive scores only, after the cut."""
    asked = wanted(queries, stop_words, stems)
    hits = index.postings.join(asked.join(index.idf, ["batch_id", "term"]), ["batch_id", "term"])
    hits = hits.join(index.doc_len, ["batch_id", "chunk_id"]).join(index.stats, "batch_id")
    part = F.col("qtf") * F.col("idf") * saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return best(hits.groupBy("query_id", "batch_id", "chunk_id").agg(F.sum(part).alias("score")), top_k)
