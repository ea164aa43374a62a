"""Blocks to sections to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN, CHUNK_MIN_TOKENS, CHUNK_TOKENS, SLICE_CHARS
from ..functions.text import estimate_tokens, short_hash

INTRODUCTION = "Document Introduction"


def line_blocks(docs: DataFrame) -> DataFrame:
    """(batch_id, document_id, block_seq, page, block_type, text) from the lines of texts; a short line without an end mark heads a section."""
    rows = docs.select(F.col("source").alias("batch_id"), F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block_seq", "text"))
    heading = (F.length("text") <= 80) & ~F.col("text").rlike(r"[.!?:;,]$")
    return rows.where(F.trim("text") != "").withColumn("page", F.lit(1)).withColumn("block_type", F.when(heading, "heading").otherwise("paragraph"))


def heading_level(path: Column, text: Column, height: Column) -> Column:
    """Level of a heading: depth of its path, else the dots of its number, else its height, else 2."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    by_height = F.when(height >= 14, 1).when(height >= 12, 2).when(height.isNotNull(), 3).otherwise(2)
    return F.when(F.size(path) > 0, F.size(path)).when(number != "", F.size(F.split(number, r"\.")).cast("int")).otherwise(by_height)


def sections(blocks: DataFrame) -> DataFrame:
    """``section_index`` and ``section_title`` of each block: a heading opens a section; what stands before the first has a name of its own."""
    w = Window.partitionBy("document_id").orderBy("block_seq")
    is_heading = (F.col("block_type") == "heading").cast("int")
    count = F.sum(is_heading).over(w.rowsBetween(Window.unboundedPreceding, 0))
    head = F.first(is_heading).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    title = F.last(F.when(F.col("block_type") == "heading", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("section_index", (count - head).cast("int")).withColumn("section_title", F.coalesce(title, F.lit(INTRODUCTION)))


def pack(blocks: DataFrame, tokens: int = CHUNK_TOKENS, least: int = CHUNK_MIN_TOKENS) -> DataFrame:
    """Greedy packing of a section's blocks into chunks: after a block other than a heading, a chunk of ``tokens`` is full.

    The fold over the ordered lengths is a native ``aggregate``; its state is (chunk, characters, blocks).
    """
    full = (tokens - 1) * CHARS_PER_TOKEN + 1
    key = ["batch_id", "document_id", "section_index", "section_title"]
    per = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block_seq", "block_type", "text", "page"))).alias("blocks"))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n, k = a["n"] + F.length(x["text"]), a["k"] + 1
        done = (x["block_type"] != "heading") & (n + k - 1 >= full)
        return F.struct(
            F.when(done, a["c"] + 1).otherwise(a["c"]).alias("c"),
            F.when(done, F.lit(0)).otherwise(n).alias("n"),
            F.when(done, F.lit(0)).otherwise(k).alias("k"),
            F.concat(a["out"], F.array(a["c"])).alias("out"),
        )

    numbered = per.withColumn("at", F.aggregate("blocks", start, step, lambda a: a["out"]))
    pairs = numbered.select(*key, F.explode(F.arrays_zip("blocks", "at")).alias("p")).select(*key, "p.blocks.*", F.col("p.at").alias("chunk_index"))
    grouped = pairs.groupBy(*key, "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.count(F.lit(1)).alias("n_blocks"),
    )
    hashed = short_hash(F.col("document_id"), F.col("section_index"), F.col("chunk_index"), F.coalesce(F.array_min("pages"), F.lit(0)))
    name = F.concat(F.col("document_id").cast("string"), F.lit(":S"), F.col("section_index"), F.lit(":C"), F.col("chunk_index"), F.lit(":"), hashed)
    return grouped.withColumn("chunk_id", name).withColumn("token_estimate", estimate_tokens(F.col("text"))).withColumn("embedding_eligible", F.col("token_estimate") >= least)


def fixed_slices(docs: DataFrame, size: int = SLICE_CHARS) -> DataFrame:
    """Hard cuts of ``size`` characters; empty texts have none."""
    total = F.length("text")
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(size)))
    cut = docs.where(total > 0).select("doc_id", "text", F.posexplode(starts).alias("i", "start"))
    return cut.select(
        "doc_id",
        (F.col("i") + 1).alias("sequential_index"),
        F.substring("text", F.col("start") + 1, F.lit(size)).alias("slice"),
        (F.col("start") + size >= F.length("text")).alias("is_last_chunk"),
        F.length("text").cast("long").alias("total_chars"),
    )
