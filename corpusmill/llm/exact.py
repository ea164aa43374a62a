"""Exact deduplication by content-defined chunk recipes.

A text is cut where two neighbouring characters fall into fixed classes, so a cut depends on nearby content only.
Chunks are deduplicated once, map side first; a chunk identifier is its 64-bit digest, and where one digest turns
out to stand for two texts, the texts get numbers. Documents are then compared as ordered lists of identifiers; no
document moves whole, and a chunk moves at most once from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_tell_rows, materialize

MIN_CHUNK, MAX_CHUNK = 1024, 8192


def _letters(residue: int) -> str:
    """A quarter of the ASCII letters and digits, as a character class."""
    return "[" + "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum() and (c * 40503 >> 4) % 4 == residue) + "]"


#: The shortest stretch of at least MIN_CHUNK characters that ends in three characters of given classes; else MAX_CHUNK characters.
CHUNK = f"(?s).{{{MIN_CHUNK - 3},{MAX_CHUNK - 3}}}?{_letters(0)}{_letters(1)}{_letters(2)}|.{{1,{MAX_CHUNK}}}"
#: Runs of white space that are not a single space already.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def dedup_table(docs: DataFrame, digest=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Null text counts as empty, and all empty texts are one group; a very long text is a list of more chunks. A null
    doc_id is a group's keep_id only where all its doc_ids are null, and all its rows are kept then. Of rows that repeat a doc_id, all that carry the
    smallest doc_id of a group are kept (callers with repeated ids get them back repeated). Other columns are ignored.
    """
    texts = docs.select("doc_id", normalized(F.col("text")).alias("norm")).withColumn("chunks", chunks(F.col("norm")))
    light = materialize(
        texts.select("doc_id", F.transform("chunks", lambda c: digest(c)).alias("recipe"), F.sha2("norm", 256).alias("text_sha256")), "recipes"
    )
    # The chunk store: each text of each digest once. Only digests with two texts are of interest afterwards.
    store = texts.select(F.explode("chunks").alias("chunk")).select(digest("chunk").alias("digest"), "chunk").distinct()
    clashes = materialize(store.groupBy("digest").count().where("count > 1"), "clashes")
    key = ["recipe"]
    if not clashes.isEmpty():
        light = _verified(texts, light, store, clashes, digest)
        key = ["recipe", "variants"]
    groups = materialize(light.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return light.join(groups, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _verified(texts: DataFrame, light: DataFrame, store: DataFrame, clashes: DataFrame, digest) -> DataFrame:
    """``light`` with the numbers of clashing chunks beside the recipe; recipes without such chunks get an empty list."""
    numbered = store.join(clashes.select("digest"), "digest", "left_semi").withColumn(
        "variant", F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))
    )
    marked = texts.select("doc_id", "norm", F.posexplode("chunks").alias("pos", "chunk")).withColumn("digest", digest("chunk"))
    found = (
        marked.join(numbered, ["digest", "chunk"])
        .groupBy("doc_id", F.sha2("norm", 256).alias("text_sha256"), "pos")
        .agg(F.max("variant").alias("variant"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).cast("string").alias("variants"))
    )
    found = found.select(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_text"), "variants")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_sha256") == F.col("of_text"))
    return materialize(light.join(found, same, "left").drop("of_id", "of_text").withColumn("variants", F.coalesce("variants", F.lit(""))), "verified")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay, as ``dedup_table`` says.

    Where doc_ids are null or repeated, a row is told by doc_id and text.
    """
    kept = dedup_table(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id"))
    if not ids_tell_rows(docs):
        same &= F.sha2(normalized(F.col("text")), 256) == F.col("_kept_text")
    return docs.join(kept, same, "left_semi")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
