"""A stored index that is kept by batch: changed batches are written anew, broken ones repaired, orphans removed.

Under the index's folder lie ``points``, ``postings``, ``edges`` and ``status``, each partitioned by batch_id. A batch is
written by dynamic partition overwrite, so other batches' files are never touched; its status is written last, so a
batch whose writing broke off has none and is repaired by the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, graph, upkeep
from .lineage import cut

POINTS = "batch_id string, document_id long, chunk_id string, section_title string, text string, embedding array<float>"
TABLES = {
    "points": POINTS,
    "postings": "batch_id string, term string, chunk_id string, tf long, dl long, n_chunks long, avgdl double, idf double",
    "edges": "batch_id string, src string, edge_type string, dst string, list_pos int",
    "status": "batch_id string, chunks long, terms long, edges long",
}


def _there(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the index; empty before the first batch."""
    files, target = _there(spark, f"{path}/{name}")
    if not files.exists(target):
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def _replace(rows: DataFrame, path: str, name: str) -> None:
    """Writes the partitions of the batches in ``rows``; others stay."""
    kinds = rows.sparkSession.createDataFrame([], TABLES[name]).schema
    rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in kinds))
    rows.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")


def _drop(spark: SparkSession, batches: DataFrame, path: str, *names: str) -> None:
    """Removes the partitions of ``batches``, read from the table's own folder names."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in batches.select("batch_id").distinct().toLocalIterator():
        for name in names:
            files, target = _there(spark, f"{path}/{name}/batch_id={escaped.escapePathName(row.batch_id)}")
            files.delete(target, True)


def index_of(points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with all that a score needs, edges, status) of points."""
    lexical = bm25.build(points)
    postings = lexical.postings.join(lexical.doc_len, ["batch_id", "chunk_id"]).join(lexical.stats, "batch_id").join(lexical.idf, ["batch_id", "term"])
    edges = graph.thematic_edges(points, stems=True)
    return cut(postings.drop("df")), cut(edges), points


def _write_index(points: DataFrame, path: str) -> None:
    postings, edges, _ = index_of(points)
    _replace(postings, path, "postings")
    _replace(edges, path, "edges")
    count = lambda rows, name: rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias(name))
    status = count(points, "chunks").join(count(postings, "terms"), "batch_id", "left").join(count(edges, "edges"), "batch_id", "left")
    _replace(status.fillna(0, ["terms", "edges"]), path, "status")


def ingest(documents: DataFrame, path: str) -> None:
    """Writes the batches of ``documents``, which has all documents of each batch (doc_id, text, source), anew.

    The old status goes first, the new one comes last: in between the batch counts as broken.
    """
    spark = documents.sparkSession
    points = upkeep.points(upkeep.chunked(documents))
    points = cut(points.withColumn("batch_id", F.col("batch_id").cast("string")))
    batches = documents.select(F.col("source").cast("string").alias("batch_id")).where("batch_id IS NOT NULL").distinct()
    _drop(spark, batches, path, "status")
    _replace(points, path, "points")
    gone = cut(batches.join(points.select("batch_id").distinct(), "batch_id", "left_anti"))
    _drop(spark, gone, path, "points", "postings", "edges")  # batches that have no chunk any more
    _write_index(points, path)


def delete_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Deletes (batch_id, document_id); the batches that they were in are indexed anew."""
    keys = documents.select("batch_id", "document_id").distinct()
    held = read(spark, path, "points")
    touched = held.join(keys.select("batch_id").distinct(), "batch_id", "left_semi")
    left = cut(touched.join(keys, ["batch_id", "document_id"], "left_anti"))
    batches = cut(keys.select("batch_id").distinct())
    _drop(spark, batches, path, "status")
    _replace(left, path, "points")
    _drop(spark, cut(batches.join(left.select("batch_id").distinct(), "batch_id", "left_anti")), path, "points", "postings", "edges")
    _write_index(left, path)


def judged(points: DataFrame, status: DataFrame, *others: DataFrame) -> DataFrame:
    """(batch_id, action): "ready" where status and points agree on the chunks, "repair" where they don't, "purge" without points.

    ``others`` are further tables by batch, which are to be purged as well.
    """
    held = points.groupBy("batch_id").agg(F.count(F.lit(1)).alias("held"))
    known = status.select("batch_id", "chunks")
    for rows in others:
        known = known.join(rows.select("batch_id").distinct(), "batch_id", "full_outer")
    action = F.when(F.col("held").isNull(), "purge").when(F.col("held").eqNullSafe(F.col("chunks")), "ready").otherwise("repair")
    return held.join(known, "batch_id", "full_outer").select("batch_id", action.alias("action"))


def actions(spark: SparkSession, path: str) -> DataFrame:
    """What ``judged`` says of a stored index."""
    return judged(*(read(spark, path, name) for name in ("points", "status", "postings", "edges")))


def repair(spark: SparkSession, path: str) -> DataFrame:
    """Indexes broken batches from their points, removes what batches without points left; returns what was to do."""
    found = cut(actions(spark, path))
    _drop(spark, found.where("action = 'purge'"), path, "postings", "edges", "status")
    broken = read(spark, path, "points").join(found.where("action = 'repair'").select("batch_id"), "batch_id", "left_semi")
    broken = cut(broken)
    if not broken.isEmpty():
        _write_index(broken, path)
    return found
