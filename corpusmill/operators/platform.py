"""Relational bookkeeping: enrolments, listings, filters, upserts, change sync, artefacts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunctive(rows: DataFrame, equal: Mapping | None = None, any_of: Mapping | None = None) -> DataFrame:
    """Rows that meet all equalities and lists; without conditions all rows."""
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == value)
    for name, values in (any_of or {}).items():
        rows = rows.where(F.col(name).isin(list(values)))
    return rows


def delete_where(rows: DataFrame, equal: Mapping | None = None, any_of: Mapping | None = None) -> DataFrame:
    """What is left after deleting by a conjunctive filter, which must not be empty."""
    conditions = [F.col(k) == v for k, v in (equal or {}).items()] + [F.col(k).isin(list(v)) for k, v in (any_of or {}).items()]
    if not conditions:
        raise ValueError("an empty filter would delete everything")
    hit = conditions[0]
    for c in conditions[1:]:
        hit = hit & c
    return rows.where(~F.coalesce(hit, F.lit(False)))


def list_documents(chunks: DataFrame, limit: int) -> DataFrame:
    """One row for each document, that of its first chunk, the first ``limit`` by document."""
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_id"))
    return chunks.withColumn("_n", first).where("_n = 1").drop("_n").orderBy("document_id").limit(limit)


def enrolled(requests: DataFrame, enrolments: DataFrame) -> DataFrame:
    return requests.join(enrolments, ["username", "batch_id"], "left_semi")


def login(users: DataFrame, enrolments: DataFrame, batches: DataFrame) -> DataFrame:
    """Each user's batches, and the active one: the last used if any, else the first."""
    rows = enrolments.join(batches, "batch_id").join(users, "username")
    first = F.first("batch_id").over(Window.partitionBy("username").orderBy("batch_id"))
    return rows.select("username", "batch_id", "batch_name", F.coalesce("last_active_batch_id", first).alias("active_batch_id"))


def sync_actions(local: DataFrame, cloud: DataFrame, key: list[str], value: str) -> DataFrame:
    """INSERT, UPDATE or DELETE for each key that differs between snapshots."""
    joined = local.select(*key, F.col(value).alias("old"), F.lit(True).alias("here")).join(
        cloud.select(*key, F.col(value).alias("new"), F.lit(True).alias("there")), key, "full_outer"
    )
    action = F.when(F.col("here").isNull(), "INSERT").when(F.col("there").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    return joined.withColumn("action", action).where("action IS NOT NULL").select(*key, "action", "old", "new")


def stale(local: DataFrame, cloud: DataFrame, key: list[str]) -> DataFrame:
    return local.join(cloud, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key of both tables; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def batch_name(master: Column, course: Column, batch: Column, key: Column) -> Column:
    return F.coalesce(master, course, batch, F.concat(F.lit("Course "), key.cast("string")))


def cooldown(requests: DataFrame, seconds: int) -> DataFrame:
    """``suppressed``: whether a request came less than ``seconds`` after the one before it with the same key."""
    w = Window.partitionBy("key").orderBy("ts", "request_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return requests.withColumn("suppressed", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


def valid_cards(cards: Column, topic: Column, least: float) -> Column:
    """Cards with enough confidence, under the requested topic."""
    return F.transform(
        F.filter(cards, lambda c: c["confidence_score"] >= least),
        lambda c: F.struct(topic.alias("topic"), c["question"].alias("question"), c["confidence_score"].alias("confidence_score")),
    )


def valid_questions(questions: Column) -> Column:
    """Questions with exactly four options and an answer among A to D; null if none is left."""
    good = F.filter(questions, lambda q: (F.size(q["options"]) == 4) & q["correct_option_id"].isin("A", "B", "C", "D"))
    return F.when(F.size(good) > 0, good)


def without_topic(cards: Column, topic: Column) -> Column:
    return F.filter(cards, lambda c: ~c["topic"].eqNullSafe(topic))


def citations(reply: Column, ids: Column) -> Column:
    """Those of the given ids that the reply cites as [DOC_ID: id]."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: F.contains(reply, F.concat(F.lit("[DOC_ID: "), i, F.lit("]"))))))
