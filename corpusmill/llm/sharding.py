"""Sharding by sampled splitters: ranges of a key, cut by size-weighted samples, overfull ranges cut again.

The key is the 64-bit hash of the text, so equal texts, a group, lie together. A record is sampled with a probability
in proportion to its size; quantiles of the samples are the splitters. In ranges that turn out overfull, groups with
more bytes than a range should have are taken out: they get room in the shards first, the largest first, whole if a
shard has room. What is left of a range is cut by the key into parts. Sums of parts, then sums within each part, give
every group its place in the whole order; the shard whose free room holds the group's middle takes it whole. Shards
so differ by less than one range in bytes, and only groups that no shard has room for are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS, RANGES, SAMPLES = 16, 1024, 100_000
PART_ROWS = 500_000  # records of a part, about
GROUP = ["key", "text_crc32", "size"]


def splitters(rows: DataFrame, total: int, ranges: int = RANGES, samples: int = SAMPLES, seed: int = 7) -> list[int]:
    """At most ``ranges`` - 1 keys: quantiles of about ``samples`` keys, drawn by hash with probability ~ size."""
    draw = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    taken = rows.where(draw < F.col("size") * F.lit(samples / max(1, total)))
    share = [i / ranges for i in range(1, ranges)]
    found = taken.select(F.percentile_approx("key", share, 100_000)).first()[0] if share else None
    return sorted(set(found or []))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are not above the key: first among every 32nd one, then among the next 31."""
    longs = lambda x: F.array(*(F.lit(c) for c in x)).cast("array<long>")
    if not cuts:
        return F.lit(0)
    below = lambda x: F.size(F.filter(x, lambda c: c <= key))
    coarse = below(longs(cuts[::32]))
    lists = F.array(*(longs(x) for x in ([], *(cuts[i + 1 : i + 32] for i in range(0, len(cuts), 32)))))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 32 + 1 + below(F.get(lists, coarse)))


def room(groups: list[tuple[int, int, int]], total: int, shards: int) -> tuple[list[tuple[int, int, int, int]], list[int], list[float]]:
    """([(group, first record, records, shard)], records by shard, free bytes by shard) for (group, records, size of a record).

    The largest group goes first, whole into the shard with most room; a group that no shard has room for is split.
    """
    free, held, out = [total / shards] * shards, [0] * shards, []
    for group, n, size in sorted(groups, key=lambda g: (-g[1] * g[2], g[0])):
        done = 0
        while done < n:
            k = max(range(shards), key=lambda s: (free[s], -s))
            take = min(n - done, max(1, int(free[k] // size)))
            out.append((group, done, take, k))
            free[k] -= take * size
            held[k] += take
            done += take
    return out, held, [max(0.0, x) for x in free]


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``; the law is ``bytes``.

    Null text counts as empty (size 1); all empty texts are one group. A text longer than a shard is a shard's only
    large one. Rows that repeat a doc_id, null ones too, get slots of their own; which of fully equal rows comes first
    is open. An empty table gives no rows. ``grown_shard`` is null, as only the law ``key`` has it. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
        ),
        "records",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, 2 * total // ranges)
    ranged = materialize(rows.withColumn("range", _range_of(F.col("key"), splitters(rows, total, ranges))), "ranged")
    overfull = ranged.groupBy("range").agg(F.sum("size").alias("b")).where(F.col("b") > most).select("range")  # at most ``ranges`` rows
    large = ranged.join(F.broadcast(overfull), "range", "left_semi").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    large = large.where(F.col("n") * F.col("size") > most / 2).orderBy(*GROUP).collect()  # at most ``ranges`` rows, by their bytes
    placed, held, free = room([(i, g["n"], g["size"]) for i, g in enumerate(large)], total, shards)
    table = spark.createDataFrame([(*(g[c] for c in GROUP), ranges + i) for i, g in enumerate(large)], "key long, text_crc32 long, size long, own int")
    ranged = ranged.join(F.broadcast(table), GROUP, "left").withColumn("range", F.coalesce("own", "range")).drop("own")
    full = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))  # at most twice ``ranges`` rows
    by_bytes = F.when(F.col("range") < ranges, F.ceil(F.col("bytes") / most)).otherwise(1)
    parts = full.select("range", F.greatest(F.lit(1), F.ceil(F.col("n") / part_rows), by_bytes).cast("int").alias("parts"))
    of = F.when(F.col("range") < ranges, F.xxhash64("key", F.lit(1))).otherwise(F.xxhash64("doc_id"))
    cut = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(of, F.col("parts")).cast("int")).drop("parts")
    sums = cut.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("range", "part")  # over parts of ranges, not over records
    own = Window.partitionBy("range").orderBy("part")  # the parts of a large group
    before = lambda c, w: F.sum(c).over(w) - F.col(c)
    base = sums.select("range", "part", before("bytes", order).alias("bytes_before"), before("n", order).alias("rows_before"), before("n", own).alias("own_before"))
    inside = Window.partitionBy("range", "part").orderBy(*GROUP, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "part", *GROUP)
    at = cut.withColumn("end", F.sum("size").over(inside)).withColumn("row", F.row_number().over(inside) - 1)
    at = at.withColumn("middle", (F.min(F.col("end") - F.col("size")).over(group) + F.max("end").over(group)) / 2)
    # As many rows of sums as parts: ``ranges`` and one for every ``part_rows`` records, about.
    at = materialize(at.join(F.broadcast(base), ["range", "part"]), "placed")
    small = at.where(F.col("range") < ranges).withColumn("middle", F.col("bytes_before") + F.col("middle"))
    rest = sum(free)
    scale = (total - sum(g["n"] * g["size"] for g in large)) / rest if rest else 0.0
    ends = [scale * sum(free[: k + 1]) for k in range(shards)]
    behind = F.size(F.filter(F.array(*(F.lit(float(x)) for x in ends)), lambda x: x <= F.col("middle")))
    last = max((k for k in range(shards) if free[k] > 0), default=shards - 1)
    small = small.withColumn("shard", F.least(F.lit(last), behind).cast("int")).withColumn("place", F.col("rows_before") + F.col("row"))
    counts = spark.createDataFrame([(k, held[k]) for k in range(shards)], "shard int, held long")
    first = small.groupBy("shard").agg(F.min("place").alias("first")).join(F.broadcast(counts), "shard")  # a row for each shard
    small = small.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first") + F.col("held"))
    used, runs = [0] * shards, []
    for i, begin, n, k in placed:
        runs.append((ranges + i, begin, begin + n, k, used[k]))
        used[k] += n
    runs = spark.createDataFrame(runs, "range int, begin long, stop long, shard int, first long")  # at most ``ranges`` + ``shards`` rows
    rank = F.col("own_before") + F.col("row")
    big = at.where(F.col("range") >= ranges).withColumn("rank", rank).join(F.broadcast(runs), "range").where("rank >= begin AND rank < stop")
    big = big.withColumn("slot", F.col("first") + F.col("rank") - F.col("begin"))
    out = lambda df: df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return out(small).unionByName(out(big))
