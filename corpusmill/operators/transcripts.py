"""Speech: transcript units to segments, and the phases and voices of dialogue scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLOCK_GAP, BLOCK_SECONDS, OPEN_UNIT_SECONDS, PROSODY, PROSODY_INERTIA, PROSODY_LEAD, PROSODY_LIMITS, PROSODY_SLOWER, UNIT_CONFIDENCE
from ..functions.speech import emphasis


def flatten(segments: DataFrame) -> DataFrame:
    """Words where a segment has them, else the segment as one unit."""
    whole = F.array(
        F.struct(F.col("text").alias("word"), F.col("start").alias("start"), F.col("end").alias("end"), F.lit(None).cast("double").alias("score"))
    )
    units = F.when(F.size("words") > 0, F.col("words")).otherwise(whole)
    one = segments.select("document_id", "speaker", F.explode(units).alias("u"))
    end = F.coalesce("u.end", F.col("u.start") + OPEN_UNIT_SECONDS)
    return one.select("document_id", "speaker", F.col("u.word").alias("word"), F.col("u.start").alias("start"), end.alias("end"), F.coalesce("u.score", F.lit(UNIT_CONFIDENCE)).alias("score"))


def segments(units: DataFrame, gap: float = BLOCK_GAP, seconds: float = BLOCK_SECONDS) -> DataFrame:
    """Blocks of (document_id, start, end, speaker, word, score): a new one for another speaker, a pause, or a full block.

    Speaker and pause are windows; the length of a block depends on where it began, so it is a native fold.
    """
    w = Window.partitionBy("document_id").orderBy("start", "end")
    split = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))) | (F.col("start") - F.lag("end").over(w) > gap)
    marked = units.withColumn("turn", F.sum(F.coalesce(split, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = marked.groupBy("document_id", "turn", "speaker").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "score"))).alias("u"))
    zero = F.struct(F.lit(0).alias("c"), F.lit(None).cast("double").alias("t"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = a["t"].isNotNull() & (x["end"] - a["t"] > seconds)
        c = F.when(full, a["c"] + 1).otherwise(a["c"])
        return F.struct(c.alias("c"), F.when(full | a["t"].isNull(), x["start"]).otherwise(a["t"]).alias("t"), F.concat(a["out"], F.array(c)).alias("out"))

    cut = per.withColumn("c", F.aggregate("u", zero, step, lambda a: a["out"]))
    rows = cut.select("document_id", "turn", "speaker", F.explode(F.arrays_zip("u", "c")).alias("p")).select("document_id", "turn", "speaker", "p.u.*", F.col("p.c").alias("part"))
    return rows.groupBy("document_id", "turn", "part", "speaker").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_units"),
        F.round(F.avg("score"), 4).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "word"))), lambda x: x["word"]), " ").alias("text"),
    )


# Phases of a dialogue by progress, with their intensity.
PHASES = ((0.15, "HOOK", 0.6), (0.40, "BUILD", 0.75), (0.65, "FRICTION", 0.85), (0.85, "CLIMAX", 1.0), (9.0, "RESOLUTION", 0.5))
EMOTIONS = {"HOOK": "EXCITED", "BUILD": "REFLECTIVE", "FRICTION": "SERIOUS", "CLIMAX": "EXCITED", "RESOLUTION": "REFLECTIVE"}
REPEATED_EMOTION, MAX_WORDS = 0.9, 220


def _pick(progress: Column, field: int) -> Column:
    out = None
    for bound, *values in PHASES:
        out = F.when(progress < bound, F.lit(values[field])) if out is None else out.when(progress < bound, F.lit(values[field]))
    return out


def host(speaker: Column) -> Column:
    """The first or second host, by the first mark that the speaker's name contains; null if none."""
    return F.when(_any(speaker, ("1", "A", "First")), "Host 1").when(_any(speaker, ("2", "B", "Second")), "Host 2")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(text, F.lit(m))
    return out


def cap_words(text: Column, most: int = MAX_WORDS) -> Column:
    parts = F.split(F.trim(text), r"\s+")
    return F.when(F.size(parts) > most, F.array_join(F.slice(parts, 1, most), " ")).otherwise(F.trim(text))


def phases(lines: DataFrame) -> DataFrame:
    """Phase, emotion and intensity of each line of (topic, seq, emotion): an emotion repeated from the line before is softened."""
    w = Window.partitionBy("topic").orderBy("seq")
    n = F.count(F.lit(1)).over(Window.partitionBy("topic"))
    progress = (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))
    named = lines.withColumn("phase", _pick(progress, 0)).withColumn("base", _pick(progress, 1))
    fill = F.create_map(*(F.lit(x) for p in EMOTIONS.items() for x in p))
    again = F.lag("emotion").over(w).eqNullSafe(F.col("emotion"))
    soft = named.withColumn("intensity", F.round(F.when(again, F.col("base") * REPEATED_EMOTION).otherwise(F.col("base")), 6))
    return soft.withColumn("emotion", F.coalesce("emotion", fill[F.col("phase")])).drop("base")


# What marks an emotion in a line of small letters, in the order of preference.
CUES = {
    "EXCITED": (r"!+", r"\bwow\b", r"\bamazing\b"),
    "INQUISITIVE": (r"\?+", r"\breally\b", r"\bhow\b"),
    "REFLECTIVE": (r"\.\.\.", r"\bhmm\b"),
    "SERIOUS": (r"\bimportant\b", r"\bcritical\b"),
}


def emotion(text: Column) -> Column:
    """The emotion with most cues, each pattern counted on its own; ties go to the first, none is NEUTRAL."""
    lower = F.lower(text)
    counts = {name: reduce(lambda a, b: a + b, (F.regexp_count(lower, F.lit(c)) for c in cues)) for name, cues in CUES.items()}
    most = F.greatest(*counts.values())
    out = F.when(F.coalesce(most, F.lit(0)) == 0, "NEUTRAL")
    for name, n in counts.items():
        out = out.when(n == most, name)
    return out


def prosody_plan(lines: DataFrame) -> DataFrame:
    """emotion, rate, pitch and volume of each line of (topic, seq, speaker, text), spoken by "Host 1" and "Host 2".

    The emotion's settings times the emphasis of the line, cut to whole numbers; rate and pitch are softened where the
    emotion changes; a line is slower once one host has spoken over three lines more than the other; all are limited.
    No random variation is added.
    """
    w = Window.partitionBy("topic").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    said = lines.withColumn("emotion", emotion(F.col("text")))
    lead = F.sum(F.when(F.col("speaker") == "Host 1", 1).when(F.col("speaker") == "Host 2", -1).otherwise(0)).over(so_far)
    before = F.lag("emotion").over(w)
    turned = before.isNotNull() & (before != F.col("emotion"))
    slower = F.when(F.abs(lead) > PROSODY_LEAD, PROSODY_SLOWER).otherwise(0)
    setting = F.create_map(*(F.lit(x) for name, v in PROSODY.items() for x in (name, F.array(*map(F.lit, v)))))
    base = [(F.get(setting[F.col("emotion")], F.lit(i)) * emphasis(F.col("text"))).cast("int") for i in range(3)]
    soft = [F.when(turned, (x * PROSODY_INERTIA).cast("int")).otherwise(x) for x in base[:2]]
    values = [soft[0] - slower, soft[1], base[2]]
    limited = [F.greatest(F.least(v, F.lit(most)), F.lit(-most)) for v, most in zip(values, PROSODY_LIMITS, strict=True)]
    signed = lambda v, unit: F.concat(F.when(v >= 0, "+").otherwise("-"), F.abs(v).cast("string"), F.lit(unit))
    return said.withColumns({name: signed(v, unit) for name, v, unit in zip(("rate", "pitch", "volume"), limited, ("%", "Hz", "%"), strict=True)})


def duration_seconds(text: Column) -> Column:
    """Speaking time of all lines at 150 words a minute."""
    return F.sum(F.size(F.split(F.trim(text), r"\s+"))) / 150 * 60
