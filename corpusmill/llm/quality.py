"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and as at be by for from has he in is it its of on or that the this to was were will with "
    "au aux ce dans de des du elle en et il la le les que qui par pour sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "al con del el es las los no por se su"
).split()

#: (metric, comparison, limit): a document is kept where every line of the table holds.
THRESHOLDS = (
    ("n_words", ">=", 50),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 20.0),
    ("symbols_per_word", "<=", 0.1),
    ("marks_per_word", "<=", 0.5),
    ("stop_word_ratio", ">=", 0.01),
    ("dup_line_ratio", "<=", 0.5),
)

_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def _grams(words: Column) -> Column:
    """The 3-word windows as strings; words hold no space, so a joined window has one reading only."""
    last = F.size(words) - 3
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<string>"))


def _covered(grams: Column) -> Column:
    """Words covered by windows that occur twice or more: sort windows, keep those equal to a neighbour, add up new words."""

    def starts(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["g"] == F.get(s, k)["g"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(hits, lambda j: F.get(s, j)["i"]))

    zero = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
    ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    total = F.aggregate(
        let(ranked, starts),
        zero,
        lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), total).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the ratios of the table to ``docs``, all as built-in expressions over the whole text.

    Null text counts as empty; ratios of texts without words are 0. The counts come in one struct column, ``_quality``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")
    parts = docs.withColumn(
        "_words", F.filter(F.split(body, SPACE), lambda w: w != "")
    ).withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = long(F.size("_words"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    base = F.struct(
        n.alias("n_words"),
        long(F.length(F.regexp_replace(body, SPACE, ""))).alias("word_chars"),
        long(F.regexp_count(body, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        let(_grams(F.col("_words")), _covered).alias("n_repeat_words"),
        long(F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
        long(F.regexp_count(body, F.lit(r"[!?]"))).alias("n_marks"),
        long(F.size("_lines")).alias("n_lines"),
    )
    q = F.col("_base")
    ratios = F.struct(
        "_base.*",
        share(q["word_chars"], q["n_words"]).alias("mean_word_chars"),
        share(q["n_symbols"], q["n_words"]).alias("symbols_per_word"),
        share(q["n_marks"], q["n_words"]).alias("marks_per_word"),
        share(q["n_stop_words"], q["n_words"]).alias("stop_word_ratio"),
        share(q["n_dup_lines"], q["n_lines"]).alias("dup_line_ratio"),
    )
    # A generator, so that Spark evaluates the measures once, not again for each line of the table in a pushed-down filter.
    return parts.withColumn("_base", base).drop("_words", "_lines").withColumn("_quality", F.explode(F.array(ratios))).drop("_base")


def verdict(quality: Column, thresholds=THRESHOLDS) -> Column:
    """Compile the table into one boolean expression over the measures."""
    return reduce(lambda a, b: a & b, (_COMPARE[op](quality[metric], F.lit(limit)) for metric, op, limit in thresholds))


def base_failed(quality: Column) -> Column:
    return (quality["n_words"] < 50) | (100 * quality["n_repeat_words"] > 50 * quality["n_words"])


def quality_report(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: doc_id, base counts, ``base_failed`` and ``kept``, then the ratios.

    Null texts count as empty and fail by their words; very long texts are measured whole. Repeated rows, and rows with
    a null or repeated doc_id, are judged each on its own; an empty table gives an empty result; other columns are ignored.
    """
    q = F.col("_quality")
    measured = measure(docs.select("doc_id", "text")).drop("text")
    failed = base_failed(q)
    return measured.select(
        "doc_id",
        *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & verdict(q, thresholds)).alias("kept"),
        *(F.round(q[c], 6).alias(c) for c in ("mean_word_chars", "symbols_per_word", "marks_per_word", "stop_word_ratio", "dup_line_ratio")),
    )


def quality_filter(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep. The row travels as one struct: no name clashes."""
    q = F.col("_quality")
    held = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    return measure(held).where(~base_failed(q) & verdict(q, thresholds)).select("_row.*")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: DuckDB form of ``quality_report``.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
h AS (SELECT rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram FROM g),
r AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM h),
c AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM r WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_marks,
        len(list_filter(words, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines
      FROM w LEFT JOIN c ON w.rid = c.rid LEFT JOIN l ON w.rid = l.rid),
q AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0::DOUBLE END AS m1,
        CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0::DOUBLE END AS m2,
        CASE WHEN n_words > 0 THEN n_marks::DOUBLE / n_words ELSE 0::DOUBLE END AS m3,
        CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0::DOUBLE END AS m4,
        CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0::DOUBLE END AS m5 FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_words >= 50 AND m1 >= 2.0 AND m1 <= 20.0 AND m2 <= 0.1::DOUBLE AND m3 <= 0.5::DOUBLE AND m4 >= 0.01::DOUBLE AND m5 <= 0.5::DOUBLE) AS kept,
  round(m1, 6) AS mean_word_chars, round(m2, 6) AS symbols_per_word, round(m3, 6) AS marks_per_word,
  round(m4, 6) AS stop_word_ratio, round(m5, 6) AS dup_line_ratio
FROM q
"""
