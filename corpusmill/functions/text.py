"""Text expressions: terms, keywords, normalisation, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN

# English stop words, the usual published list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now"
).split()


def terms(text: Column, stop_words=STOP_WORDS, least: int = 2) -> Column:
    """Lower-case runs of ASCII letters and digits that are no stop words and at least ``least`` characters long, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop_words))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def keywords(text: Column, least: int = 3, stop_words=STOP_WORDS) -> Column:
    """Distinct words of ``least`` characters or more that are no stop words, in order of appearance."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) >= least) & ~w.isin(*stop_words)))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def keyword_rewrite(text: Column) -> Column:
    """Distinct keywords of two or more characters as a query; null if empty or the same as the query itself."""
    joined = F.array_join(keywords(text, 2), " ")
    return F.when((joined != "") & (joined != F.lower(collapse_space(text))), joined)


def once(value: Column) -> Column:
    """``value`` behind a generator, which filters on it are not pushed below: they read it instead of computing it again."""
    return F.explode(F.array(value))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def short_hash(*parts: Column) -> Column:
    """First eight hex digits of the MD5 of the parts, joined by a bar."""
    return F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8)


def split_topics(text: Column) -> Column:
    """Topics between commas and line ends, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"[,\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def positive_ints(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x > 0)
