"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates fall into classes by the width of their shingles (five words, or all words of a shorter template) and their
number. A class has windows long enough that each stretch as long as its longest template lies whole in one of them;
then a text that holds ``THRESHOLD`` of a template's shingles has a least similarity with that window, and the number
of one-minimum bands is the least at which the probability of no shared band falls under ``MISS``.

A band of a window is the least keyed hash of its shingles, and only bands that a template has as well retrieve
anything. So the bands of templates are looked up from the other side: a window that does not hold the very shingle
from which a template's minimum comes cannot have that minimum, and its minima are not computed. All other windows get
all their minima, which are joined with the templates' on (class, band, minimum). Where the templates are too many for
that table to be sent to every task, all windows get their minima, and both sides are shuffled.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize
from .license_texts import TEMPLATES

WIDTH, THRESHOLD, MISS = 5, 0.75, 1e-6
MOST_BANDS = 1_000_000  # rows of the templates' bands that are sent to every task at most; beyond that they are shuffled
_WORD, _BREAK = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"

Class = tuple[int, int, int, int, int]  # width, most shingles of a template, stride, window, bands


def _words(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(_BREAK, text.lower()) if w]


def template_shingles(templates=TEMPLATES) -> dict[str, tuple[int, list[str]]]:
    """The width and the distinct shingles of each template; one without words is refused."""
    out = {}
    for name, text in templates:
        words = _words(text)
        if not words:
            raise ValueError(f"template {name} has no words")
        width = min(WIDTH, len(words))
        out[name] = width, list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))
    return out


def _top(n: int) -> int:
    return 1 << (n - 1).bit_length()


def classes(shingles: dict[str, tuple[int, list[str]]]) -> list[Class]:
    """The classes in use."""
    out = []
    for width, top in sorted({(w, _top(len(s))) for w, s in shingles.values()}):
        stride = max(1, top // 4)
        window = top + stride - 1
        sizes = [len(s) for w, s in shingles.values() if (w, _top(len(s))) == (width, top)]
        least = min(ceil(THRESHOLD * n) / (window + n - ceil(THRESHOLD * n)) for n in sizes)
        out.append((width, top, stride, window, 1 if least >= 1 else ceil(log(MISS) / log(1 - least))))
    return out


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, text) of each file of a folder of whole license texts; the name is the file's without its ending."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt)?$", 1)
    return [tuple(r) for r in spark.read.text(path, wholetext=True).select(name, "value").orderBy(name).collect()]  # a table of licenses


def _windows_at(stride: int, window: int):
    """The windows that hold a place."""

    def held(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((p - window + 1) / stride).cast("int")), F.floor(p / stride).cast("int"))

    return held


def _gram(w: Column, i: Column, width: int) -> Column:
    return F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))


def _grams(width: int):
    """The distinct shingles of at least ``width`` words."""
    return lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: _gram(w, i, width)))


def _own_hits(width: int, givers: list[str]) -> Column:
    return F.filter(f"hits{width}", lambda i: _gram(F.col("words"), i, width).isin(givers))


def _minimum(grams: str, k: int) -> Column:
    return F.array_min(F.transform(grams, lambda g: _keyed(g, F.lit(k))))


def _keyed(gram: Column, k: Column) -> Column:
    return F.xxhash64(gram, k)


def _template_bands(spark: SparkSession, shingles: dict[str, tuple[int, list[str]]], sizes: list[Class]) -> tuple[DataFrame, dict[tuple[int, int], list[str]] | None]:
    """(table of (license, template, width, top, k, minimum), the shingles of each class that give minima, unless too many)."""
    bands = {(width, top): b for width, top, _, _, b in sizes}
    table = spark.createDataFrame([(name, s, w, _top(len(s)), bands[w, _top(len(s))]) for name, (w, s) in shingles.items()], "license string, template array<string>, width int, top int, bands int")
    table = table.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    least = F.array_min(F.transform("template", lambda g: F.struct(_keyed(g, F.col("k")).alias("minimum"), g.alias("gram"))))
    table = table.withColumn("least", least).select("license", "template", "width", "top", "k", "least.minimum", "least.gram")
    if sum(bands[w, _top(len(s))] for w, s in shingles.values()) > MOST_BANDS:
        return table.drop("gram"), None
    givers = {c: set() for c in bands}
    for r in table.select("width", "top", "gram").distinct().collect():  # at most MOST_BANDS rows
        givers[r["width"], r["top"]].add(r["gram"])
    return table.drop("gram"), {c: sorted(g) for c, g in givers.items()}


def _with_hits(docs: DataFrame, words: Column, sizes: list[Class], givers: dict[tuple[int, int], list[str]]) -> DataFrame:
    """Texts that hold a wanted shingle: their words, and for each width where the wanted ones begin."""
    widths = sorted({width for width, *_ in sizes})
    of_width = {width: sorted({g for (w, _), found in givers.items() if w == width for g in found}) for width in widths}

    first = sorted({g.split(" ", 1)[0] for found in of_width.values() for g in found})

    def hits(w: Column, at: Column, width: int) -> Column:
        return F.filter(at, lambda i: (i <= F.size(w) - width) & _gram(w, i, width).isin(of_width[width]))

    def found(w: Column) -> Column:
        # The words that begin a wanted shingle, in one pass over all words.
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(first))
        at = F.when(F.size(w) > 0, begins).otherwise(F.array().cast("array<int>"))
        return let(at, lambda x: F.struct(w.alias("words"), *(hits(w, x, width).alias(f"hits{width}") for width in widths)))

    # A generator, so that Spark evaluates the words once, not again in a pushed-down filter.
    some = F.filter(F.array(let(words, found)), lambda h: sum((F.size(h[f"hits{x}"]) for x in widths), F.lit(0)) > 0)
    held = docs.select("doc_id", F.explode(some).alias("h")).select("doc_id", "h.*").withColumn("body", F.xxhash64("words"))
    return materialize(held, "license_hits")  # every class reads these few texts, none the others again


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, containment and first_word: the best window of each template that a document holds to 0.75.

    Words are runs of letters and digits, lower case. Null, empty and short texts match nothing; very long ones are
    scanned whole. Rows that repeat a doc_id, null ones too, are read each on its own, and the best of their windows
    counts; of equally good ones the first. Repeated rows change nothing; an empty table gives no rows; other columns
    are ignored. first_word counts the words before the window.
    """
    spark: SparkSession = docs.sparkSession
    shingles = template_shingles(templates)
    sizes = classes(shingles)
    table, givers = _template_bands(spark, shingles, sizes)
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(_WORD), F.lit(0))
    few = givers is not None
    held = _with_hits(docs, words, sizes, givers) if few else docs.select("doc_id", words.alias("words")).withColumn("body", F.xxhash64("words"))
    cut = None
    for width, top, stride, window, bands in sizes:
        if few:
            starts = F.array_distinct(F.flatten(F.transform(_own_hits(width, givers[width, top]), _windows_at(stride, window))))
        else:
            starts = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.floor((F.size("words") - width) / stride).cast("int")))
        part = held.select("doc_id", "body", "words", F.explode(starts).alias("w")).select(
            "doc_id", "body", F.lit(width).alias("width"), F.lit(top).alias("top"), (F.col("w") * stride).alias("start"),
            F.slice("words", F.col("w") * stride + 1, window + width - 1).alias("words"),
        )
        part = part.where(F.size("words") >= width).withColumn("grams", let(F.col("words"), _grams(width))).drop("words")
        part = part.withColumn("minima", F.array(*(_minimum("grams", k) for k in range(bands))))
        cut = part if cut is None else cut.unionByName(part)
    shared = cut.select("doc_id", "body", "width", "top", "start", "grams", F.posexplode("minima").alias("k", "minimum")).join(
        F.broadcast(table) if few else table, ["width", "top", "k", "minimum"]
    )
    containment = F.size(F.array_intersect("template", "grams")) / F.size("template")
    verified = shared.dropDuplicates(["doc_id", "body", "license", "start"]).withColumn("containment", containment).where(F.col("containment") >= THRESHOLD)
    best = verified.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("s"))).alias("best"))
    return best.select("doc_id", "license", F.round("best.containment", 6).alias("containment"), (-F.col("best.s")).cast("long").alias("first_word"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for name, (width, found) in template_shingles().items():
        top = _top(len(found))
        stride = max(1, top // 4)
        rows += [f"({quote(name)}, {width}, {len(found)}, {stride}, {top + stride - 1}, {quote(s)})" for s in found]
    widths = sorted({width for width, _ in template_shingles().values()})
    grams = " UNION ALL ".join(
        f"SELECT rid, {n} AS width, p, array_to_string(words[p + 1 : p + {n}], ' ') AS gram FROM (SELECT rid, words, unnest(range(0, len(words) - {n - 1})) AS p FROM w WHERE len(words) >= {n})"
        for n in widths
    )
    return rf"""
WITH t(license, width, size, stride, win, gram) AS (VALUES {", ".join(rows)}),
w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
g AS ({grams}),
h AS (SELECT rid, license, size, stride, win, g.gram, p FROM g JOIN t ON g.gram = t.gram AND g.width = t.width),
s AS (SELECT rid, license, size, stride, gram, unnest(range(greatest(0, ceil((p - win + 1) / stride::DOUBLE)::BIGINT), p // stride + 1)) AS x FROM h),
c AS (SELECT rid, license, x * stride AS start, count(DISTINCT gram) / any_value(size)::DOUBLE AS containment FROM s GROUP BY rid, license, x, stride),
r AS (SELECT doc_id, c.*, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS n FROM c JOIN w USING (rid) WHERE containment >= {THRESHOLD}::DOUBLE)
SELECT doc_id, license, round(containment, 6) AS containment, start::BIGINT AS first_word FROM r WHERE n = 1
"""


ORACLE_SQL = _oracle()
