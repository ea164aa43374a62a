"""End-to-end batched retrieval: every query of a DataFrame is answered in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALPHA, DENSE_TOP_K, LIMIT, MAX_SEMANTIC, REWRITE_WEIGHTS, SPARSE_TOP_K
from ..functions.embed import embedded
from ..functions.text import keyword_rewrite, once, terms
from ..functions.vectors import cosine, fused
from ..operators import blockmax, dense, fusion, graph, serving
from ..operators.lineage import cut

Embed = Callable[..., DataFrame]  # (rows, text column, out column, is_query=...) as ``embedded``
Score = Callable[[DataFrame, str, str], DataFrame]  # (pairs, question column, text column) as ``lexical_score``


def rewrites(queries: DataFrame, given: DataFrame | None = None, embed: Embed | None = None, kept: int = MAX_SEMANTIC) -> DataFrame:
    """(query_id, batch_id, rewrite_idx, rewrite, type, weight): the query, rewrites given by a model, and its keywords.

    Rewrites equal to an earlier one, whatever the case, are left out. With ``embed``, so are given ones that drifted from
    their query; where a vector of a query or of one of its rewrites is missing, its first ``kept`` semantic ones stay.
    """
    weight = F.create_map(*(F.lit(x) for p in REWRITE_WEIGHTS.items() for x in p))
    base = queries.select("query_id", "batch_id", F.lit(0).alias("rewrite_idx"), F.col("text").alias("rewrite"), F.lit("original").alias("type"))
    words = queries.select("query_id", "batch_id", F.lit(1000).alias("rewrite_idx"), keyword_rewrite(F.col("text")).alias("rewrite"), F.lit("keyword").alias("type"))
    rows = base.unionByName(words.where("rewrite IS NOT NULL"))
    if given is not None:
        given = given.select("query_id", "batch_id", "rewrite_idx", "rewrite", "type")
        rows = rows.unionByName(undrifted(queries, given, embed, kept) if embed else given)
    first = rows.groupBy("query_id", "batch_id", F.lower(F.trim("rewrite")).alias("k")).agg(F.min(F.struct("rewrite_idx", "rewrite", "type")).alias("r"))
    return first.select("query_id", "batch_id", "r.*").withColumn("weight", weight[F.col("type")])


def undrifted(queries: DataFrame, given: DataFrame, embed: Embed, kept: int = MAX_SEMANTIC) -> DataFrame:
    """The given rewrites close enough to their query for their type, or, without vectors, its first semantic ones.

    Each different text is embedded once; questions are embedded as texts here, as their rewrites are.
    """
    key = ["query_id", "batch_id"]
    texts = queries.select("text").unionByName(given.select(F.col("rewrite").alias("text"))).distinct()
    known = embed(texts, "text", "v")
    sides = given.join(queries.select(*key, F.col("text").alias("asked")), key)
    vector = lambda text, name: known.select(F.col("text").alias(text), F.col("v").alias(name))
    both = sides.join(vector("asked", "a"), "asked", "left").join(vector("rewrite", "b"), "rewrite", "left")
    own = Window.partitionBy(*key)
    both = both.withColumn("failed", F.bool_or(F.col("a").isNull() | F.col("b").isNull()).over(own)).withColumn("similarity", cosine(F.col("a"), F.col("b")))
    turn = F.row_number().over(Window.partitionBy(*key, "type").orderBy("rewrite_idx"))
    fallback = both.withColumn("turn", turn).where("failed AND type = 'semantic'").where(F.col("turn") <= kept)
    return serving.drift_guard(both.where("NOT failed")).select(*given.columns).unionByName(fallback.select(*given.columns))


def lexical_score(query: DataFrame, text: str, other: str) -> DataFrame:
    """``rerank_score``: the share of the query's distinct terms that a text holds; stands in for a cross-encoder."""
    q = F.array_distinct(terms(F.col(text)))
    held = query.withColumn("_q", once(q)).withColumn("_t", terms(F.col(other)))
    score = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_t")) / F.size("_q")).otherwise(F.lit(0.0))
    return held.withColumn("rerank_score", score).drop("_q", "_t")


def contextual(section: Column, text: Column) -> Column:
    """A text under its section's title, as a reranker reads it."""
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section, F.lit("\n"), text)).otherwise(text)


def rerank(candidates: DataFrame, asked: DataFrame, known: DataFrame | None = None, score: Score = lexical_score) -> DataFrame:
    """``candidates`` with rerank_score: the best score of any of their query's (query_id, ask) texts.

    Each different pair of question and text is scored once. Pairs found in ``known`` (ask, body, rerank_score) are not
    scored again. Candidates need query_id, section_title and body.
    """
    full = candidates.withColumn("body", contextual(F.col("section_title"), F.col("body")))
    pairs = full.select("query_id", "chunk_id", "body").join(asked.distinct(), "query_id")
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps the scoring of few bytes on many tasks
    unique = pairs.select("ask", "body").repartition(n, "ask", "body").distinct()
    if known is not None:
        scored = score(unique.join(known, ["ask", "body"], "left_anti"), "ask", "body").unionByName(unique.join(known, ["ask", "body"]))
    else:
        scored = score(unique, "ask", "body")
    best = pairs.join(scored, ["ask", "body"]).groupBy("query_id", "chunk_id").agg(F.max("rerank_score").alias("rerank_score"))
    return full.join(best, ["query_id", "chunk_id"])


def best_semantic(hits: DataFrame, kept: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(query_id, ask): the semantic rewrite whose hits weigh most among the candidates that are left."""
    share = F.when(F.col("channel") == "dense", F.lit(alpha)).otherwise(F.lit(1 - alpha))
    own = hits.where("type = 'semantic'").join(kept.select("query_id", "chunk_id"), ["query_id", "chunk_id"])
    impact = own.groupBy("query_id", "rewrite").agg(F.round(F.sum(F.col("score") * F.col("weight") * share), 9).alias("impact"))
    order = Window.partitionBy("query_id").orderBy(F.desc("impact"), "rewrite")
    return impact.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", F.col("rewrite").alias("ask"))


def channels(index: blockmax.BlockIndex, asked: DataFrame, vectors: DataFrame | None, embed: Embed) -> DataFrame:
    """(query_id, chunk_id, channel, score, rewrite_idx, rewrite, type, weight): hits of every rewrite in every channel."""
    key = F.concat_ws("/", F.col("query_id").cast("string"), F.col("rewrite_idx").cast("string"))
    wide = asked.withColumn("key", key)
    found = blockmax.search(index, wide.select(F.col("key").alias("query_id"), "batch_id", F.col("rewrite").alias("text")), SPARSE_TOP_K)
    hits = found.select(F.col("query_id").alias("key"), "chunk_id", "score", F.lit("sparse").alias("channel"))
    if vectors is not None:
        questions = embed(wide.select(F.col("key").alias("query_id"), "batch_id", "rewrite"), "rewrite", "query_vector", is_query=True)
        near = dense.search(vectors, questions, DENSE_TOP_K)
        hits = hits.unionByName(near.select(F.col("query_id").alias("key"), "chunk_id", "score", F.lit("dense").alias("channel")))
    return hits.join(wide.select("key", "query_id", "rewrite_idx", "rewrite", "type", "weight"), "key").drop("key")


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    edges: DataFrame | None = None,
    given: DataFrame | None = None,
    limit: int = LIMIT,
    vectors: DataFrame | None = None,
    embed: Embed = embedded,
    score: Score = lexical_score,
    known: DataFrame | None = None,
    index: blockmax.BlockIndex | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rerank_score, final_score, origins, rank) of the best chunks of each query's batch.

    Rewrites that drifted from their query are left out; the others search the lexical index and, where ``vectors`` (batch_id, chunk_id, embedding) are given, these; hits are
    folded over rewrites in order, fused by rank, and expanded over the graph where edges are given and the first hits
    are not sure enough. Candidates are normalised and filtered, kept diverse, reranked by the question and its best
    semantic rewrite, and cut at the first gap. A chunk of another batch is never a candidate.
    """
    asked = rewrites(queries, given, embed)
    hits = cut(channels(index or blockmax.build(chunks), cut(asked), vectors, embed))
    folded = fusion.consensus_fold(hits)
    scores = cut(fusion.rrf(folded))
    origins = folded.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("channel")).alias("origins"))
    batch = queries.select("query_id", "batch_id")
    if edges is not None:
        flagged = scores.join(origins, ["query_id", "chunk_id"])
        sides = [F.array_contains("origins", c).alias(f"in_{c}") for c in ("dense", "sparse")]
        sure = fusion.skip_expansion(flagged.select("query_id", "chunk_id", "score", *sides)).where("skip").select("query_id")
        seeds = scores.join(sure, "query_id", "left_anti").join(batch, "query_id")
        grown = graph.expand(seeds, edges).select("query_id", "chunk_id", "score", F.lit(True).alias("graph"))
        scores = cut(grown.unionByName(scores.join(sure, "query_id", "left_semi").withColumn("graph", F.lit(False))))
        origins = scores.join(origins, ["query_id", "chunk_id"], "left").select(
            "query_id", "chunk_id", F.concat(F.coalesce("origins", F.array().cast("array<string>")), F.when(F.col("graph"), F.array(F.lit("graph"))).otherwise(F.array().cast("array<string>"))).alias("origins")
        )
        scores = scores.drop("graph")
    kept = cut(fusion.minmax_filter(scores).drop("rank", "normalized"))
    body = chunks.select("batch_id", "chunk_id", "document_id", "section_title", F.col("text").alias("body"))
    full = kept.join(batch, "query_id").join(body, ["batch_id", "chunk_id"]).drop("batch_id")
    varied = cut(fusion.diversity(full).drop("rank"))
    asks = queries.select("query_id", F.col("text").alias("ask")).unionByName(best_semantic(hits, kept))
    ranked = rerank(varied, asks, known, score).withColumn("final_score", fused(F.col("score"), F.col("rerank_score")))
    until_gap = fusion.gap_cut(ranked.select("query_id", "chunk_id", F.col("score").alias("retrieval"), "rerank_score", F.col("final_score").alias("score")))
    placed = until_gap.withColumn("rank", F.row_number().over(fusion._best_first())).where(F.col("rank") <= limit)
    out = placed.select("query_id", "chunk_id", F.col("retrieval").alias("score"), "rerank_score", F.col("score").alias("final_score"), "rank")
    return out.join(origins, ["query_id", "chunk_id"], "left")
