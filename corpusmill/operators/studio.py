"""Artefacts made by a model for batches of requests: cards, quizzes, answers; their listings, checks and caches.

A model is a function of a DataFrame with a ``prompt`` that adds a ``reply``; everything around it is a plan over all
requests at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CACHE_TTL_S, MIN_CARD_CONFIDENCE, SCORES_KEPT
from ..functions.embed import embedded
from ..functions.jsonrescue import rescue_json
from ..functions.text import collapse_space
from . import cache, platform, serving
from .lineage import cut

Model = Callable[[DataFrame], DataFrame]

#: How an answer is pitched.
COMPLEXITY = {
    "5-Year-Old": "Use very simple words and basic concepts only.",
    "High School": "Use clear, standard language suitable for teens.",
    "Undergrad": "Use academic terminology and standard depth.",
    "PhD Expert": "Use highly technical language and focus on advanced nuances.",
}
#: Fixed value: what a model is told to reply without an answer; such a reply starts a cooldown and is not cached.
NO_ANSWER = "Currently we do not have the answer for this question."
_CARD = "array<struct<topic:string,question:string,answer:string,card_type:string,citations:array<string>,confidence_score:double>>"
_QUIZ = "array<struct<question:string,options:array<struct<id:string,text:string>>,correct_option_id:string,explanation:string,citation:string>>"
PODCAST_TOPIC_CHARS = 500


def pitch(complexity: Column) -> Column:
    found = F.create_map(*(F.lit(x) for p in COMPLEXITY.items() for x in p))
    return F.coalesce(found[complexity], F.lit(COMPLEXITY["Undergrad"]))


def topics_of(topics: Column, topic: Column) -> Column:
    """The topics asked for: the list, else the single one; null where neither is given."""
    return F.when(F.size(topics) > 0, topics).when(F.coalesce(topic, F.lit("")) != "", F.array(topic))


def valid_requests(requests: DataFrame) -> DataFrame:
    """``valid`` and ``reason`` of (kind, topics, topic, message) requests: a topic, a message, or a short enough topic is missing."""
    reason = (
        F.when(F.col("kind").isin("flashcards", "quiz") & topics_of(F.col("topics"), F.col("topic")).isNull(), "topic")
        .when((F.col("kind") == "chat") & (F.trim(F.coalesce("message", F.lit(""))) == ""), "message")
        .when((F.col("kind") == "podcast") & (F.length(F.coalesce("topic", F.lit(""))) > PODCAST_TOPIC_CHARS), "length")
    )
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def _passages(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): the passages of each request as marked-up text, best first."""
    text = F.concat(F.lit("<CHUNK id='"), F.col("chunk_id").cast("string"), F.lit("'>\n"), F.col("text"), F.lit("\n</CHUNK>"))
    rows = found.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", F.struct("rank", text.alias("t")).alias("p"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), " ").alias("context"))


def _asked(topics: DataFrame, found: DataFrame, chunks: DataFrame, task: str, schema: str, limit: int) -> DataFrame:
    """Prompts of the topics that have passages."""
    held = topics.join(_passages(found, chunks), "query_id")
    prompt = F.concat(
        F.lit(f"{task} on the topic: "), F.col("topic"), F.lit("\nLevel: "), pitch(F.col("complexity")),
        F.lit(f"\nUse nothing but the sources, cite their ids, and reply as JSON of this form: {schema}\nSources:\n"), F.col("context"), F.lit(f"\nMake {limit} items."),
    )
    return held.withColumn("prompt", prompt).drop("context")


def _items(field: str, schema: str) -> Column:
    """The items of a reply, a list or an object with the list as ``field``; null where there is no JSON."""
    reply = rescue_json(F.col("reply"))
    whole = F.from_json(reply, f"struct<{field}:{schema}>")[field]
    return F.when(F.ltrim(reply).startswith("["), F.from_json(reply, schema)).otherwise(whole)


def flashcards(topics: DataFrame, found: DataFrame, chunks: DataFrame, model: Model, limit: int = 15) -> DataFrame:
    """(query_id, username, batch_id, complexity, payload): the valid cards of each topic, from the passages ``found`` for it.

    ``topics`` has query_id, username, batch_id, topic and complexity; ``found`` is what retrieval gave (query_id,
    chunk_id, rank). Topics without passages, without JSON in the reply, or without a card that is sure enough, drop out.
    """
    replied = model(_asked(topics, found, chunks, "Make flashcards", '{"cards": [{"question", "answer", "card_type", "citations", "confidence_score"}]}', limit))
    cards = F.filter(_items("cards", _CARD), lambda c: c["confidence_score"] >= MIN_CARD_CONFIDENCE)
    named = F.transform(cards, lambda c: c.withField("topic", F.col("topic")))
    return replied.withColumn("payload", named).where(F.size("payload") > 0).select("query_id", "username", "batch_id", "complexity", "payload")


def quizzes(topics: DataFrame, found: DataFrame, chunks: DataFrame, model: Model, limit: int = 10) -> DataFrame:
    """(query_id, username, batch_id, complexity, topic, payload): the well-formed questions of each topic, as ``flashcards``."""
    replied = model(_asked(topics, found, chunks, "Make a quiz", '{"questions": [{"question", "options", "correct_option_id", "explanation", "citation"}]}', limit))
    good = platform.valid_questions(_items("questions", _QUIZ))
    return replied.withColumn("payload", good).where(F.col("payload").isNotNull()).select("query_id", "username", "batch_id", "complexity", "topic", "payload")


def answers(
    requests: DataFrame, enrolments: DataFrame, cached: DataFrame, retrieve: Callable[[DataFrame], DataFrame], chunks: DataFrame, model: Model, contexts: DataFrame | None = None
) -> DataFrame:
    """(query_id, reply, citations, origin) of chat requests (query_id, username, batch_id, text, complexity, suppressed).

    Suppressed requests and those of users that are not enrolled drop out. A request with a cached reply (query_id,
    reply, citations) gets it; one with a cached context in ``contexts`` (query_id, chunk_ids) is answered from that; the
    others are answered from what ``retrieve`` finds. Cited ids are read off the reply. ``chunk_ids``, what a new reply
    was made from, best first, is null for cached replies.
    """
    allowed = platform.enrolled(requests.where("NOT suppressed"), enrolments)
    known = allowed.select("query_id").join(cached.select("query_id", "reply", "citations"), "query_id").withColumn("origin", F.lit("cache"))
    open_ = allowed.join(cached.select("query_id"), "query_id", "left_anti")
    if contexts is None:
        found = retrieve(open_).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "rank").withColumn("origin", F.lit("model"))
    else:
        held = contexts.join(open_.select("query_id"), "query_id").select("query_id", F.posexplode("chunk_ids").alias("rank", "chunk_id")).withColumn("origin", F.lit("context"))
        new = retrieve(open_.join(contexts.select("query_id"), "query_id", "left_anti"))
        found = held.unionByName(new.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "rank").withColumn("origin", F.lit("model")))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    ids = found.groupBy("query_id", "origin").agg(F.transform(ranked, lambda x: x["chunk_id"]).alias("ids"))
    texts = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    context = serving.prompt_context(found.join(texts, "chunk_id"))
    prompt = F.concat(
        F.lit(f'Answer the question from the sources alone, cite them as [DOC_ID: id], or reply with "{NO_ANSWER}" only.\n'), pitch(F.col("complexity")),
        F.lit("\nSources:\n"), F.coalesce("context", F.lit("")), F.lit("\nQuestion: "), F.col("text"),
    )
    replied = model(open_.join(context, "query_id", "left").join(ids, "query_id", "left").withColumn("prompt", prompt))
    cited = F.coalesce(platform.citations(F.col("reply"), F.col("ids")), F.array().cast("array<string>"))
    out = replied.select("query_id", "reply", cited.alias("citations"), F.coalesce("origin", F.lit("model")).alias("origin"), F.col("ids").alias("chunk_ids"))
    return known.withColumn("chunk_ids", F.lit(None).cast("array<string>")).unionByName(out)


def chat(
    requests: DataFrame,
    enrolments: DataFrame,
    entries: DataFrame,
    values: DataFrame,
    now: Column,
    retrieve: Callable[[DataFrame], DataFrame],
    chunks: DataFrame,
    model: Model,
    verify: cache.Score,
    embed: cache.Embed = embedded,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, new cache entries, their values) of chat requests, which also have tutor_mode.

    The first tier of the cache has replies under the same complexity and mode, the second the chunks found for a
    question whatever these are; only what neither holds is retrieved, and only what the first doesn't hold goes to the
    model. New replies but the fixed sentence go into the first tier, new non-empty retrievals into the second.
    ``values`` has cache_id, created_at, reply, citations and chunk_ids.
    """
    allowed = platform.enrolled(requests.where("NOT suppressed"), enrolments)
    replies = cut(cache.lookup(allowed, entries, values.select("cache_id", "created_at", "reply", "citations"), now, verify, cache.RESPONSE, cache.FILTERS, embed))
    open_ = allowed.join(replies.select("query_id"), "query_id", "left_anti")
    contexts = cut(cache.lookup(open_, entries, values.select("cache_id", "created_at", "chunk_ids"), now, verify, cache.CONTEXT, (), embed).where("size(chunk_ids) > 0"))
    answered = cut(answers(requests, enrolments, replies, retrieve, chunks, model, contexts))
    made = answered.where("origin <> 'cache'").join(allowed.select("query_id", "batch_id", "text", *cache.FILTERS), "query_id")
    new, value = [], []
    for kind, rows, kept in (
        (cache.RESPONSE, made.where(F.trim("reply") != NO_ANSWER), ("reply", "citations")),
        (cache.CONTEXT, made.where("origin = 'model' AND size(chunk_ids) > 0").withColumns({f: F.lit(None).cast("string") for f in cache.FILTERS}), ("chunk_ids",)),
    ):
        own = cache.entries_of(rows, kind, now, embed)
        new.append(own)
        keyed = own.select("cache_id", "created_at", "batch_id", F.col("query").alias("text"), *cache.FILTERS)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("batch_id", "text", *cache.FILTERS)]
        first = keyed.alias("a").join(rows.alias("b"), same).groupBy("cache_id", "created_at").agg(F.min_by(F.struct("reply", "citations", "chunk_ids"), "query_id").alias("v"))
        value.append(first.select("cache_id", "created_at", *(F.col(f"v.{c}").alias(c) if c in kept else F.lit(None).cast(k).alias(c) for c, k in _VALUE.items())))
    return answered, new[0].unionByName(new[1]), value[0].unionByName(value[1])


_VALUE = {"reply": "string", "citations": "array<string>", "chunk_ids": "array<string>"}


def after_answers(answered: DataFrame, no_answer: str = NO_ANSWER) -> DataFrame:
    """``effect`` of each answer of a model: kept in the cache, or a cooldown where it is the fixed sentence."""
    new = answered.where("origin <> 'cache'")
    return new.withColumn("effect", F.when(F.trim("reply") == no_answer, "cooldown").otherwise("cache"))


def listing(artefacts: DataFrame, username: str, batch_id: str) -> DataFrame:
    """The artefacts of a user in a batch."""
    return artefacts.where((F.col("username") == username) & (F.col("batch_id") == batch_id))


def cards_of(artefacts: DataFrame) -> DataFrame:
    """One row for each card of the payloads."""
    return artefacts.select(*(c for c in artefacts.columns if c != "payload"), F.explode("payload").alias("c")).select("*", "c.*").drop("c")


def scripts(transcript: Column) -> Column:
    """A stored transcript as a list of lines: JSON, or a literal with single quotes; empty where it is neither."""
    schema = "array<struct<speaker:string,text:string,emotion:string>>"
    return F.coalesce(F.from_json(transcript, schema), F.from_json(transcript, schema, {"allowSingleQuotes": "true"}), F.array().cast(schema))


def podcasts(rows: DataFrame) -> DataFrame:
    """(id, username, audio_path, script, topic, duration_seconds) as a player lists them."""
    return rows.select("id", "username", F.col("filename").alias("audio_path"), scripts(F.col("transcript")).alias("script"), "topic", F.lit(0).alias("duration_seconds"))


def usable_podcasts(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Cached podcasts with a script and a sound file that is there."""
    return cached.where((F.size("script") > 0) & (F.coalesce("audio_path", F.lit("")) != "")).join(files.select("audio_path").distinct(), "audio_path", "left_semi")


def job_status(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, status) of asked jobs: "cached" is always completed, an unknown one "not_found"."""
    status = F.when(F.col("job_id") == "cached", "completed").otherwise(F.coalesce("status", F.lit("not_found")))
    return asked.join(jobs.select(F.col("id").alias("job_id"), "status"), "job_id", "left").select("job_id", status.alias("status"))


def live(batches: DataFrame) -> DataFrame:
    return batches.where("batch_type = 'live'")


def active_files(files: DataFrame) -> DataFrame:
    return files.where("NOT coalesce(is_deleted, false)")


def new_cards(cards: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("topic", "question")) -> DataFrame:
    """Cards that are not there yet, each once."""
    return cards.dropDuplicates(list(key)).join(existing.select(*key).distinct(), list(key), "left_anti")


def without_quiz(quizzes_: DataFrame, username: str, batch_id: str, topic: str) -> DataFrame:
    """What is left after a user's quizzes on a topic were deleted in a batch."""
    gone = (F.col("username") == username) & (F.col("batch_id") == batch_id) & (F.col("topic") == topic)
    return quizzes_.where(~F.coalesce(gone, F.lit(False)))


def fresh(cached: DataFrame, now: Column, seconds: int = CACHE_TTL_S) -> DataFrame:
    """Rows made less than ``seconds`` ago."""
    return cached.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) < seconds * 1_000_000)


def in_turn(rows: DataFrame, n: int, order: str, groups: int = 64) -> DataFrame:
    """``key``: numbers 0 to n - 1 dealt to rows in turn, within groups by hash, so that no task numbers all rows."""
    group = F.conv(F.substring(F.md5(F.col(order).cast("string")), 1, 8), 16, 10).cast("long") % groups
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("key", F.pmod(place + group.cast("int"), F.lit(n)).cast("int"))


def score_lookup(pairs: DataFrame, known: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs with rerank_score, the table of known scores with new ones): each unknown (ask, body) is scored once."""
    key = ["ask", "body"]
    new = score(pairs.select(*key).distinct().join(known, key, "left_anti")).select(*key, "rerank_score")
    table = known.select(*key, "rerank_score").unionByName(new)
    return pairs.join(table, key), table


def remembered(pairs: DataFrame, table: DataFrame, score: Callable[[DataFrame], DataFrame], most: int = SCORES_KEPT) -> tuple[DataFrame, DataFrame]:
    """(pairs with rerank_score, the table after them) with at most ``most`` scores kept, those used last.

    ``pairs`` has ask, body and ``seq``, the order of use, which goes on from batch to batch; ``table`` has ask, body,
    rerank_score and last_used. Each different unknown pair is scored once; ties of last use go to the smaller pair.
    """
    key = ["ask", "body"]
    scored, whole = score_lookup(pairs, table.select(*key, "rerank_score"), score)
    used = pairs.groupBy(*key).agg(F.max("seq").alias("_used"))
    dated = whole.join(table.select(*key, "last_used"), key, "left").join(used, key, "left")
    dated = dated.select(*key, "rerank_score", F.greatest("last_used", "_used").alias("last_used"))
    return scored, dated.orderBy(F.desc("last_used"), *key).limit(most)


def same_question(a: Column, b: Column) -> Column:
    """Whether two questions are the same but for case and white space."""
    return F.lower(collapse_space(a)) == F.lower(collapse_space(b))
