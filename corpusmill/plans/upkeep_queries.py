"""Queries of index upkeep, page structs, artefacts and request handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, studio, upkeep
from ..sources import pdf, web
from .queries import _WORDS, query, r6, table


def points_of(spark, sf):
    """Embedding rows as points; their label is the batch, tens of vectors are a document."""
    v = table(spark, sf, "embeddings")
    return v.select(F.col("label").alias("batch_id"), F.floor(F.col("vec_id") / 10).alias("document_id"), F.col("vec_id").alias("chunk_id"), "embedding")


@query("SELECT vec_id AS chunk_id, label AS batch_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def upsert_points(spark, sf):
    p = points_of(spark, sf).drop("embedding")
    both = upkeep.upsert_points(p.where("chunk_id % 2 = 0").withColumn("origin", F.lit("old")), p.where("chunk_id % 3 = 0").withColumn("origin", F.lit("new")))
    return both.select("chunk_id", "batch_id", "origin")


@query(
    """WITH p AS (SELECT label AS b, vec_id // 10 AS d, vec_id AS c FROM embeddings), g AS (SELECT DISTINCT b, d FROM p WHERE d % 7 = 0 AND b % 2 = 0)
SELECT b AS batch_id, d AS document_id, count(*)::BIGINT AS n, b IN (SELECT b FROM g) AS reindex FROM p WHERE (b, d) NOT IN (SELECT b, d FROM g) GROUP BY ALL"""
)
def delete_documents(spark, sf):
    p = points_of(spark, sf)
    left, again = upkeep.delete_document(p, p.where("document_id % 7 = 0 AND batch_id % 2 = 0").select("batch_id", "document_id").distinct())
    counts = left.groupBy("batch_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    marked = again.select("batch_id").distinct().withColumn("reindex", F.lit(True))
    return counts.join(marked, "batch_id", "left").select("batch_id", "document_id", "n", F.coalesce("reindex", F.lit(False)).alias("reindex"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0")
def wrong_dimensions(spark, sf):
    n = F.col("chunk_id")
    cut = F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return upkeep.wrong_dimensions(points_of(spark, sf).withColumn("embedding", cut)).select("chunk_id")


@query(
    """SELECT n_nationkey AS batch_id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'ready' WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) THEN 'rebuild' ELSE 'purge' END AS action FROM nation"""
)
def upkeep_actions(spark, sf):
    n = F.col("n_nationkey")
    batches = table(spark, sf, "nation").select(n.alias("batch_id"), (n % 2 == 0).alias("has_lexical"), (n % 3 == 0).alias("has_graph"))
    return upkeep.upkeep_actions(batches, table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("batch_id")))


@query("SELECT o_orderpriority AS batch_id, floor(sum(length('{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || '}')) * 1.5)::BIGINT AS bytes FROM orders GROUP BY 1")
def index_bytes(spark, sf):
    return upkeep.index_bytes(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch_id"), "o_orderkey", "o_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def orphaned_rows(spark, sf):
    live = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("batch_id"))
    return upkeep.orphans(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("batch_id")), live).select("c_custkey")


@query()
def ingest_points(spark, sf):
    """Chunks of all documents with their vectors."""
    return upkeep.points(upkeep.chunked(table(spark, sf, "documents"))).select("batch_id", "document_id", "chunk_id", "section_title", F.md5("text").alias("text_md5"), F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query(
    rf"""WITH s AS (SELECT doc_id, i // 1000 + 1 AS sequential_index, substr(text, i + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS i FROM documents)),
w AS (SELECT doc_id, sequential_index, unnest({_WORDS}[1:512]) AS word FROM s),
h AS (SELECT doc_id, sequential_index, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM w),
v AS (SELECT doc_id, sequential_index, h % 64 AS place, sum(CASE WHEN (h >> 31) & 1 = 1 THEN -1 ELSE 1 END) AS n FROM h GROUP BY ALL)
SELECT doc_id, sequential_index::INTEGER AS sequential_index, place::INTEGER AS place, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, sequential_index)))::FLOAT::DOUBLE, 5) AS value FROM v WHERE n <> 0"""
)
def text_vectors(spark, sf):
    """Vectors of all slices of all documents, place by place; equal slices are embedded once."""
    slices = chunking.fixed_slices(table(spark, sf, "documents")).select("doc_id", "sequential_index", F.col("slice").alias("text"))
    places = upkeep.embed_unique(slices, "text").select("doc_id", "sequential_index", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return places.withColumn("value", F.round(F.col("value").cast("double"), 5))


def page_structs(spark, sf):
    """Documents as pages: a block for each line, a span for each word, sizes by word length; some pages are scans."""
    spans = lambda line: F.transform(F.split(line, " "), lambda w: F.struct(w.alias("text"), (10 + F.length(w) % 7).cast("double").alias("size")))
    one = lambda line: F.struct(F.lit(None).cast("array<double>").alias("bbox"), F.array(F.struct(spans(line).alias("spans"))).alias("lines"))
    n = F.col("doc_id")
    blocks = F.when(n % 9 == 0, F.array().cast("array<struct<bbox:array<double>,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>")).otherwise(F.transform(F.split("text", "\n"), one))
    grid = F.array(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))))
    return table(spark, sf, "documents").select(
        n.cast("string").alias("document_id"), F.lit(1).alias("page"), blocks.alias("blocks"), (n % 3).cast("int").alias("n_images"),
        F.when(n % 2 == 0, F.col("text")).alias("ocr_text"), F.when(n % 4 == 0, grid).otherwise(F.array().cast("array<array<array<string>>>")).alias("tables"),
    )


_SPANS = r"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 9 <> 0),
wd AS (SELECT doc_id, i, l, list_filter(string_split(l, ' '), lambda w: trim(w) <> '') AS w, list_transform(string_split(l, ' '), lambda w: 10 + length(w) % 7) AS s FROM ln),
md AS (SELECT doc_id, list_sort(flatten(list(s)))[len(flatten(list(s))) // 2 + 1] AS m FROM wd GROUP BY 1)"""


@query(
    f"""WITH {_SPANS}, b AS (SELECT wd.doc_id, i, array_to_string(list_transform(w, lambda x: trim(x)), ' ') AS t, list_max(list_transform(w, lambda x: 10 + length(x) % 7)) AS x, m FROM wd JOIN md USING (doc_id) WHERE len(w) > 0)
SELECT doc_id::VARCHAR AS document_id, 'p1_b' || i AS block_id, CASE WHEN x >= m * 1.25::DOUBLE THEN 'heading' WHEN t[1] IN ('-', '•', '*', '–', '—') THEN 'list' ELSE 'paragraph' END AS block_type, md5(t) AS text_md5 FROM b"""
)
def pdf_text_blocks(spark, sf):
    return pdf.text_blocks(page_structs(spark, sf)).select("document_id", "block_id", "block_type", F.md5("text").alias("text_md5"))


@query(
    """SELECT doc_id::VARCHAR AS document_id, s AS source, n::BIGINT AS n FROM (
  SELECT doc_id, 'ocr' AS s, 1 AS n FROM documents WHERE doc_id % 9 = 0 AND doc_id % 2 = 0 AND trim(coalesce(text, '')) <> '' UNION ALL SELECT doc_id, 'table_extractor', 1 FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'vision', doc_id % 3 FROM documents WHERE doc_id % 3 > 0)"""
)
def pdf_other_blocks(spark, sf):
    return pdf.blocks_of(page_structs(spark, sf)).where("source <> 'text'").groupBy("document_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 9 = 0 THEN false ELSE trim(coalesce(text, '')) <> '' END AS has_text_layer, CASE WHEN doc_id % 9 = 0 OR len(regexp_extract_all(text, '[^ \\n]+')) = 0 THEN doc_id % 3 > 0 ELSE NULL END AS scan FROM documents"""
)
def pdf_page_facts(spark, sf):
    f = pdf.page_facts(page_structs(spark, sf))
    return f.select("document_id", "has_text_layer", F.when(F.col("text_length") == 0, F.col("is_scanned")).alias("scan"))


@query(
    """SELECT page_id, CASE WHEN t / greatest(h, 1)::DOUBLE > 0.02 AND t > 500 THEN 'primary' WHEN t >= 300 THEN 'readability' ELSE 'error' END AS method
FROM (SELECT page_id, length(html) * (1 + page_id % 60) AS h, length(html) - (page_id % 5) * 300 AS t FROM pages)"""
)
def extraction_gate(spark, sf):
    n = F.length("html")
    return table(spark, sf, "pages").select("page_id", web.extraction(n * (1 + F.col("page_id") % 60), n - (F.col("page_id") % 5) * 300).alias("method"))


@query(
    """WITH p AS (SELECT url, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1 AS pos, page_id % 4 AS m FROM pages)
SELECT 'map' || m AS sitemap, pos::INTEGER AS position, url FROM p WHERE pos < 30"""
)
def sitemap_pages(spark, sf):
    p = table(spark, sf, "pages")
    urls = p.groupBy((F.col("page_id") % 4).alias("m")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("u"))
    xml = F.array_join(F.transform("u", lambda x: F.concat(F.lit("<url><loc>"), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), "\n")
    return web.sitemap_links(urls.select(F.concat(F.lit("map"), F.col("m").cast("string")).alias("url"), xml.alias("xml")))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND turn % 3 <> 0 THEN 'topic' WHEN turn % 4 = 1 AND trim(CASE WHEN turn % 3 = 0 THEN text ELSE ' ' END) = '' THEN 'message' WHEN turn % 4 = 2 AND length(text) > 500 THEN 'length' END AS reason
FROM conversations"""
)
def request_validation(spark, sf):
    n = F.col("turn")
    kind = F.when(n % 4 == 0, "quiz").when(n % 4 == 1, "chat").when(n % 4 == 2, "podcast").otherwise("other")
    topic = F.when(n % 4 == 2, F.col("text")).when(n % 3 == 0, F.lit("x"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), F.array().cast("array<string>").alias("topics"), topic.alias("topic"), F.when(n % 3 == 0, F.col("text")).otherwise(" ").alias("message"))
    return studio.valid_requests(rows).select("conv_id", "turn", "reason")


@query("SELECT o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'not_found' END AS status FROM orders UNION ALL SELECT 'cached', 'completed'")
def job_status(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("kept"))
    asked = o.select(F.col("id").alias("job_id")).unionByName(spark.createDataFrame([("cached",)], "job_id string"))
    return studio.job_status(asked, o.where("kept"))


@query("SELECT role AS topic, text AS question FROM conversations WHERE turn > 1 AND (role, text) NOT IN (SELECT role, text FROM conversations WHERE turn <= 1) GROUP BY ALL")
def new_cards(spark, sf):
    c = table(spark, sf, "conversations").select("turn", F.col("role").alias("topic"), F.col("text").alias("question"))
    return studio.new_cards(c.where("turn > 1"), c.where("turn <= 1")).select("topic", "question")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND")
def fresh_cache(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("ts", "created_at")
    return studio.fresh(e, F.lit(e.agg(F.max("created_at")).first()[0])).select("event_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS speakers FROM conversations")
def podcast_scripts(spark, sf):
    """Transcripts stored as JSON, with single quotes, and broken."""
    n = F.col("turn")
    stored = F.when(n % 3 == 0, F.concat(F.lit('[{"speaker": "'), F.col("role"), F.lit('"}]'))).when(n % 3 == 1, F.concat(F.lit("[{'speaker': '"), F.col("role"), F.lit("'}]"))).otherwise("{broken")
    found = studio.scripts(stored)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x["speaker"]), ",").alias("speakers"))


@query(
    """WITH g AS (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 64 AS g FROM orders)
SELECT o_orderkey, ((row_number() OVER (PARTITION BY g ORDER BY o_orderkey) - 1 + g) % 3)::INTEGER AS key FROM g"""
)
def keys_in_turn(spark, sf):
    return studio.in_turn(table(spark, sf, "orders").select("o_orderkey"), 3, "o_orderkey")


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"""
)
def live_files(spark, sf):
    n = F.col("o_orderkey")
    files = table(spark, sf, "orders").select("o_orderkey", F.when(n % 2 == 0, "live").otherwise("draft").alias("batch_type"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("is_deleted"))
    return studio.active_files(studio.live(files)).select("o_orderkey")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'cooldown' ELSE 'cache' END AS effect FROM conversations WHERE turn % 5 <> 0")
def answer_effects(spark, sf):
    reply = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" "), F.lit(studio.NO_ANSWER))).otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply"), F.when(F.col("turn") % 5 == 0, "cache").otherwise("model").alias("origin"))
    return studio.after_answers(rows).select("conv_id", "turn", "effect")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (role = 'user' AND conv_id % 2 = 0 AND turn % 3 = 1)")
def quiz_delete(spark, sf):
    q = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("username"), (F.col("conv_id") % 2).cast("string").alias("batch_id"), (F.col("turn") % 3).cast("string").alias("topic"))
    return studio.without_quiz(q, "user", "0", "1").select("conv_id", "turn")


