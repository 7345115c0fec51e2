"""Queries of the stored index, of chunking variants, of batches of vectors and of what follows a search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, context, retrieval, store
from quire.operators.fulltext import FullTextIndex, hits
from quire.plans.library_queries import _FIXED, _FTS, _HEADS, BOOKS, WS, _heads, _hybrid, _HYBRID, _query_vector, books_of
from quire.session import shared_dir, table
from quire.sources.files import decoded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BUILT: dict[tuple[str, str, str], str] = {}


def index_of(spark, sf, name: str, id_col: str, text_col: str) -> FullTextIndex:
    """The full-text index of a table, built once in a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        at = f"{shared_dir(spark)}/fulltext-{abs(hash(key)):x}"
        rows = table(spark, sf, name).groupBy(id_col).agg(F.min(text_col).alias(text_col))
        FullTextIndex(spark, at, buckets=16).insert(rows, id_col, text_col)
        _BUILT[key] = at
    return FullTextIndex(spark, _BUILT[key], buckets=16)


def _documents(spark, sf):
    return index_of(spark, sf, "documents", "doc_id", "text")


@query(_FTS + "SELECT id, round(score, 6) AS score FROM fts ORDER BY fts.score DESC, id LIMIT 10")
def fts_index_topk(spark, sf):
    """The stored index reads the buckets of the two terms."""
    found = _documents(spark, sf).search("pounds tin", None).select(F.col("id").cast("long").alias("id"), "score")
    return found.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"SELECT doc_id AS id FROM (SELECT doc_id, ' ' || array_to_string({_TOKENS}, '  ') || ' ' AS t FROM documents WHERE text IS NOT NULL) WHERE contains(t, ' iron  key ')")
def fts_index_phrase(spark, sf):
    return _documents(spark, sf).search("iron-key", None).select(F.col("id").cast("long").alias("id"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term")
def fts_df_stats(spark, sf):
    return _documents(spark, sf).document_frequencies()


@query(
    """WITH c AS (SELECT chunk_id, min(content) AS content FROM chunks GROUP BY chunk_id), k AS (SELECT chunk_id, any_value(book_id) AS book_id FROM chunks GROUP BY chunk_id)
SELECT c.chunk_id AS id, b.id AS book_id FROM c JOIN k USING (chunk_id) JOIN (SELECT DISTINCT id FROM books) b ON b.id = k.book_id
WHERE list_contains(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), 'boat') AND list_contains(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), 'left')"""
)
def fts_hits(spark, sf):
    """Hits with the chunk and its book; those without either drop out."""
    found = index_of(spark, sf, "chunks", "chunk_id", "content").search("boat left", None)
    chunks = table(spark, sf, "chunks").dropDuplicates(["chunk_id"])
    return hits(found, chunks, books_of(spark, sf)).select("id", "metadata.book_id")


#: Topics and the words searched for them, as a plan of materials would give them.
TOPICS = [("metal", 0, "pounds tin"), ("metal", 1, "iron key"), ("metal", 2, "brass bell"), ("sea", 0, "boat left"), ("sea", 1, "harbour"), ("night", 0, "lamp"), ("night", 1, "lamp table")]
_TOPICS = "(VALUES " + ", ".join(f"('{t}', {n}, '{q}')" for t, n, q in TOPICS) + ") AS q(topic, query_no, query)"
_MANY = f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM d), f AS (SELECT id, dl, term, count(*) AS f FROM p GROUP BY ALL), e AS (SELECT term, count(*) AS d FROM f GROUP BY term),
w AS (SELECT topic, query_no, unnest(string_split(query, ' ')) AS term, len(string_split(query, ' ')) AS n_terms FROM {_TOPICS}),
x AS (SELECT topic, query_no, id, n_terms, sum((CASE WHEN ln((n - e.d + 0.5) / (e.d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - e.d + 0.5) / (e.d + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS terms
  FROM w JOIN f USING (term) JOIN e USING (term) CROSS JOIN s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic, query_no ORDER BY round(score, 9) DESC, id) AS rank FROM x WHERE terms = n_terms QUALIFY rank <= 10),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY topic, id ORDER BY query_no, rank) = 1)
"""


def _topic_hits(spark, sf):
    plan = spark.createDataFrame(TOPICS, "topic string, query_no int, query string")
    asked = plan.select(F.struct("topic", "query_no").alias("query_id"), "query")
    found = _documents(spark, sf).search_many(asked, 10)
    return context.topic_hits(found.select("query_id.topic", "query_id.query_no", "rank", "id", "score"))


@query(_MANY + "SELECT topic, query_no, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM u")
def multi_query_search(spark, sf):
    """Several queries for each topic as one plan; a hit belongs to the first query that finds it."""
    return _topic_hits(spark, sf).withColumn("score", F.round("score", 6))


@query(_MANY + ", n AS (SELECT topic, count(*) AS hits FROM u GROUP BY topic) SELECT t.topic, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) >= 3 THEN 'adequate' ELSE 'insufficient' END AS coverage FROM (SELECT DISTINCT topic FROM q1 UNION SELECT 'nothing') t LEFT JOIN n USING (topic)".replace("q1", "w"))
def material_coverage(spark, sf):
    topics = spark.createDataFrame([(t,) for t in sorted({t for t, *_ in TOPICS})] + [("nothing",)], "topic string")
    return context.topic_coverage(_topic_hits(spark, sf), topics).select("topic", "hits", "coverage")


_U = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)"


@query(
    """SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 10"""
)
def vector_topk_batch(spark, sf):
    """Every id divisible by 20 against all rows."""
    e = table(spark, sf, "embeddings")
    return retrieval.vector_search_batch(e, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 64).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS at, round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12), 6) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(retrieval.normalised(F.col("embedding"))).alias("at", "x"))
    return e.withColumn("x", F.round("x", 6))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS at, round(sum(CAST(x AS DOUBLE)) / count(*), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def mean_pool(spark, sf):
    pooled = retrieval.mean_pooled(table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("vector").alias("at", "x")).withColumn("x", F.round("x", 6))


@query(
    """WITH n AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM embeddings)
SELECT vec_id, label, CAST(sum(CASE WHEN s < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM n"""
)
def chunk_semantic(spark, sf):
    return chunking.semantic_islands(table(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label", "island")


_CUT = r"(?:第[一二三四五六七八九十0-9]+[章节]|#|Kapitel |Chapter |Section |Часть )"


@query(
    f"""WITH l AS (SELECT doc_id AS id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE length(text) > 0),
m AS (SELECT *, sum(CASE WHEN regexp_matches(raw, '^{_CUT}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM l),
s AS (SELECT id, k, max(k) OVER (PARTITION BY id) AS most, string_agg(raw, chr(10) ORDER BY n) AS body, first(raw ORDER BY n) AS head, any_value(text) AS text FROM m GROUP BY id, k)
SELECT id, CAST(greatest(k - 1, 0) AS INTEGER) AS piece, CASE WHEN most = 0 THEN '' ELSE substring(regexp_replace(head, '^[{WS}]+|[{WS}]+$', '', 'g'), 1, 50) END AS title,
  CASE WHEN most = 0 THEN substring(text, 1, 5000) ELSE regexp_replace(body, '^[{WS}]+|[{WS}]+$', '', 'g') END AS content FROM s WHERE k > 0 OR most = 0"""
)
def chunk_regex_baseline(spark, sf):
    return chunking.sections_by_line(table(spark, sf, "documents"), "doc_id", "text", _CUT)


@query("SELECT doc_id AS id, CAST(o AS INTEGER) AS start, substring(text, CAST(o AS INTEGER) + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS o FROM documents WHERE length(text) > 0)")
def chunk_slices(spark, sf):
    return chunking.slices(table(spark, sf, "documents"), "doc_id", "text", F.lit(2000))


@query(
    f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE length(text) > 0),
h AS (SELECT id, raw, n, contains(raw, '##') OR contains(raw, '第') AS hit FROM l), k AS (SELECT *, sum(CASE WHEN hit AND n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k, bool_or(hit) OVER (PARTITION BY id) AS found FROM h),
c AS (SELECT id, CAST(min(n) AS INTEGER) AS start_line, substring(regexp_replace(string_agg(raw, chr(10) ORDER BY n), '^[{WS}]+|[{WS}]+$', '', 'g'), 1, 3000) AS content FROM k WHERE found GROUP BY id, k),
e AS (SELECT doc_id AS id, text, greatest(length(text) // 3, 1) AS w FROM documents WHERE length(text) > 0 AND NOT contains(text, '##') AND NOT contains(text, '第'))
SELECT id, start_line, content FROM c WHERE length(content) > 0 UNION ALL SELECT id, -1, substring(text, CAST(o AS INTEGER) + 1, CAST(w AS INTEGER)) FROM (SELECT *, unnest(range(0, length(text), w)) AS o FROM e)"""
)
def chunk_boundaries(spark, sf):
    markers = F.array(F.lit("##"), F.lit(""), F.lit("第"))
    return chunking.guided_chunks(table(spark, sf, "documents"), "doc_id", "text", markers).drop("piece").fillna(-1, ["start_line"])


_QUALITY = """(SELECT id, n, round(CAST(0.3 AS DOUBLE) * greatest(0.0, 1 - s / greatest(a, 1.0)) + CAST(0.3 AS DOUBLE) * least(1.0, z / t) + CAST(0.2 AS DOUBLE) * least(1.0, n / greatest(t / 1000, 1.0)) + CAST(0.2 AS DOUBLE) * greatest(0.0, 1 - i / n), 6) AS score
FROM (SELECT id, count(*) AS n, avg(length(content)) AS a, stddev_pop(length(content)) AS s, sum(length(content)) AS z, count(*) FILTER (length(content) < 100 OR length(content) > 5000) AS i, any_value(length(d.text)) AS t FROM {0} c JOIN documents d ON d.doc_id = c.id GROUP BY id))"""
_SLICES = "(SELECT doc_id AS id, substring(text, CAST(o AS INTEGER) + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS o FROM documents WHERE length(text) > 0))"


@query(f"SELECT count(*) AS n, round(avg(a.n), 6) AS chunks_a, round(avg(b.n), 6) AS chunks_b, round(avg(a.score), 6) AS score_a, round(avg(b.score), 6) AS score_b, count(*) FILTER (b.score > a.score) AS better, count(*) FILTER (b.score < a.score) AS worse, count(*) FILTER (b.score = a.score) AS equal FROM {_QUALITY.format(_FIXED)} a JOIN {_QUALITY.format(_SLICES)} b USING (id)")
def chunk_quality_compare(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("total"))
    of = lambda c: chunking.chunk_quality(c, sizes)
    return chunking.compared(of(chunking.fixed_chunks(docs, "doc_id", "text")), of(chunking.slices(docs, "doc_id", "text", F.lit(2000))))


@query("SELECT DISTINCT file_path FROM parse_results WHERE file_path IN (SELECT file_path FROM books)")
def existing_semi(spark, sf):
    books = table(spark, sf, "books").select("file_path").distinct()
    return table(spark, sf, "parse_results").select("file_path").distinct().join(books, "file_path", "left_semi")


_V = "row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {0})), 9) DESC, vec_id) AS r"


@query(f"WITH a AS (SELECT vec_id AS id, {_V.format(0)} FROM embeddings QUALIFY r <= 50), b AS (SELECT vec_id AS id, {_V.format(1)} FROM embeddings QUALIFY r <= 50) SELECT id, round(sum(CAST(1 AS DOUBLE) / (60 + r)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def rrf_fusion(spark, sf):
    e = table(spark, sf, "embeddings")
    second = [float(x) for x in e.where("vec_id = 1").select("embedding").first()[0]]
    legs = [retrieval.vector_search(e, "vec_id", "embedding", v).withColumn("score", F.round("score", 9)) for v in (_query_vector(e, "embedding"), second)]
    return retrieval.fuse(legs, 100).select("id", F.round("rrf", 9).alias("rrf"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 7) || ',' || (event_id % 5) WHEN 1 THEN '3,1' ELSE '' END AS indices FROM events")
def parse_indices(spark, sf):
    e = F.col("event_id")
    reply = F.when(e % 3 == 0, F.concat(F.lit("顺序如下：["), (e % 7).cast("string"), F.lit(", "), (e % 5).cast("string"), F.lit("]。"))).when(e % 3 == 1, F.lit("[3, 1]")).otherwise("没有")
    return table(spark, sf, "events").select("event_id", F.array_join(context.parsed_indices(reply).cast("array<string>"), ",").alias("indices"))


@query(
    _HYBRID + """, o AS (SELECT d.doc_id AS id, d.source, h.rrf, d.text, row_number() OVER (ORDER BY coalesce(d.source, ''), h.rrf DESC, CAST(d.doc_id AS VARCHAR)) AS number FROM hybrid h JOIN documents d ON d.doc_id = h.id),
b AS (SELECT id, number, '## 素材 [' || number || ']' || chr(10) || '**来源**：《' || coalesce(source, '未知书籍') || '》' || chr(10) || '**相关性**：' || printf('%.2f', rrf) || chr(10) || '**内容**：' || coalesce(text, '') || chr(10) AS block FROM o),
spending AS (SELECT *, sum(floor(1.5 * (length(block) - length(regexp_replace(block, '[\\x{4e00}-\\x{9fff}]', '', 'g'))) + 0.25 * length(regexp_replace(block, '[\\x{4e00}-\\x{9fff}]', '', 'g')))) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS spent FROM b)
SELECT CAST(id AS VARCHAR) AS id, CAST(number AS INTEGER) AS number, block, CAST(spent AS BIGINT) AS spent FROM spending WHERE spent <= 2000"""
)
def context_blocks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    of = _hybrid(spark, sf).drop("source").join(docs, "id")
    meta = F.struct(F.col("source").alias("book_id"), F.col("source").alias("book_title"), F.lit("").alias("heading"), F.lit(0).alias("start_char"))
    return context.context_blocks(of.select(F.col("id").cast("string").alias("id"), F.col("rrf").alias("score"), "content", meta.alias("metadata")), 2000)


@query("SELECT file_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM parse_results GROUP BY file_type")
def histograms(spark, sf):
    return store.counted(table(spark, sf, "parse_results"), "file_type")


@query(
    "SELECT CASE WHEN cn / greatest(n, 1) > 0.8 THEN '纯中文' WHEN cn / greatest(n, 1) > 0.3 THEN '中英混合' ELSE '英文/其他' END AS content_type, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars, round(avg(cn / greatest(n, 1)), 6) AS chinese_ratio, CAST(max(n) AS INTEGER) AS longest "
    "FROM (SELECT length(text) AS n, length(text) - length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', '', 'g')) AS cn FROM documents WHERE text IS NOT NULL) GROUP BY 1"
)
def dataset_analysis(spark, sf):
    t = F.col("text")
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(T.content_type(t).alias("content_type"), F.length(t).alias("n"), T.count_of(t, T.IDEOGRAPH).alias("cn"))
    ratio = F.col("cn") / F.greatest("n", F.lit(1))
    return rows.groupBy("content_type").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.round(F.avg(ratio), 6).alias("chinese_ratio"), F.max("n").alias("longest"))


@query("SELECT doc_id, 'utf-8' AS encoding, replace(text, chr(65279), '') AS text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 'utf-16', text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1")
def charset_decode(spark, sf):
    """Every document's bytes in one of two encodings, and back."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(F.replace(F.col("text"), F.lit("﻿"), F.lit("")), "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    got = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", decoded(raw).alias("d"))
    return got.select("doc_id", "d.encoding", "d.text")


_CN = "(length(text) - length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', '', 'g')))"


@query(f"SELECT doc_id, CAST(floor(1.5 * {_CN} + 0.25 * (length(text) - {_CN})) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(_HEADS + "SELECT level, count(*) AS n FROM h GROUP BY level")
def chapter_levels(spark, sf):
    return _heads(spark, sf).groupBy("level").agg(F.count("*").alias("n"))


@query(_HEADS + "SELECT id, count(*) AS n_chapters, CAST(sum(end_line - start_line) AS BIGINT) AS n_lines FROM h GROUP BY id")
def chapter_ranges(spark, sf):
    return _heads(spark, sf).groupBy("id").agg(F.count("*").alias("n_chapters"), F.sum(F.col("end_line") - F.col("start_line")).alias("n_lines"))


@query("SELECT doc_id, CAST(greatest(n_chars // 3, 500) AS BIGINT) AS section_words FROM documents")
def section_budget(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.greatest(F.floor(F.col("n_chars") / 3), F.lit(500)).alias("section_words"))


@query(f"SELECT id, translate(title, ' /', '__') AS name FROM {BOOKS}")
def safe_name(spark, sf):
    return books_of(spark, sf).select("id", T.safe_name(F.col("title")).alias("name"))


@query(
    f"SELECT size_bucket, count(*) AS n FROM (SELECT CASE WHEN total_chars < 102400 THEN '<100KB' WHEN total_chars < 512000 THEN '100-500KB' WHEN total_chars < 1048576 THEN '500KB-1MB' WHEN total_chars < 5242880 THEN '1-5MB' WHEN total_chars < 10485760 THEN '5-10MB' ELSE '>10MB' END AS size_bucket FROM {BOOKS}) GROUP BY size_bucket"
)
def size_bucket(spark, sf):
    return books_of(spark, sf).groupBy(T.size_bucket(F.col("total_chars")).alias("size_bucket")).agg(F.count("*").alias("n"))


@query("SELECT chunk_id, heading, CASE WHEN heading = '' THEN 'none' ELSE 'some' END AS kind FROM (SELECT chunk_id, coalesce(max(CASE WHEN len(heading_stack) > 0 THEN heading_stack[len(heading_stack)] END), '') AS heading FROM chunks GROUP BY chunk_id)")
def chunk_headings(spark, sf):
    innermost = F.max(F.when(F.size("heading_stack") > 0, F.try_element_at("heading_stack", F.lit(-1))))
    rows = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.coalesce(innermost, F.lit("")).alias("heading"))
    return rows.select("chunk_id", "heading", F.when(F.col("heading") == "", "none").otherwise("some").alias("kind"))
