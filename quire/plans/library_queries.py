"""Queries over the library's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.models import embedding
from quire.operators import chunking, retrieval, store, structure
from quire.session import small_side, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL, which states its constants for itself.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SIGNS = "，。、；：？！“”‘’（）【】《》—…·.,;:?!''\"()\\[\\]{}"
CN = "(length({0}) - length(regexp_replace({0}, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')))".format
EN = "(length({0}) - length(regexp_replace({0}, '[A-Za-z]', '', 'g')))".format
STRIP = (lambda x: f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')")
BOOKS = "(SELECT id, min(title) AS title, min(category) AS category, min(file_hash) AS file_hash, min(created_at) AS created_at, min(file_path) AS file_path, min(total_chars) AS total_chars, min(total_chunks) AS total_chunks FROM books WHERE id IS NOT NULL GROUP BY id)"
CHUNKS = "(SELECT chunk_id, min(book_id) AS book_id, min(content) AS content, min(start_char) AS start_char FROM chunks GROUP BY chunk_id)"


def books_of(spark, sf):
    """One row per book."""
    cols = ["title", "category", "file_hash", "created_at", "file_path", "total_chars", "total_chunks"]
    return table(spark, sf, "books").where("id IS NOT NULL").groupBy("id").agg(*(F.min(c).alias(c) for c in cols))


def chunks_of(spark, sf):
    """One row per chunk."""
    return table(spark, sf, "chunks").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("book_id", "content", "start_char")))


@query(f"SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN '未知' WHEN {CN('text')} / length(text) > 0.8 THEN '中文' WHEN {CN('text')} / length(text) > 0.3 THEN '中英混合' WHEN {EN('text')} / length(text) > 0.3 THEN '英文' ELSE '其他' END AS language FROM documents")
def language_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.language_label(F.col("text")).alias("language"))


@query(f"SELECT doc_id, CASE WHEN {CN('text')} / greatest(length(text), 1) > 0.8 THEN '纯中文' WHEN {CN('text')} / greatest(length(text), 1) > 0.3 THEN '中英混合' ELSE '英文/其他' END AS content_type FROM documents")
def content_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_type(F.col("text")).alias("content_type"))


@query(f"SELECT doc_id, CAST({CN('text')} AS INTEGER) AS chinese, CAST({EN('text')} AS INTEGER) AS letters, CAST(length(text) - length(regexp_replace(text, '\\p{{Nd}}', '', 'g')) AS INTEGER) AS digits, CAST(length(text) - length(regexp_replace(text, '[{SIGNS}]', '', 'g')) AS INTEGER) AS punctuation, CAST(floor(1.5 * {CN('text')} + 0.25 * (length(text) - {CN('text')})) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def char_class_stats(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.count_of(t, T.IDEOGRAPH).alias("chinese"), T.count_of(t, "A-Za-z").alias("letters"), T.count_of(t, r"\p{Nd}").alias("digits"), T.count_of(t, T.PUNCTUATION).alias("punctuation"), T.token_estimate(t).alias("tokens"))


def _summary_sql(c):
    out = "CASE"
    for sign in ("'。'", "'！'", "'？'", "chr(10)"):
        h = f"substring({c}, 1, 500)"
        out += f" WHEN contains({h}, {sign}) THEN substring({STRIP(f'split_part({h}, {sign}, 1) || {sign} || substring(split_part({h}, {sign}, 2), 1, 100)')}, 1, 200)"
    return out + f" ELSE {STRIP(f'substring({c}, 1, 200)')} END"


@query(f"SELECT doc_id, {_summary_sql('text')} AS summary FROM documents")
def summary_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(f"SELECT doc_id, coalesce(list_filter(list_transform(string_split({STRIP('text')}, chr(10))[1:10], lambda x: regexp_replace(x, '^[#{WS}]+|[#{WS}]+$', '', 'g')), lambda x: length(x) > 0 AND length(x) < 50)[1], '未命名书籍') AS title FROM documents")
def title_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title(F.col("text")).alias("title"))


_UP = (lambda n: f"coalesce(string_split(file_path, '/')[len(string_split(file_path, '/')) - {n - 1}], '')")


@query(f"SELECT DISTINCT file_path, CASE WHEN {_UP(2)} NOT IN ('raw_books', 'books', 'data', '') THEN {_UP(2)} WHEN {_UP(3)} NOT IN ('raw_books', 'books', 'data', '') THEN {_UP(3)} ELSE '未分类' END AS category FROM parse_results WHERE file_path IS NOT NULL")
def category_infer(spark, sf):
    return table(spark, sf, "parse_results").where("file_path IS NOT NULL").select("file_path", T.category_of_path(F.col("file_path")).alias("category")).distinct()


@query(f"SELECT id, translate(title, ' /', '__') AS name, CASE WHEN total_chars < 102400 THEN '<100KB' WHEN total_chars < 512000 THEN '100-500KB' WHEN total_chars < 1048576 THEN '500KB-1MB' WHEN total_chars < 5242880 THEN '1-5MB' WHEN total_chars < 10485760 THEN '5-10MB' ELSE '>10MB' END AS size_bucket FROM {BOOKS}")
def safe_names_and_sizes(spark, sf):
    return books_of(spark, sf).select("id", T.safe_name(F.col("title")).alias("name"), T.size_bucket(F.col("total_chars")).alias("size_bucket"))


@query(f"SELECT doc_id, list_bool_or(list_transform(string_split(text, chr(10)), lambda x: contains(x, '|'))) AND contains(text, '---') AS has_table, list_bool_or(list_transform(string_split(text, chr(10))[1:100], lambda x: contains(x, '```') OR starts_with(x, '    '))) AS has_code, list_bool_or(list_transform(string_split(text, chr(10))[1:200], lambda x: regexp_matches(x, '^[{WS}]*([-*] |•)'))) AS has_list FROM documents WHERE text IS NOT NULL")
def content_markers(spark, sf):
    t = F.col("text")
    lines = F.split(t, "\n")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", (F.exists(lines, lambda x: F.contains(x, F.lit("|"))) & F.contains(t, F.lit("---"))).alias("has_table"), F.exists(F.slice(lines, 1, 100), lambda x: F.contains(x, F.lit("```")) | F.startswith(x, F.lit("    "))).alias("has_code"), F.exists(F.slice(lines, 1, 200), lambda x: x.rlike(f"^[{WS}]*([-*] |•)")).alias("has_list"))


_FIRST5 = "substring(x, 1, 5)"
_LINE_SQL = {
    "chapter": "contains(x, '第') AND (contains(x, '章') OR contains(x, '节'))",
    "number": f"regexp_matches(x, '^[{WS}]*\\p{{Nd}}') AND contains({_FIRST5}, '.')",
    "numeral": " OR ".join(f"contains({_FIRST5}, '{c}、')" for c in "一二三四五六七八九十"),
    "bracket": f"regexp_matches(x, '^[{WS}]*（') AND contains(substring(x, 1, 10), '）')",
}
_LINE_RULES = {
    "chapter": lambda x: x.rlike("第.*[章节]|[章节].*第"),
    "number": lambda x: x.rlike(rf"^[{T.SPACE}]*\p{{Nd}}") & x.rlike(r"^.{0,4}\."),
    "numeral": lambda x: x.rlike("^.{0,3}[一二三四五六七八九十]、"),
    "bracket": lambda x: x.rlike(f"^[{T.SPACE}]*（") & x.rlike("^.{0,9}）"),
}


@query(
    "SELECT doc_id, " + ", ".join(f"CAST(len(list_filter(string_split(text, chr(10)), lambda x: {p})) AS INTEGER) AS {k}" for k, p in _LINE_SQL.items())
    + ", CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, round(length(text) / len(string_split(text, chr(10))), 6) AS avg_line FROM documents WHERE text IS NOT NULL"
)
def line_patterns(spark, sf):
    lines = F.split("text", "\n")
    n = F.size(lines)
    counts = [F.size(F.filter(lines, rule)).alias(k) for k, rule in _LINE_RULES.items()]
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", *counts, n.alias("n_lines"), F.round(F.length("text") / n, 6).alias("avg_line"))


_LINES = f"(SELECT doc_id AS id, line_no - 1 AS line_no, raw, {STRIP('raw')} AS line, n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT id, CAST(line_no // 50 AS INTEGER) AS page, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM {_LINES} WHERE length(line) > 0 GROUP BY ALL")
def txt_lines_pages(spark, sf):
    return structure.pages(table(spark, sf, "documents"), "doc_id", "text")


_CN = "一二三四五六七八九十百千万"
_FORM = f"""CASE WHEN regexp_matches(line, '^第[{_CN}\\p{{Nd}}]+[部卷集]') THEN 0 WHEN regexp_matches(line, '^第[{_CN}\\p{{Nd}}]+[章回]') THEN 1
WHEN regexp_matches(line, '^第[{_CN}\\p{{Nd}}]+[节篇]') THEN 2 WHEN regexp_matches(line, '^(前言|序言|引言|绪论|附录|后记|跋|参考文献)') THEN 0
WHEN regexp_matches(line, '^\\p{{Nd}}+\\.\\p{{Nd}}+\\.') THEN 3 WHEN regexp_matches(line, '^\\p{{Nd}}+\\.') THEN 2 END"""
_LEVEL = f"""CASE WHEN regexp_matches(line, '^第[{_CN}\\p{{Nd}}]+[章节回部卷篇集]') THEN coalesce(form, 1)
WHEN regexp_matches(line, '^(Book|Chapter|Section|Part|Volume)[{WS}]+[\\p{{Nd}}IVXLC]+') THEN coalesce(form, 2)
WHEN regexp_matches(line, '^[{_CN}]+[、.{WS}]+[^\\n]') THEN coalesce(form, 2) WHEN regexp_matches(line, '^\\p{{Nd}}+(\\.\\p{{Nd}}+)*[.{WS}]+[^\\n]') THEN coalesce(form, 2)
WHEN regexp_matches(line, '^[（(][一二三四五六七八九十]+[）)]') THEN coalesce(form, 3)
WHEN regexp_matches(line, '^(Part|Chapter|Section)[{WS}]+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)') THEN coalesce(form, 2)
WHEN regexp_matches(line, '^(前言|序言|引言|绪论|绪言|导论|导言|附录|后记|跋|参考文献|参考书目|致谢|鸣谢)$') THEN coalesce(form, 1) END"""
_HEADS = f"""WITH l AS {_LINES}, f AS (SELECT *, {_FORM} AS form FROM l WHERE length(line) >= 3), v AS (SELECT *, {_LEVEL} AS level FROM f),
d AS (SELECT * FROM v WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, substring(line, 1, 30) ORDER BY line_no) = 1),
h AS (SELECT id, CAST(level AS INTEGER) AS level, substring(line, 1, 100) AS title, CAST(line_no AS INTEGER) AS start_line, CAST(coalesce(lead(line_no) OVER (PARTITION BY id ORDER BY line_no), n_lines) AS INTEGER) AS end_line FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_line) AS k, max(end_line) OVER (PARTITION BY id) AS stop FROM h)
"""


def _heads(spark, sf):
    return structure.headings(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text").drop("start_char")


def _tree(spark, sf):
    return structure.heading_tree(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text")


@query(_HEADS + "SELECT * FROM h")
def chapter_detect(spark, sf):
    return _heads(spark, sf)


@query(_HEADS + "SELECT id, level, title, start_line, CAST(coalesce(lead(start_line) OVER (PARTITION BY id ORDER BY start_line), stop) AS INTEGER) AS end_line FROM k WHERE k = 1 OR end_line - start_line >= 3")
def chapter_merge(spark, sf):
    return structure.merged(_heads(spark, sf))


@query(_HEADS + "SELECT id, start_line, level, coalesce((SELECT max(b.start_line) FROM h b WHERE b.id = h.id AND b.start_line < h.start_line AND b.level < h.level), -1) AS parent_line FROM h")
def chapter_tree(spark, sf):
    """parent_line is -1 under the root."""
    return _tree(spark, sf).drop("leaf").withColumn("parent_line", F.coalesce("parent_line", F.lit(-1)))


@query(_HEADS + ", t AS (SELECT id, start_line, (SELECT max(b.start_line) FROM h b WHERE b.id = h.id AND b.start_line < h.start_line AND b.level < h.level) AS parent_line FROM h) SELECT id, start_line FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.id = t.id AND c.parent_line = t.start_line)")
def chapter_leaves(spark, sf):
    return _tree(spark, sf).where("leaf").select("id", "start_line")


_OWN_LINES = """, m AS (SELECT l.id, l.line_no, l.raw, last_value(h.start_line IGNORE NULLS) OVER w AS start_line, max(h.start_line) OVER (PARTITION BY l.id) AS anyone,
  coalesce(sum(length(l.raw) + 1) OVER (PARTITION BY l.id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM l LEFT JOIN h ON h.id = l.id AND h.start_line = l.line_no WINDOW w AS (PARTITION BY l.id ORDER BY l.line_no ROWS UNBOUNDED PRECEDING)),
"""
_ABOVE = """, up AS (SELECT h.id, h.start_line, h.title, (SELECT string_agg(b.title, ' / ' ORDER BY b.start_line) FROM h b WHERE b.id = h.id AND b.start_line < h.start_line AND b.level < h.level
  AND NOT EXISTS (SELECT 1 FROM h c WHERE c.id = h.id AND c.start_line > b.start_line AND c.start_line < h.start_line AND c.level <= b.level)) AS above FROM h)
"""


@query(
    _HEADS + _ABOVE + _OWN_LINES
    + f"""c AS (SELECT id, CAST(coalesce(start_line, 0) AS INTEGER) AS start_line, {STRIP("string_agg(raw, chr(10) ORDER BY line_no)")} AS content,
  min(pos) AS start_char, min(pos) + sum(length(raw) + 1) - 1 AS end_char FROM m WHERE start_line IS NOT NULL OR anyone IS NULL GROUP BY id, coalesce(start_line, 0))
SELECT c.id, c.start_line, CASE WHEN up.title IS NOT NULL AND length(content) <= 1024 THEN c.id || '/' || up.title ELSE '' END AS struct_path, content,
  CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST(length(content) AS INTEGER) AS token_count,
  concat_ws(' / ', up.above, up.title) AS heading_stack FROM c LEFT JOIN up ON up.id = c.id AND up.start_line = c.start_line WHERE length(content) > 0"""
)
def chunk_structure(spark, sf):
    chunks = structure.chapter_chunks(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return chunks.withColumn("heading_stack", F.concat_ws(" / ", "heading_stack"))


_FIXED = "(SELECT doc_id AS id, CAST(o AS INTEGER) AS start, substring(text, CAST(o AS INTEGER) + 1, 1024) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 768)) AS o FROM documents WHERE length(text) > 0))"


@query(f"SELECT * FROM {_FIXED}")
def chunk_fixed(spark, sf):
    return chunking.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query(f"SELECT doc_id AS id, 0 AS start, text AS content FROM documents WHERE length(text) BETWEEN 1 AND 1536 UNION ALL SELECT f.* FROM {_FIXED} f JOIN documents d ON d.doc_id = f.id WHERE length(d.text) > 1536")
def chunk_recursive(spark, sf):
    return chunking.recursive_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunk_greedy_pack(spark, sf):
    return chunking.packed_paragraphs(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH p AS (SELECT id, count(*) AS chunks_count, avg(length(content)) AS a, stddev_pop(length(content)) AS s, sum(length(content)) AS z, count(*) FILTER (length(content) < 100 OR length(content) > 5000) AS i FROM {_FIXED} GROUP BY id),
q AS (SELECT p.*, greatest(0.0, 1 - s / greatest(a, 1.0)) AS c, least(1.0, z / length(d.text)) AS v, least(1.0, chunks_count / greatest(length(d.text) / 1000, 1.0)) AS m, greatest(0.0, 1 - i / chunks_count) AS g FROM p JOIN documents d ON d.doc_id = p.id)
SELECT id, chunks_count, round(a, 6) AS avg_size, round(c, 6) AS consistency, round(v, 6) AS coverage, round(CAST(0.3 AS DOUBLE) * c + CAST(0.3 AS DOUBLE) * v + CAST(0.2 AS DOUBLE) * m + CAST(0.2 AS DOUBLE) * g, 6) AS score FROM q""")
def chunk_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return chunking.chunk_quality(chunking.fixed_chunks(docs, "doc_id", "text"), docs.select(F.col("doc_id").alias("id"), F.length("text").alias("total")))


def _query_vector(df, vector):
    return [float(x) for x in df.orderBy(df.columns[0]).select(vector).first()[0]]


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.vector_search(e, "vec_id", "embedding", _query_vector(e, "embedding"), 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.vector_search(e, "vec_id", "embedding", _query_vector(e, "embedding"), 10, F.col("label") == 3).select("id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) > 0 AND list_bool_or(list_transform(embedding[1:10], lambda x: x <> 0))) AS nonzero FROM chunk_vectors")
def nonzero_vectors(spark, sf):
    some = F.exists(F.slice("embedding", 1, 10), lambda x: x != 0)
    return table(spark, sf, "chunk_vectors").agg(F.count("*").alias("n"), F.count_if(some).alias("nonzero"))


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_IDF = (lambda d: f"CASE WHEN ln((n - {d} + 0.5) / ({d} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - {d} + 0.5) / ({d} + 0.5)) END")
_BM = (lambda f, d: f"({_IDF(d)}) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / avgdl))")
_FTS = f"""WITH t AS (SELECT doc_id AS id, {_TOK} AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'pounds')) AS f0, len(list_filter(t, lambda x: x = 'tin')) AS f1 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM p),
fts AS (SELECT id, CAST({_BM('f0', 'd0')} + {_BM('f1', 'd1')} AS DOUBLE) AS score FROM p CROSS JOIN s WHERE f0 > 0 AND f1 > 0)
"""


def _fts(spark, sf, k=50):
    return retrieval.full_text(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text", "pounds tin", k)


@query(_FTS + "SELECT id, round(score, 6) AS score FROM fts ORDER BY fts.score DESC, id LIMIT 10")
def fts_and_topk(spark, sf):
    return _fts(spark, sf, 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id FROM (SELECT doc_id AS id, ' ' || array_to_string({_TOK}, '  ') || ' ' AS t FROM documents WHERE text IS NOT NULL) WHERE contains(t, ' iron  key ')")
def fts_phrase(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    return retrieval.full_text(docs, "doc_id", "text", "iron-key", None).select("id")


_HYBRID = _FTS + f""", vl AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 50),
fl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM fts QUALIFY r <= 50),
u AS (SELECT id, r, 0 AS leg FROM vl UNION ALL SELECT id, r, 1 FROM fl),
g AS (SELECT id, sum(CAST(1 AS DOUBLE) / (60 + r)) AS rrf, min(leg * 1000 + r) AS first, count(*) AS legs FROM u GROUP BY id),
hybrid AS (SELECT id, rrf, CASE WHEN legs > 1 THEN 'hybrid' WHEN first < 1000 THEN 'vector' ELSE 'fts' END AS source FROM g ORDER BY round(rrf, 12) DESC, first, id LIMIT 20)
"""


def _hybrid(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.fuse([retrieval.vector_search(e, "vec_id", "embedding", _query_vector(e, "embedding")), _fts(spark, sf)])


@query(_HYBRID + "SELECT id, round(rrf, 9) AS rrf, source FROM hybrid")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).select("id", F.round("rrf", 9).alias("rrf"), "source")


@query(_HYBRID + f", b AS (SELECT d.doc_id AS id, d.source, row_number() OVER (ORDER BY d.source, d.doc_id) AS block, sum(CAST(floor(1.5 * {CN('text')} + 0.25 * (length(text) - {CN('text')})) AS INTEGER)) OVER (ORDER BY d.source, d.doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM hybrid JOIN documents d ON d.doc_id = hybrid.id WHERE d.text IS NOT NULL) SELECT id, CAST(block AS INTEGER) AS block, CAST(spent AS BIGINT) AS spent FROM b WHERE spent <= 1200")
def context_budget(spark, sf):
    hits = _hybrid(spark, sf).join(table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("from")), "id")
    return retrieval.within_budget(hits, "text", ["from", "id"], 1200).select("id", "block", "spent")


@query("SELECT category, p, CAST(row_number() OVER (ORDER BY CASE p WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE p + 1000000 END) AS INTEGER) AS place FROM (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS p FROM category_targets)")
def rerank_reorder(spark, sf):
    c = table(spark, sf, "category_targets").select("category", (F.row_number().over(W.orderBy("category")) - 1).alias("p"))
    return retrieval.reordered(c, "p", [3, 0, 5, 3, -1, 99])


@query("SELECT event_id, CAST(json_extract(substring(r, strpos(r, '{'), length(r) - strpos(reverse(r), '}') + 2 - strpos(r, '{')), '$.k') AS INTEGER) AS k FROM (SELECT event_id, '结果如下：' || props || '。请确认。' AS r FROM events)")
def parse_json_response(spark, sf):
    r = F.concat(F.lit("结果如下："), F.col("props"), F.lit("。请确认。"))
    inner = F.substring(r, F.locate("{", r), F.length(r) - F.locate("}", F.reverse(r)) + 2 - F.locate("{", r))
    return table(spark, sf, "events").select("event_id", F.from_json(inner, "k int")["k"].alias("k"))


_THEMES = "(SELECT tag, count(DISTINCT t.chunk_id) AS hits FROM chunk_tags t WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = t.chunk_id) GROUP BY tag)"


def _themes(spark, sf):
    tags = table(spark, sf, "chunk_tags").distinct().join(table(spark, sf, "chunks").select("chunk_id"), "chunk_id", "left_semi")
    return tags.groupBy("tag").agg(F.count("*").alias("hits"))


@query(f"SELECT tag, hits, CASE WHEN hits >= 3 THEN 'adequate' ELSE 'insufficient' END AS coverage FROM {_THEMES}")
def coverage_by_theme(spark, sf):
    return _themes(spark, sf).withColumn("coverage", F.when(F.col("hits") >= 3, "adequate").otherwise("insufficient"))


@query(f"SELECT count(*) AS total, count(*) FILTER (hits >= 3) AS adequate, count(*) FILTER (hits < 3) AS insufficient, CASE WHEN count(*) FILTER (hits >= 3) >= 0.6 * count(*) THEN 'adequate' ELSE 'insufficient' END AS overall FROM {_THEMES}")
def coverage_summary(spark, sf):
    good = F.count_if(F.col("hits") >= 3)
    return _themes(spark, sf).agg(F.count("*").alias("total"), good.alias("adequate"), F.count_if(F.col("hits") < 3).alias("insufficient"), F.when(good >= 0.6 * F.count("*"), "adequate").otherwise("insufficient").alias("overall"))


@query("SELECT category AS topic, unnest([category, category || ' 定义 概念', category || ' 案例 例子']) AS query FROM category_targets")
def query_expansion(spark, sf):
    c = F.col("category")
    return table(spark, sf, "category_targets").select(c.alias("topic"), F.explode(F.array(c, F.concat(c, F.lit(" 定义 概念")), F.concat(c, F.lit(" 案例 例子")))).alias("query"))


@query(f"SELECT id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '^#{{1,3}}[{WS}]+', '') AS title FROM {_LINES} WHERE regexp_matches(line, '^#{{1,3}}[{WS}]+')")
def section_titles(spark, sf):
    lines = structure.lines(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text")
    mark = f"^#{{1,3}}[{WS}]+"
    return lines.where(F.col("line").rlike(mark)).select("id", "line_no", F.regexp_replace("line", mark, "").alias("title"))


@query("SELECT doc_id, CAST(length(translate(text, ' ' || chr(10), '')) AS INTEGER) AS words, CAST(greatest(length(text) // 3, 500) AS BIGINT) AS section_words FROM documents WHERE text IS NOT NULL")
def word_count(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.length(F.translate("text", " \n", "")).alias("words"), F.greatest(F.floor(F.length("text") / 3), F.lit(500)).alias("section_words"))


@query(f"SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {BOOKS} GROUP BY category")
def books_by_category(spark, sf):
    return store.counted(books_of(spark, sf), "category")


@query("SELECT encoding, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT lower(encoding) AS encoding FROM parse_results) GROUP BY encoding")
def encoding_histogram(spark, sf):
    return store.counted(table(spark, sf, "parse_results").select(F.lower("encoding").alias("encoding")), "encoding")


@query(f"SELECT count(*) AS n_books, count(*) FILTER (total_chars > 0) AS successful, count(*) FILTER (NOT coalesce(total_chars > 0, FALSE)) AS failed, CAST(sum(total_chars) AS BIGINT) AS chars, CAST(sum(total_chunks) AS BIGINT) AS chunks, round(avg(total_chunks), 6) AS avg_chunks FROM {BOOKS}")
def build_summary(spark, sf):
    b = books_of(spark, sf)
    ok = F.coalesce(F.col("total_chars") > 0, F.lit(False))
    return b.agg(F.count("*").alias("n_books"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.sum("total_chars").alias("chars"), F.sum("total_chunks").alias("chunks"), F.round(F.avg("total_chunks"), 6).alias("avg_chunks"))


@query(f"SELECT id, file_hash FROM {BOOKS} QUALIFY file_hash IS NULL OR row_number() OVER (PARTITION BY file_hash ORDER BY created_at NULLS FIRST, id) = 1")
def dedup_by_hash(spark, sf):
    return store.first_of(books_of(spark, sf), "file_hash", F.col("created_at").asc_nulls_first(), F.col("id")).select("id", "file_hash")


@query("SELECT DISTINCT file_path FROM parse_results p WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM books b WHERE b.file_path = p.file_path)")
def skip_existing_anti(spark, sf):
    return store.not_yet_imported(table(spark, sf, "parse_results").where("file_path IS NOT NULL").select("file_path").distinct(), table(spark, sf, "books"), ["file_path"])


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunk_tags WHERE tag = '夜行')")
def chunks_by_tag(spark, sf):
    tags = table(spark, sf, "chunk_tags").where(F.col("tag") == "夜行").select("chunk_id")
    return table(spark, sf, "chunks").select("chunk_id").distinct().join(tags, "chunk_id", "left_semi")


@query("SELECT chunk_id, tag FROM chunk_tags UNION SELECT chunk_id, '长文' FROM chunks WHERE length(content) > 1024")
def tag_upsert(spark, sf):
    new = table(spark, sf, "chunks").where(F.length("content") > 1024).select("chunk_id", F.lit("长文").alias("tag"))
    return store.upserted(table(spark, sf, "chunk_tags"), new)


@query(f"WITH gone AS (SELECT id FROM {BOOKS} WHERE category IS NULL), c AS (SELECT * FROM {CHUNKS}), left_ AS (SELECT chunk_id FROM c WHERE book_id IS NULL OR book_id NOT IN (SELECT id FROM gone)), dead AS (SELECT chunk_id FROM c WHERE book_id IN (SELECT id FROM gone)) SELECT 'chunks' AS tab, count(*) AS n FROM left_ UNION ALL SELECT 'tags', count(*) FROM (SELECT DISTINCT chunk_id, tag FROM chunk_tags) WHERE chunk_id NOT IN (SELECT chunk_id FROM dead)")
def delete_cascade(spark, sf):
    """Chunks and tags left when the books without a category are deleted."""
    gone = books_of(spark, sf).where("category IS NULL").select("id")
    chunks = chunks_of(spark, sf).select("chunk_id", "book_id")
    left = store.without(chunks, "book_id", gone)
    dead = chunks.join(small_side(gone.toDF("book_id")), "book_id", "left_semi").select("chunk_id")
    tags = store.without(table(spark, sf, "chunk_tags").distinct(), "chunk_id", dead)
    return left.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("tab"), "n").unionByName(tags.agg(F.count("*").alias("n")).select(F.lit("tags").alias("tab"), "n"))


@query(f"SELECT chunk_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY start_char NULLS FIRST, chunk_id) AS INTEGER) AS place FROM {CHUNKS}")
def chunks_by_book(spark, sf):
    return chunks_of(spark, sf).select("chunk_id", F.row_number().over(W.partitionBy("book_id").orderBy("start_char", "chunk_id")).alias("place"))


@query(f"SELECT id, created_at FROM {BOOKS} ")
def books_recent(spark, sf):
    return books_of(spark, sf).orderBy(F.col("created_at").desc_nulls_last(), "id").select("id", "created_at")


@query(f"SELECT id, category FROM {BOOKS} QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('42' || id), id) <= 2")
def stratified_sample(spark, sf):
    return store.sample_per_group(books_of(spark, sf), "category", "id", 2).select("id", "category")


@query()
def embed_text(spark, sf):
    """A vector of every chunk's whole text."""
    return table(spark, sf, "chunks").select("chunk_id", F.transform(embedding(F.col("content")), lambda x: F.round(x, 5)).cast("string").alias("vector"))
