"""Queries of problems 2 to 10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm.cut_off import cut_off, cut_share
from quire.llm.language import labelled_sample, mixed_languages, owner_languages, segments
from quire.llm.leaks import leaks
from quire.llm.mojibake import repair_encoding
from quire.llm.quota_sample import sample_to_targets
from quire.llm.same_look import same_look, same_look_classes, same_look_pairs
from quire.llm.similar import close_pairs, neighbours
from quire.llm.split_tree import split_oversized
from quire.llm.token_ids import token_ids


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark, sf):
    books = same_look_pairs(table(spark, sf, "books"), "id", "title").select(F.lit("books").alias("tab"), "id_a", "id_b")
    return books.unionByName(same_look_pairs(table(spark, sf, "chunks"), "chunk_id", "content").select(F.lit("chunks").alias("tab"), "id_a", "id_b"))


def p2_texts(spark, sf):
    """The consistent form of every text of both tables."""
    books = table(spark, sf, "books").select(F.lit("books").alias("tab"), "id", F.col("title").alias("text"))
    chunks = table(spark, sf, "chunks").select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return same_look(books.unionByName(chunks), "text").select("tab", "id", "same_look")


def p2_classes(spark, sf):
    """The same as p2_found with a row for each id: its class of texts that look alike."""
    books = same_look_classes(table(spark, sf, "books"), "id", "title").select(F.lit("books").alias("tab"), "id", "class_id", "n_texts", "n_ids")
    return books.unionByName(same_look_classes(table(spark, sf, "chunks"), "chunk_id", "content").select(F.lit("chunks").alias("tab"), "id", "class_id", "n_texts", "n_ids"))


def _sampled(spark, sf):
    return sample_to_targets(table(spark, sf, "books"), table(spark, sf, "category_targets"))


def p3_found(spark, sf):
    return _sampled(spark, sf)[1].where("sampled < quota").select("category")


def p3_sample(spark, sf):
    return _sampled(spark, sf)[0]


def p3_report(spark, sf):
    return _sampled(spark, sf)[1]


def p4_found(spark, sf):
    """No pair lies between 0.935 and 0.958, so rounding of a similarity can't matter at 0.95."""
    return close_pairs(table(spark, sf, "chunk_vectors"), "chunk_id", "embedding")


def p4_neighbours(spark, sf):
    return neighbours(table(spark, sf, "chunk_vectors"), "chunk_id", "embedding")


def _pieces(spark, sf):
    return split_oversized(table(spark, sf, "chunks"), table(spark, sf, "chapters"))


def p5_found(spark, sf):
    """Chapter cuts the splitter made; -1 for an oversized chunk without one."""
    cut = F.when(F.col("kind") == "chapter", F.col("abs_start") + F.col("cut") - F.col("start"))
    rows = _pieces(spark, sf).select("chunk_id", cut.alias("cut_char"))
    every = rows.groupBy("chunk_id").agg(F.collect_set("cut_char").alias("cuts"))
    return every.select("chunk_id", F.explode(F.when(F.size("cuts") > 0, F.col("cuts")).otherwise(F.array(F.lit(-1).cast("long")))).alias("cut_char"))


def p5_pieces(spark, sf):
    return _pieces(spark, sf).withColumn("heading_stack", F.array_join("heading_stack", " / "))


def _segments(spark, sf):
    return segments(table(spark, sf, "chunks"), labelled_sample(table(spark, sf, "documents"), "doc_id", "text", "lang"), "chunk_id", "content", "book_id")


#: What the labels of books say; any other label of a language says none of these.
LABELS = {"中文": "zh", "英文": "en", "中英混合": "zh+en", "其他": "other"}


def p6_found(spark, sf):
    from quire.session import written

    seg, _ = written(_segments(spark, sf), "language")
    said = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.regexp_replace("language", r"(?U)^\s+|\s+$", "")]
    books = table(spark, sf, "books").where(F.col("id").isNotNull()).groupBy("id").agg(F.max(said).alias("said"))
    means = F.when(F.col("lang").isin("zh", "en", "zh+en"), F.col("lang")).otherwise(F.lit("other"))
    found = books.join(owner_languages(seg), F.col("id") == F.col("owner")).where(F.col("said").isNull() | (F.col("said") != means))
    chunks = mixed_languages(seg)
    return found.select(F.lit("books").alias("tab"), "id", "lang").unionByName(chunks.select(F.lit("chunks").alias("tab"), "id", "lang"))


def p6_segments(spark, sf):
    return _segments(spark, sf).select(F.col("id").alias("chunk_id"), "start", "end", "lang", F.round("confidence", 4).alias("confidence"))


def p7_found(spark, sf):
    return repair_encoding(table(spark, sf, "chunks"), "chunk_id", "content").where("affected").select(F.col("id").alias("chunk_id")).distinct()


def p7_restored(spark, sf):
    return repair_encoding(table(spark, sf, "chunks"), "chunk_id", "content").where("affected").distinct()


def p8_ids(spark, sf):
    return token_ids(table(spark, sf, "documents").select("doc_id", "text"))


def p9_found(spark, sf):
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p10_found(spark, sf):
    return cut_off(table(spark, sf, "documents")).where("is_cut").select("doc_id")


def p10_sources(spark, sf):
    return cut_share(cut_off(table(spark, sf, "documents")))


def p5_sizes(spark, sf):
    """Of each oversized chunk: the longest piece, the first and last offset, and how many characters the pieces' own parts have together."""
    rows = _pieces(spark, sf).distinct().groupBy("chunk_id", (F.col("abs_start") - F.col("start")).alias("start_char"))
    own = F.sum(F.col("end") - F.col("cut"))
    return rows.agg((F.max(F.col("end") - F.col("start")) <= 1024).alias("within"), F.min("start").alias("first"), F.max("end").alias("last"), own.alias("own"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}

_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM = f"regexp_replace(category, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_QUOTA = f"""WITH b AS (SELECT id, min({_TRIM}) AS category FROM books WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT count(*) // 5 AS n FROM b), a AS (SELECT category, count(*) AS available FROM b GROUP BY category),
q AS (SELECT t.category, coalesce(a.available, 0) AS available, greatest((n.n * t.share_bp + 9999) // 10000, t.min_books) AS quota
  FROM category_targets t CROSS JOIN n LEFT JOIN a ON a.category = t.category)
"""
SQL = {
    "p3_found": _QUOTA + "SELECT category FROM q WHERE available < quota",
    "p3_report": _QUOTA + "SELECT category, CAST(available AS BIGINT) AS available, CAST(quota AS BIGINT) AS quota, CAST(least(available, quota) AS BIGINT) AS sampled, CAST(least(available, quota) - quota AS BIGINT) AS residual FROM q",
    "p5_found": """WITH c AS (SELECT DISTINCT chunk_id, book_id, start_char, length(content) AS n FROM chunks WHERE length(content) > 1024),
k AS (SELECT DISTINCT c.chunk_id, h.start_char AS cut_char FROM c JOIN chapters h ON h.book_id = c.book_id AND h.start_char > c.start_char AND h.start_char < c.start_char + c.n)
SELECT chunk_id, cut_char FROM k UNION ALL SELECT DISTINCT chunk_id, CAST(-1 AS BIGINT) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM k)""",
    "p5_sizes": "SELECT DISTINCT chunk_id, start_char, TRUE AS within, CAST(0 AS BIGINT) AS first, CAST(length(content) AS BIGINT) AS last, CAST(length(content) AS BIGINT) AS own FROM chunks WHERE length(content) > 1024",
}
