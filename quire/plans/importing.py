"""Import of files as one plan: decoding, structure, chunks, and the rows of every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import structure
from quire.operators.library import Library
from quire.session import written

LEAST = 10  # characters a text needs to be imported


def parsed(files: DataFrame) -> DataFrame:
    """files (path, size, file_hash, category, file_type, encoding, text) with id, title, language, summary and status.

    Lines are stripped and blank ones left out, as a text file's parser does; ids are hashes of the content, so a
    repeated import makes the same ones."""
    line = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: F.length(x) > 0)
    rows = files.withColumn("text", F.array_join(line, "\n"))
    named = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    status = F.when(~F.col("file_type").isin("txt", "pdf"), "unsupported").when(F.coalesce(F.length("text"), F.lit(0)) < LEAST, "too short").otherwise("imported")
    return rows.select(
        F.sha2(F.concat_ws("|", "file_hash", "path"), 256).alias("id"),
        "path", "size", "file_hash", "category", "file_type", "encoding", "text", status.alias("status"),
        F.coalesce(F.nullif(named, F.lit("")), T.title(F.col("text"))).alias("title"),
        T.language_label(F.col("text")).alias("language"),
        T.summary(F.col("text")).alias("summary"),
        F.round(F.col("size") / 1024, 1).alias("size_kb"),
    )


def chapters_of(books: DataFrame) -> DataFrame:
    """Rows of chapters: ids from book and place, parents by the nearest heading before of a lower level."""
    tree = structure.heading_tree(books, "id", "text").select(F.col("id").alias("book_id"), "start_line", "parent_line")
    heads = structure.headings(books, "id", "text").withColumnRenamed("id", "book_id")
    key = lambda line: F.when(line.isNotNull(), F.sha2(F.concat_ws("|", "book_id", line.cast("string")), 256))
    rows = heads.join(tree, ["book_id", "start_line"])
    after = F.lead("start_char").over(W.partitionBy("book_id").orderBy("start_line"))
    return rows.select(key(F.col("start_line")).alias("id"), "book_id", key(F.col("parent_line")).alias("parent_id"), "level", "title", F.col("start_char").cast("long").alias("start_char"), after.cast("long").alias("end_char"))


def chunks_of(books: DataFrame, limit: int = 1024, target: int = 512, overlap: int = 128) -> DataFrame:
    """Rows of chunks: a chunk per chapter, those above three targets in overlapping windows, with absolute offsets and heading stacks."""
    base = structure.chapter_chunks(books, "id", "text", limit)
    window, step = 2 * target, 2 * (target - overlap)
    c = F.col("content")
    whole = F.array(F.struct(F.lit(0).alias("from"), c.alias("content")))
    cut = F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(step)), lambda o: F.struct(o.alias("from"), F.substring(c, o + 1, F.lit(window)).alias("content")))
    pieces = F.when(F.length(c) > 3 * target, cut).otherwise(whole)
    rows = base.select(F.col("id").alias("book_id"), "struct_path", "start_char", "heading_stack", F.inline(pieces))
    start = (F.col("start_char") + F.col("from")).cast("long")
    return rows.select(F.sha2(F.concat_ws("|", "book_id", start.cast("string")), 256).alias("chunk_id"), "book_id", "content", "struct_path", start.alias("start_char"), (start + F.length("content")).alias("end_char"), "heading_stack")


def import_files(library: Library, files: DataFrame, vector: Column | None = None, skip_existing: bool = True, reindex: bool = False) -> DataFrame:
    """(status, n, chars): imports what isn't there yet; a re-import replaces.

    Files are (path, size, file_hash, category, file_type, encoding, text); of files with one content the first path counts."""
    from quire.operators.store import first_of

    once = first_of(files, "file_hash", F.col("path")).withColumnRenamed("path", "file_path")
    fresh, there = library.known(once, skip_existing, reindex)
    done, _ = written(parsed(fresh.withColumnRenamed("file_path", "path")), "import")
    good = done.where("status = 'imported'")
    if reindex:
        library.delete_books(good.select("id").join(library.table("books").select("id"), "id", "left_semi"))
    chunks, _ = written(chunks_of(good), "import")
    library.index_chunks(chunks, vector)
    library.add("chapters", chapters_of(good))
    per = chunks.groupBy("book_id").agg(F.count("*").alias("total_chunks"))
    books = good.join(per, good["id"] == per["book_id"], "left")
    library.add("books", books.select("id", "title", F.col("path").alias("file_path"), "category", "file_hash", "language", "summary", F.length("text").cast("long").alias("total_chars"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.current_timestamp().alias("created_at")))
    counted = done.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    skipped = there.agg(F.lit("skipped").alias("status"), F.count("*").alias("n"), F.lit(0).cast("long").alias("chars"))
    return counted.unionByName(skipped).where("n > 0")
