"""The library's tables below one path: schema, migration, inserts, look-ups, deletes that reach every dependent table, vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.fulltext import FullTextIndex
from quire.operators.store import not_yet_imported, upserted
from quire.session import dropped, small_side

SCHEMAS = {
    "books": "id string, title string, author string, file_path string, category string, file_hash string, language string, summary string, total_chars long, total_chunks long, embedding_model string, created_at timestamp",
    "chapters": "id string, book_id string, parent_id string, level int, title string, start_char long, end_char long, summary string, chunk_ids array<string>",
    "chunks": "chunk_id string, book_id string, content string, struct_path string, start_char long, end_char long, heading_stack array<string>",
    "chunk_tags": "chunk_id string, tag string",
    "chunk_vectors": "chunk_id string, book_id string, token_count int, embedding array<float>",
}
# What a column of a new row holds where it is left out.
DEFAULTS = {"author": "''", "category": "''", "file_hash": "''", "language": "'中文'", "summary": "''", "total_chars": "0L", "total_chunks": "0L", "embedding_model": "'bge-m3'", "level": "1", "start_char": "0L", "end_char": "0L", "struct_path": "''"}


def completed(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of the schema: what is missing gets its default, what is unknown is left out."""
    fields = T._parse_datatype_string(schema).fields
    value = lambda f: F.col(f.name) if f.name in df.columns else F.expr(DEFAULTS.get(f.name, "null"))
    return df.select(*(value(f).cast(f.dataType).alias(f.name) for f in fields))


class Library:
    """Each table is a folder of versions; a small file names the current one, so a rewrite is seen at once or not at all."""

    def __init__(self, spark: SparkSession, path: str, index_buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = FullTextIndex(spark, f"{self.path}/fulltext", buckets=index_buckets)

    # Files by way of the cluster's file system.
    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, folder = self._fs(f"{self.path}/{name}")
        if not fs.exists(folder):
            return None
        marks = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("_current-"))
        return f"{self.path}/{name}/{marks[-1].split('-', 2)[2]}" if marks else None

    def _switch(self, name: str, version: str) -> None:
        fs, folder = self._fs(f"{self.path}/{name}")
        old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("_current-")]
        number = max((int(p.getName().split("-", 2)[1]) for p in old), default=0) + 1
        fs.create(self._fs(f"{self.path}/{name}/_current-{number:012}-{version}")[1]).close()
        for p in old:
            fs.delete(p, False)

    def table(self, name: str) -> DataFrame:
        """A table as it is now; columns that came with a later schema are filled for older files."""
        at = self._current(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return completed(self.spark.read.option("mergeSchema", "true").parquet(at), SCHEMAS[name])

    def missing_columns(self, name: str) -> list[str]:
        """Columns of the schema that the stored files lack."""
        at = self._current(name)
        stored = set(self.spark.read.option("mergeSchema", "true").parquet(at).columns) if at else set()
        return [f.name for f in T._parse_datatype_string(SCHEMAS[name]).fields if f.name not in stored] if at else []

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends rows. One write is seen whole or not at all."""
        at = self._current(name)
        if at is None:
            version = f"v{uuid.uuid4().hex}"
            completed(rows, SCHEMAS[name]).write.parquet(f"{self.path}/{name}/{version}")
            self._switch(name, version)
        else:
            completed(rows, SCHEMAS[name]).write.mode("append").parquet(at)

    def rewrite(self, name: str, rows: DataFrame) -> None:
        old, version = self._current(name), f"v{uuid.uuid4().hex}"
        completed(rows, SCHEMAS[name]).write.parquet(f"{self.path}/{name}/{version}")
        self._switch(name, version)
        if old:
            dropped(self.spark, old)

    def add_tags(self, tags: DataFrame) -> None:
        """Insert or ignore."""
        known = self.table("chunk_tags")
        new = tags.select("chunk_id", "tag").distinct().join(known, ["chunk_id", "tag"], "left_anti")
        self.add("chunk_tags", new)

    # Look-ups.
    def get(self, name: str, key: str, value) -> DataFrame:
        """At most one row."""
        return self.table(name).where(F.col(key) == F.lit(value)).limit(1)

    def of_book(self, name: str, book_id: str) -> DataFrame:
        return self.table(name).where(F.col("book_id") == book_id).orderBy("start_char", self.table(name).columns[0])

    def books(self) -> DataFrame:
        """All books, the newest first."""
        return self.table("books").orderBy(F.col("created_at").desc_nulls_last(), "id")

    def by_tag(self, tag: str) -> DataFrame:
        tagged = self.table("chunk_tags").where(F.col("tag") == tag).select("chunk_id").distinct()
        return self.table("chunks").join(small_side(tagged), "chunk_id", "left_semi")

    def known(self, files: DataFrame, skip_existing: bool = True, reindex: bool = False) -> tuple[DataFrame, DataFrame]:
        """(new files, files whose content or path is there): by hash, then by path; a re-index takes all."""
        if reindex and not skip_existing:
            return files, files.limit(0)
        fresh = not_yet_imported(files, self.table("books"), ["file_hash", "file_path"])
        return fresh, files.join(fresh.select("file_path"), "file_path", "left_anti")

    # Chunks go to three places.
    def index_chunks(self, chunks: DataFrame, vector: Column | None = None) -> DataFrame:
        """Adds chunks to the table, the full-text index and the vectors; blank ones are left out. Without vector, a vector is null until a re-index."""
        some = chunks.where(F.length(F.trim("content")) > 0)
        self.add("chunks", some)
        self.index.insert(some.select("chunk_id", "content"))
        v = F.lit(None).cast("array<float>") if vector is None else vector
        self.add("chunk_vectors", some.select("chunk_id", "book_id", F.length("content").alias("token_count"), v.alias("embedding")))
        return some

    def reindex_vectors(self, vector: Column, book_id: str | None = None, skip_existing: bool = True) -> int:
        """Computes the vectors that are null or zero (or all) of a book, or of every book; gives how many."""
        old = self.table("chunk_vectors")
        zero = F.col("embedding").isNull() | ~F.exists("embedding", lambda x: x != 0)
        due = old if book_id is None else old.where(F.col("book_id") == book_id)
        due = due.where(zero) if skip_existing else due
        due = due.select("chunk_id").distinct()
        text = self.table("chunks").join(due, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
        done = text.select("chunk_id", "book_id", F.length("content").alias("token_count"), vector.alias("embedding"))
        n = due.count()
        self.rewrite("chunk_vectors", old.join(due, "chunk_id", "left_anti").unionByName(done))
        return n

    def delete_books(self, ids: DataFrame) -> None:
        """Removes books with their vectors, postings, tags, chunks and chapters, in that order, the books last."""
        gone = ids.toDF("book_id").distinct()
        chunks = self.table("chunks")
        dead = chunks.join(small_side(gone), "book_id", "left_semi").select("chunk_id").distinct()
        self.index.delete(dead)
        for name, key, of in (("chunk_vectors", "chunk_id", dead), ("chunk_tags", "chunk_id", dead), ("chunks", "book_id", gone), ("chapters", "book_id", gone), ("books", "id", gone)):
            if self._current(name):
                self.rewrite(name, self.table(name).join(of.toDF(key), key, "left_anti"))

    def replace_tags(self, tags: DataFrame) -> None:
        self.rewrite("chunk_tags", upserted(self.table("chunk_tags"), tags.select("chunk_id", "tag")))
