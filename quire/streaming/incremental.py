"""Incremental import: new files as a stream; a file whose content or path is known already is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.store import first_of, not_yet_imported
from quire.sources.files import decoded

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def import_stream(spark: SparkSession, source: str, books: str, checkpoint: str, glob: str = "*.txt"):
    """Starts a run over what is there now, appending (file_path, file_hash, size, encoding, text) to the table books.

    A batch that is repeated after a failure finds its own hashes in the table and adds nothing twice."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.col("path").alias("file_path"), F.md5("content").alias("file_hash"), F.col("length").alias("size"), decoded("content").alias("d"))
        rows = first_of(rows.select("file_path", "file_hash", "size", "d.encoding", "d.text"), "file_hash", F.col("file_path"))
        try:
            known = spark.read.parquet(books).select("file_path", "file_hash")
        except Exception as e:  # the first batch: there is no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "file_path string, file_hash string")
        not_yet_imported(rows, known, ["file_hash", "file_path"]).write.mode("append").parquet(books)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
