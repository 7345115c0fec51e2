"""Files as sources: text of unknown encoding, PDF where a library for it is there, folders as categories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import category_of_path
from quire.sources.charset import SAME, detect

def decode_bytes(raw: bytes | None) -> tuple[str, str]:
    """(encoding, text): by the detected encoding; what is wrong in it becomes a replacement character."""
    raw = raw or b""
    name = detect(raw)
    text = raw.decode("utf-16" if name == "utf-16" else name, "replace").removeprefix("\ufeff")
    return SAME.get(name, name), text


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(x) for x in raw], columns=["encoding", "text"])


def read_files(spark: SparkSession, path: str | list[str], glob: str = "*.{txt,TXT}") -> DataFrame:
    """(path, size, file_hash, category, file_type, encoding, text) of every text file below path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = raw.select("path", F.col("length").alias("size"), F.md5("content").alias("file_hash"), category_of_path(F.col("path")).alias("category"), kind.alias("file_type"), decoded("content").alias("d"))
    return rows.select("path", "size", "file_hash", "category", "file_type", "d.encoding", "d.text")


def list_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("txt", "pdf", "doc", "docx", "epub", "mobi")) -> DataFrame:
    """(path, size, category, file_type): metadata only; the contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return raw.select("path", "size", category_of_path(F.col("path")).alias("category"), kind.alias("file_type")).where(F.col("file_type").isin(*kinds))


def read_pdf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, page, text) of PDF files. Needs PyMuPDF, which is optional."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF (module fitz)") from e

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            rows = [(p, i, page.get_text()) for p, c in zip(b["path"], b["content"]) for i, page in enumerate(fitz.open(stream=c, filetype="pdf"))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInPandas(pages, "path string, page int, text string")


SUPPORTED = ("txt", "pdf")


def library_files(spark: SparkSession, root: str, category: str | None = None) -> DataFrame:
    """(path, size, category, file_type, supported): files below a root whose folders are the categories.

    With one folder or none below it, the root itself is the category. A category given keeps only its files."""
    files = list_files(spark, root)
    below = F.substring_index(F.col("path"), root.rstrip("/").split("/")[-1] + "/", -1)
    files = files.withColumn("folder", F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)))
    several = files.agg(F.count_distinct("folder").alias("n"))
    own = F.lit(root.rstrip("/").split("/")[-1])
    named = files.crossJoin(F.broadcast(several)).withColumn("category", F.when((F.col("n") > 1) & F.col("folder").isNotNull(), F.col("folder")).otherwise(own))  # one row
    out = named.select("path", "size", "category", "file_type", F.col("file_type").isin(*SUPPORTED).alias("supported"))
    return out if category is None else out.where(F.col("category") == category)


def folder_summary(spark: SparkSession, root: str) -> DataFrame:
    """(category, n_files, n_text, n_bytes): metadata only."""
    per = library_files(spark, root).groupBy("category")
    return per.agg(F.count("*").alias("n_files"), F.count_if(F.col("file_type") == "txt").alias("n_text"), F.sum("size").alias("n_bytes"))


def heads(spark: SparkSession, path: str, n: int = 3, chars: int = 5000) -> DataFrame:
    """(category, path, encoding, head, markers): the beginnings of the first n text files of each category, and the chapter marks in them."""
    rows = read_files(spark, path)
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy("path"))).where(F.col("k") <= n)
    head = F.substring("text", 1, chars)
    return first.select("category", "path", "encoding", head.alias("head"), F.regexp_extract_all(head, F.lit("(第[^\n]{1,10}?[章篇节部])"), 1).alias("markers"))


def read_pdf_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, page, text, font_size, font_name, is_bold, bbox): the lines of PDF files with the font of their first span. Needs PyMuPDF, which is optional."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF (module fitz)") from e

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                for number, page in enumerate(fitz.open(stream=content, filetype="pdf")):
                    for part in page.get_text("dict")["blocks"]:
                        for line in part.get("lines", ()) if part.get("type") == 0 else ():
                            spans = line["spans"]
                            text = "".join(s["text"] for s in spans)
                            if text.strip():
                                rows.append((p, number, text, float(spans[0]["size"]), spans[0]["font"], "bold" in spans[0]["font"].lower(), [float(x) for x in line["bbox"]]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "font_size", "font_name", "is_bold", "bbox"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInPandas(lines, "path string, page int, text string, font_size double, font_name string, is_bold boolean, bbox array<double>")
