"""Fixed windows, recursive splitting, greedy packing and the quality of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip


def _windows(text: Column, window: int, step: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda o: F.struct(o.alias("start"), F.substring(text, o + 1, F.lit(window)).alias("content")))


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, target: int = 512, overlap: int = 128) -> DataFrame:
    """(id, start, content): windows of twice the target in characters; none for an empty text."""
    if not 0 <= overlap < target:
        raise ValueError("overlap must be at least 0 and below target")
    rows = df.where(F.length(text_col) > 0)
    return rows.select(F.col(id_col).alias("id"), F.inline(_windows(F.col(text_col), 2 * target, 2 * (target - overlap))))


def recursive_chunks(df: DataFrame, id_col: str, text_col: str, target: int = 512, overlap: int = 128) -> DataFrame:
    """Texts above three targets become windows, others stay whole; windows are shorter than that, so one level is enough."""
    t = F.col(text_col)
    whole = F.array(F.struct(F.lit(0).alias("start"), t.alias("content")))
    rows = df.where(F.length(text_col) > 0)
    return rows.select(F.col(id_col).alias("id"), F.inline(F.when(F.length(t) > 3 * target, _windows(t, 2 * target, 2 * (target - overlap))).otherwise(whole)))


def packed_paragraphs(df: DataFrame, id_col: str, text_col: str, limit: int = 2000) -> DataFrame:
    """(id, piece, content): paragraphs joined greedily while they fit the limit."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))
    fits = lambda s, p: F.length(s["open"]) + F.length(p) + 1 <= limit
    step = lambda s, p: F.when(s["open"] == "", F.struct(p.alias("open"), s["done"].alias("done"))).when(fits(s, p), F.struct(F.concat(s["open"], F.lit("\n"), p).alias("open"), s["done"].alias("done"))).otherwise(F.struct(p.alias("open"), F.array_append(s["done"], s["open"]).alias("done")))
    end = lambda s: F.filter(F.array_append(s["done"], s["open"]), lambda x: x != "")
    return df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.posexplode(F.aggregate(F.split(text_col, "\n"), start, step, end)).alias("piece", "content"))


def chunk_quality(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per text: number and sizes of chunks, and a score. lengths: (id, total)."""
    n = F.length("content")
    per = chunks.groupBy("id").agg(F.count("*").alias("chunks_count"), F.avg(n).alias("avg_size"), F.stddev_pop(n).alias("std"), F.sum(n).alias("size"), F.count_if((n < 100) | (n > 5000)).alias("issues"))
    c = F.greatest(F.lit(0.0), 1 - F.col("std") / F.greatest("avg_size", F.lit(1.0)))
    cov = F.least(F.lit(1.0), F.col("size") / F.col("total"))
    many = F.least(F.lit(1.0), F.col("chunks_count") / F.greatest(F.col("total") / 1000, F.lit(1.0)))
    good = F.greatest(F.lit(0.0), 1 - F.col("issues") / F.col("chunks_count"))
    r = lambda x: F.round(x, 6)
    return per.join(lengths, "id").select("id", "chunks_count", r(F.col("avg_size")).alias("avg_size"), r(c).alias("consistency"), r(cov).alias("coverage"), r(0.3 * c + 0.3 * cov + 0.2 * many + 0.2 * good).alias("score"))


def with_stack(chunks: DataFrame, stacks: DataFrame) -> DataFrame:
    """Fixed or recursive chunks as stored ones: end_char, token_count (characters, as ever) and the heading stack of their text. stacks: (id, heading_stack)."""
    n = F.length("content")
    return chunks.join(stacks, "id", "left").withColumn("end_char", F.col("start") + n).withColumn("token_count", n)


def semantic_islands(df: DataFrame, group: str, order: str, vector_col: str, least: float = 0.5) -> DataFrame:
    """df with similarity (to the row before in its group) and island: a new one begins where it is below least."""
    from pyspark.sql import Window as W

    from quire.operators.retrieval import cosine

    w = W.partitionBy(group).orderBy(order)
    near = df.withColumn("similarity", cosine(F.col(vector_col), F.lag(vector_col).over(w)))
    return near.withColumn("island", F.sum(F.when(F.col("similarity") < least, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))


def semantic_chunks(df: DataFrame, id_col: str, text_col: str, embed, least: float = 0.5, longest: int = 512) -> DataFrame:
    """(id, piece, content, n_paragraphs): paragraphs joined while neighbours are similar. embed: a column of texts to a column of vectors."""
    parts = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("at", "paragraph"))
    rows = rows.withColumn("vector", embed(F.substring("paragraph", 1, longest)))
    of = semantic_islands(rows, "id", "at", "vector", least)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "paragraph"))), lambda x: x["paragraph"]), "\n\n")
    return of.groupBy("id", F.col("island").alias("piece")).agg(text.alias("content"), F.count("*").alias("n_paragraphs"))


def sections_by_line(df: DataFrame, id_col: str, text_col: str, pattern: str, fallback: int = 5000) -> DataFrame:
    """(id, piece, title, content): a plainer cut at every line that the pattern finds; else the first fallback characters."""
    mark = "￿"
    t = F.col(text_col)
    parts = F.split(F.regexp_replace(t, f"(?md)^(?={pattern})", mark), mark)
    titled = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(F.substring(strip(F.substring_index(x, "\n", 1)), 1, 50).alias("title"), strip(x).alias("content")))
    alone = F.array(F.struct(F.lit("").alias("title"), F.substring(t, 1, fallback).alias("content")))
    rows = df.where(F.length(t) > 0).select(F.col(id_col).alias("id"), F.when(F.size(parts) > 1, titled).otherwise(alone).alias("s"))
    return rows.select("id", F.posexplode("s").alias("piece", "s")).select("id", "piece", "s.title", "s.content")


def slices(df: DataFrame, id_col: str, text_col: str, size: Column) -> DataFrame:
    """(id, start, content): consecutive pieces of size characters."""
    t = F.col(text_col)
    cut = F.transform(F.sequence(F.lit(0), F.length(t) - 1, size), lambda o: F.struct(o.alias("start"), F.substring(t, o + 1, size).alias("content")))
    return df.where(F.length(t) > 0).select(F.col(id_col).alias("id"), F.inline(cut))


def guided_chunks(df: DataFrame, id_col: str, text_col: str, markers: Column, longest: int = 3000) -> DataFrame:
    """(id, piece, start_line, content): cuts before lines that hold one of the markers a model named; of a piece the first longest characters.

    Where no marker is found the text is cut into pieces of equal size, as many as markers, three at least."""
    lines = F.split(F.col(text_col), "\n")
    has = lambda x: F.exists(markers, lambda m: (m != "") & F.contains(x, m))
    rows = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), lines.alias("lines"), F.filter(F.transform(lines, lambda x, i: F.when(has(x), i)), lambda i: i.isNotNull()).alias("found"))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), "found", F.array(F.size("lines")))))
    rows = rows.withColumn("bounds", bounds)
    piece = lambda b, i: F.struct(b.alias("start_line"), F.substring(strip(F.array_join(F.slice("lines", b + 1, F.get(F.col("bounds"), i + 1) - b), "\n")), 1, longest).alias("content"))
    by_marker = F.filter(F.transform(F.slice("bounds", 1, F.size("bounds") - 1), piece), lambda x: F.length(x["content"]) > 0)
    n = F.greatest(F.floor(F.length("t") / F.greatest(F.size(markers), F.lit(3))), F.lit(1)).cast("int")
    equal = F.transform(F.sequence(F.lit(0), F.length("t") - 1, n), lambda o: F.struct(F.lit(None).cast("int").alias("start_line"), F.substring(F.col("t"), o + 1, n).alias("content")))
    return rows.select("id", F.posexplode(F.when(F.size("found") > 0, by_marker).otherwise(equal)).alias("piece", "p")).select("id", "piece", "p.start_line", "p.content")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how two ways of cutting do, from their chunk_quality rows joined by id."""
    both = a.select("id", F.col("chunks_count").alias("n_a"), F.col("score").alias("s_a")).join(b.select("id", F.col("chunks_count").alias("n_b"), F.col("score").alias("s_b")), "id")
    mean = lambda c: F.round(F.avg(c), 6)
    return both.agg(F.count("*").alias("n"), mean("n_a").alias("chunks_a"), mean("n_b").alias("chunks_b"), mean("s_a").alias("score_a"), mean("s_b").alias("score_b"), F.count_if(F.col("s_b") > F.col("s_a")).alias("better"), F.count_if(F.col("s_b") < F.col("s_a")).alias("worse"), F.count_if(F.col("s_b") == F.col("s_a")).alias("equal"))
