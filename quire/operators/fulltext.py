"""A stored full-text index: postings in buckets of their terms, so a query reads the buckets of its terms only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.session import dropped, small_side

BUCKETS = 64
POSTINGS = "id string, term string, positions array<int>, dl int, bucket int"
LENGTHS = "id string, dl int"


def shifted(positions: Column, n: int) -> Column:
    return F.transform(positions, lambda x: x - n)


class FullTextIndex:
    """Postings (term, id, positions, dl) and lengths (id, dl) below one path.

    Inserts append, and nothing checks whether an id is there already; a delete writes the id to a table of
    gone ids, which every read leaves out; ``compact`` rewrites the rest, and an insert of an id that is gone does so first. Ids are strings. A text without any
    term counts as one of length 0; a null text isn't indexed."""

    def __init__(self, spark: SparkSession, path: str, analyser=tokens, buckets: int = BUCKETS):
        self.spark, self.path, self.analyser, self.buckets = spark, path.rstrip("/"), analyser, buckets

    def _read(self, what: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def insert(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> FullTextIndex:
        rows = df.select(F.col(id_col).cast("string").alias("id"), self.analyser(F.col(text_col)).alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
        gone = self._read("gone", "id string")
        if rows.join(gone, "id", "left_semi").limit(1).count():  # an id that comes again must not stay gone
            self.compact()
        rows.select("id", F.size("t").alias("dl")).write.mode("append").parquet(f"{self.path}/lengths")
        words = rows.select("id", F.size("t").alias("dl"), F.posexplode("t").alias("at", "term"))
        # the terms of one text lie in one task, so this needs no shuffle beyond the bucketing
        posts = words.groupBy("id", "term", "dl").agg(F.array_sort(F.collect_list("at")).alias("positions"))
        posts = posts.select("id", "term", "positions", "dl", self._bucket(F.col("term")).alias("bucket"))
        posts.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        return self

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def delete(self, ids: DataFrame) -> FullTextIndex:
        ids.toDF("id").select(F.col("id").cast("string")).distinct().write.mode("append").parquet(f"{self.path}/gone")
        return self

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS).join(small_side(self._read("gone", "id string").distinct()), "id", "left_anti")

    def lengths(self) -> DataFrame:
        return self._read("lengths", LENGTHS).join(small_side(self._read("gone", "id string").distinct()), "id", "left_anti")

    def compact(self) -> FullTextIndex:
        """Rewrites the index without the ids that are gone."""
        new = f"{self.path}-{uuid.uuid4().hex}"
        self.lengths().write.parquet(f"{new}/lengths")
        self.postings().repartition("bucket").write.partitionBy("bucket").parquet(f"{new}/postings")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        dropped(self.spark, self.path)
        hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(hadoop(new), hadoop(self.path))
        return self

    def document_frequencies(self) -> DataFrame:
        """(term, df, cf): in how many texts each term occurs, and how often."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))

    def search(self, query: str, k: int | None = 50, where: DataFrame | None = None) -> DataFrame:
        """(id, score): texts that hold every term, by BM25; a term with inner signs is a phrase. where: the ids to keep.

        The filter applies before the top k; the figures of the corpus are those of all texts."""
        words = query.replace('"', " ").split()
        analysed = self.spark.range(1).select(F.array(*(self.analyser(F.lit(w)) for w in words)) if words else F.array()).first()[0]
        phrases = [list(p) for p in analysed if p]
        if not phrases:
            return self.spark.createDataFrame([], "id string, score double")
        terms = sorted({t for p in phrases for t in p})
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term"))).collect()]
        stats = self.lengths().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        read = self.postings().where(F.col("bucket").isin(*set(buckets)) & F.col("term").isin(*terms))
        at = {t: F.max(F.when(F.col("term") == t, F.col("positions"))) for t in terms}
        per = read.groupBy("id", "dl").agg(*(at[t].alias(f"p{i}") for i, t in enumerate(terms)))
        frequencies = []
        for phrase in phrases:
            first = F.col(f"p{terms.index(phrase[0])}")
            for n, t in enumerate(phrase[1:], 1):
                first = F.array_intersect(first, shifted(F.col(f"p{terms.index(t)}"), n))
            frequencies.append(F.coalesce(F.size(first), F.lit(0)))
        per = per.select("id", "dl", *(F.greatest(f, F.lit(0)).alias(f"f{i}") for i, f in enumerate(frequencies)))
        seen = per.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(phrases))))
        score, hit = F.lit(0.0), F.lit(True)
        for i in range(len(phrases)):
            f, d = F.col(f"f{i}"), F.col(f"d{i}")
            idf = F.log((F.col("n") - d + 0.5) / (d + 0.5))
            idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
            score = score + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
            hit = hit & (f > 0)
        found = per.where(hit)
        if where is not None:
            found = found.join(where.select(F.col(where.columns[0]).cast("string").alias("id")).distinct(), "id", "left_semi")
        found = found.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(seen)).select("id", score.alias("score"))  # one row each
        return found if k is None else found.orderBy(F.desc("score"), "id").limit(k)

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score, rank): the k best texts of each query, which hold all its tokens. queries: (query_id, query)."""
        asked = queries.select("query_id", F.array_distinct(self.analyser(F.col("query"))).alias("t"))
        each = asked.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term")).withColumn("bucket", self._bucket(F.col("term")))
        stats = self.lengths().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        used = self.postings().join(small_side(each.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
        df = used.groupBy("bucket", "term").agg(F.count("*").alias("d"))
        met = used.join(small_side(df), ["bucket", "term"]).join(small_side(each), ["bucket", "term"]).crossJoin(F.broadcast(stats))  # one row
        idf = F.log((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5))
        f = F.size("positions")
        part = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
        found = met.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("terms"), F.max("n_terms").alias("n_terms")).where("terms = n_terms")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
        return found.select("query_id", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def hits(found: DataFrame, chunks: DataFrame, books: DataFrame) -> DataFrame:
    """found with content and the metadata of the chunk and its book; hits without chunk or book drop out."""
    heading = F.coalesce(F.try_element_at("heading_stack", F.lit(-1)), F.lit(""))
    part = chunks.select(F.col("chunk_id").cast("string").alias("id"), "content", "book_id", "struct_path", heading.alias("heading"), "start_char", "end_char")
    of = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    whole = part.join(small_side(found), "id").join(small_side(of), "book_id")
    meta = F.struct("book_id", "book_title", "struct_path", "heading", "start_char", "end_char")
    return whole.select("id", "score", "content", meta.alias("metadata"))
