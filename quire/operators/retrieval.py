"""Full-text search with BM25 over texts as they are, exact vector search, rank fusion, reordering and budgeted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import token_estimate, tokens

RRF_K = 60


def full_text(df: DataFrame, id_col: str, text_col: str, query: str, k: int | None = 50, analyser=tokens) -> DataFrame:
    """(id, score): texts that hold every term (a term with inner signs is a phrase), by BM25.

    One pass without exploding: per text its length and the frequency of each term; the corpus figures are one
    row. An empty query gives no rows; quotes in it are dropped. Without k all hits come, in no order."""
    words = query.replace('"', " ").split()
    t = analyser(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), t.alias("t"))
    line = F.concat(F.lit(" "), F.array_join("t", "  "), F.lit(" "))
    phrases = [analyser(F.lit(w)) for w in words]
    tf = [F.size(F.split(line, F.concat(F.lit("\\Q "), F.array_join(p, "  "), F.lit(" \\E")))) - 1 for p in phrases]
    per = rows.select("id", F.size("t").alias("dl"), *(x.alias(f"tf{i}") for i, x in enumerate(tf)))
    stats = per.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    score: Column = F.lit(0.0)
    hit: Column = F.lit(bool(words))
    for i in range(len(words)):
        f, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
        hit = hit & (f > 0)
    found = per.where(hit).crossJoin(F.broadcast(stats))  # one row
    scored = found.select("id", score.alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def vector_search(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = 50, where: Column | None = None) -> DataFrame:
    """(id, score): the k most similar vectors; the filter applies before."""
    rows = df if where is None else df.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


QUERIES, ROWS = 2_048, 32_768  # vectors of a block in the search for many queries


def _scan_block(k: int, dim: int):
    import numpy as np
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        asked, rows = (table.filter(table["is_query"] if q else pa.compute.invert(table["is_query"])) for q in (True, False))
        x, y = (np.asarray(t["vector"].combine_chunks().flatten(), np.float64).reshape(-1, dim) for t in (asked, rows))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        score = x @ y.T
        m = min(k + 1, len(y))  # the query itself may be among them
        top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m else np.zeros((len(x), 0), np.int64)
        return pa.table({"query_id": asked["id"].take(np.repeat(np.arange(len(x)), m)), "id": rows["id"].take(top.ravel()), "score": np.take_along_axis(score, top, 1).ravel()})

    return run


def vector_search_batch(df: DataFrame, id_col: str, vector_col: str, queries: Column, dim: int, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the k rows most similar to each row that queries selects, itself not among them.

    Exact: blocks of queries meet blocks of rows, a product each; the best of each block are merged. Vectors that are
    null or of another length are ignored, and so are nulls in id."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & (F.size(v) == dim)).select(F.col(id_col).alias("id"), v.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asks")).first()
    nq, nr = max(1, -(-n["asks"] // QUERIES)), max(1, -(-n["rows"] // ROWS))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = rows.select("id", "vector", block(nr).alias("r"), F.lit(False).alias("is_query")).select("*", every(nq).alias("q"))
    asking = rows.where("asks").select("id", "vector", block(nq).alias("q"), F.lit(True).alias("is_query")).select("*", every(nr).alias("r"))
    kind = rows.schema["id"].dataType.simpleString()
    found = stored.unionByName(asking).groupBy("q", "r").applyInArrow(_scan_block(k, dim), f"query_id {kind}, id {kind}, score double").where("query_id <> id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def normalised(v: Column) -> Column:
    """v as a vector of length 1; the length counts as at least 1e-12."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))


def mean_pooled(vectors: DataFrame, group: str, vector_col: str) -> DataFrame:
    """(group, vector): the mean of the vectors of a group, element by element; null vectors don't count."""
    each = vectors.where(F.col(vector_col).isNotNull()).select(group, F.posexplode(vector_col).alias("at", "x"))
    mean = each.groupBy(group, "at").agg((F.sum(F.col("x").cast("double")) / F.count("*")).alias("x"))
    return mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def fuse(legs: list[DataFrame], k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ranked (id, score) lists of at most some hundred rows: (id, rrf, source)."""
    ranked = [leg.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"), F.lit(i).alias("leg")) for i, leg in enumerate(legs)]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    per = both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.min(F.struct("leg", "rank")).alias("first"), F.count("*").alias("legs"))
    # every fused row is a hybrid one for a reader of the hits; here the legs it came from are told
    source = F.when(F.col("legs") > 1, "hybrid").when(F.col("first.leg") == 0, "vector").otherwise("fts")
    return per.orderBy(F.desc(F.round("rrf", 12)), "first", "id").limit(k).select("id", "rrf", source.alias("source"))


def reordered(df: DataFrame, position: str, order: list[int]) -> DataFrame:
    """df with place: listed positions first, in that order, then the rest; repeated, negative and unknown ones are ignored."""
    first = {p: i for i, p in reversed(list(enumerate(order))) if p >= 0}
    listed = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col(position)] if first else F.lit(None).cast("int")
    return df.withColumn("place", F.row_number().over(W.orderBy(F.coalesce(listed, F.col(position) + F.lit(1_000_000)), position)))


def within_budget(df: DataFrame, text_col: str, order: list, budget: int = 4096) -> DataFrame:
    """The blocks in order up to the first that would pass the budget. df is a result list, not a corpus."""
    w = W.orderBy(*order)
    spent = F.sum(token_estimate(F.col(text_col))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.select("*", F.row_number().over(w).alias("block"), spent.cast("long").alias("spent")).where(F.col("spent") <= budget)
