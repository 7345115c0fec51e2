"""From hits to the text that a model reads: index lists, formatted blocks, budgets, several queries for a topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import token_estimate

PREVIEW = 200


def parsed_indices(reply: Column) -> Column:
    """The list of indices in a model's reply: the reply as a JSON list, else the first bracketed list of numbers, else none."""
    inner = F.regexp_extract(reply, r"\[([0-9,\s]+)\]", 1)
    numbers = F.filter(F.transform(F.split(inner, ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999")).cast("int")), lambda x: x.isNotNull())
    return F.coalesce(F.from_json(F.trim(reply), "array<int>"), numbers)


def parsed_object(reply: Column, schema: str) -> Column:
    """The JSON object in a model's reply: a fenced block, else from the first brace to the last; null if that is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first, last = F.locate("{", reply), F.length(reply) - F.locate("}", F.reverse(reply)) + 1
    bare = F.when((first > 0) & (last > first), F.substring(reply, first, last - first + 1))
    text = F.when(F.length(fenced) > 0, fenced).otherwise(bare)
    return F.when(F.is_valid_json(text) if hasattr(F, "is_valid_json") else F.get_json_object(text, "$").isNotNull(), F.from_json(text, schema))


def reranked(hits: DataFrame, query: str, rank: Callable[[str, list[str]], str] | None = None) -> DataFrame:
    """A result list with place: first the hits a model's index list names, then the rest as they were.

    rank gets the query and the previews of the candidates in order. Without it, for at most one candidate, or where
    it fails, the order stays. Repeated, negative and unknown indices are ignored."""
    w = W.orderBy(F.desc("score"), "id")
    listed = hits.withColumn("position", F.row_number().over(w) - 1)
    order: list[int] = []
    previews = [r[0] or "" for r in listed.orderBy("position").select(F.substring("content", 1, PREVIEW)).collect()] if rank else []
    if rank and len(previews) > 1:
        try:
            reply = hits.sparkSession.createDataFrame([(rank(query, previews),)], "reply string")
            order = [i for i in reply.select(parsed_indices(F.col("reply"))).first()[0] or [] if 0 <= i < len(previews)]
        except Exception:
            order = []
    from quire.operators.retrieval import reordered

    return reordered(listed, "position", list(dict.fromkeys(order)))


def block(number: Column, title: Column, heading: Column, score: Column, content: Column) -> Column:
    """A hit as Markdown: number, title, heading if there is one, relevance, content. The layout is a fixed value."""
    t, where = F.coalesce(title, F.lit("未知书籍")), F.coalesce(heading, F.lit(""))
    return F.concat(F.lit("## 素材 ["), number.cast("string"), F.lit("]\n**来源**：《"), t, F.lit("》"), where, F.lit("\n**相关性**："), F.format_string("%.2f", score), F.lit("\n**内容**："), F.coalesce(content, F.lit("")), F.lit("\n"))


def context_blocks(hits: DataFrame, budget: int = 4096) -> DataFrame:
    """(id, number, block, spent): hits by book and place as formatted blocks, up to the first that passes the budget.

    hits: (id, score, content, metadata) of a result list. What is counted is the block, not the bare content."""
    m = F.col("metadata")
    order = [F.coalesce(m["book_id"], F.lit("")), F.coalesce(m["start_char"], F.lit(0)), F.desc("score"), F.col("id")]
    numbered = hits.withColumn("number", F.row_number().over(W.orderBy(*order)))
    shown = numbered.withColumn("block", block(F.col("number"), m["book_title"], m["heading"], F.col("score"), F.col("content")))
    spent = F.sum(token_estimate(F.col("block"))).over(W.orderBy("number").rowsBetween(W.unboundedPreceding, 0))
    return shown.withColumn("spent", spent.cast("long")).where(F.col("spent") <= budget).select("id", "number", "block", "spent")


def assembled(blocks: DataFrame) -> DataFrame:
    """(context): the blocks as one text."""
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda x: x["block"]), "\n").alias("context"))


def topic_queries(topics: DataFrame, planned: DataFrame) -> DataFrame:
    """(topic, query_no, query): a topic's planned queries, of several plans the first, else three default ones.

    topics: (topic); planned: (plan_no, topic, queries)."""
    w = W.partitionBy("topic").orderBy("plan_no")
    first = planned.withColumn("k", F.row_number().over(w)).where("k = 1 AND size(queries) > 0").select("topic", "queries")
    t = F.col("topic")
    default = F.array(t, F.concat(t, F.lit(" 定义 概念")), F.concat(t, F.lit(" 案例 例子")))
    every = topics.select("topic").distinct().join(first, "topic", "left")
    return every.select("topic", F.posexplode(F.coalesce("queries", default)).alias("query_no", "query"))


def topic_hits(found: DataFrame, across_topics: bool = False) -> DataFrame:
    """Hits of several queries of a topic, each id once: its first query and rank. found: (topic, query_no, rank, id, ...)."""
    by = [] if across_topics else ["topic"]
    first = W.partitionBy(*by, "id").orderBy("topic", "query_no", "rank")
    return found.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def topic_coverage(hits: DataFrame, topics: DataFrame, least: int = 3, shown: int = 5) -> DataFrame:
    """(topic, hits, first_ids, coverage): the plan of materials; topics without hits are insufficient."""
    of = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("query_no", "rank", "id"))), 1, shown), lambda x: x["id"])
    per = hits.groupBy("topic").agg(F.count("*").alias("hits"), of.alias("first_ids"))
    every = topics.select("topic").distinct().join(per, "topic", "left")
    n = F.coalesce("hits", F.lit(0))
    return every.select("topic", n.alias("hits"), F.coalesce("first_ids", F.array().cast("array<string>")).alias("first_ids"), F.when(n >= least, "adequate").otherwise("insufficient").alias("coverage"))
