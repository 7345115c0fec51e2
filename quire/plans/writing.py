"""From a theme to a text: requirements, material, outline, sections. A model is asked where there is one; every step has a default without."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.models import Completion, NoModel
from quire.operators import context

ANALYSIS = "core_theme string, sub_themes array<string>, style_profile struct<tone:string,language:string,narrative:string>, material_queries array<struct<topic:string,queries:array<string>>>, estimated_sections int, target_word_count int"


@dataclass
class Request:
    theme: str
    style: str = "通俗易懂"
    words: int = 3000
    audience: str = "大众"


@dataclass
class Result:
    outline: str = ""
    sections: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0


def analysed(themes: DataFrame, reply: Column | None = None) -> DataFrame:
    """(theme, analysis, is_default): the model's reply where it parses, with what it leaves out filled in; else one theme with three queries.

    themes: (theme, style, words)."""
    t = F.col("theme")
    queries = F.array(t, F.concat(t, F.lit(" 定义 概念")), F.concat(t, F.lit(" 案例 例子")))
    profile = F.struct(F.col("style").alias("tone"), F.lit("中文").alias("language"), F.lit("第三人称").alias("narrative"))
    default = F.struct(t.alias("core_theme"), F.array(t).alias("sub_themes"), profile.alias("style_profile"), F.array(F.struct(t.alias("topic"), queries.alias("queries"))).alias("material_queries"), F.lit(3).alias("estimated_sections"), F.col("words").cast("int").alias("target_word_count"))
    got = context.parsed_object(reply, ANALYSIS) if reply is not None else F.lit(None).cast(f"struct<{ANALYSIS.replace(' struct', ':struct').replace(' string', ':string').replace(' array', ':array').replace(' int', ':int')}>")
    rows = themes.withColumn("got", got).withColumn("default", default)
    names = ("core_theme", "sub_themes", "style_profile", "material_queries", "estimated_sections", "target_word_count")
    return rows.select("theme", F.struct(*(F.coalesce(F.col(f"got.{n}"), F.col(f"default.{n}")).alias(n) for n in names)).alias("analysis"), F.col("got").isNull().alias("is_default"))


def material(analysis: DataFrame, search, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(hits, coverage) of an analysis. search: a plan from (topic, query_no, query) to (topic, query_no, rank, id, score, ...)."""
    topics = analysis.select(F.explode("analysis.sub_themes").alias("topic"))
    planned = analysis.select(F.posexplode("analysis.material_queries").alias("plan_no", "m")).select("plan_no", "m.topic", "m.queries")
    found = context.topic_hits(search(context.topic_queries(topics, planned)))
    return found, context.topic_coverage(found, topics, least)


def outline_prompt(theme: Column, sections: Column, words: Column, material_text: Column) -> Column:
    return F.concat(F.lit("请为主题“"), theme, F.lit("”写一份提纲，用 ## 标出 "), sections.cast("string"), F.lit(" 节，全文约 "), words.cast("string"), F.lit(" 字。\n\n资料：\n"), material_text)


def section_titles(outline: str) -> list[str]:
    return [re.sub(r"^#{1,3}\s+", "", x.strip()) for x in outline.split("\n") if re.match(r"#{1,3}\s+", x.strip())]


def generate(request: Request, material_text: str, model: Completion | None = None) -> Result:
    """Outline, sections and whole text. Without a model the outline has three sections and each holds its part of the material."""
    model = model or NoModel()
    outline = model.complete(f"主题：{request.theme}\n风格：{request.style}\n受众：{request.audience}\n字数：{request.words}\n资料：\n{material_text}\n请写提纲，各节以 ## 开头。")
    if not section_titles(outline):
        outline = "\n".join(f"## {request.theme}：{x}" for x in ("引入", "展开", "总结"))
    titles = section_titles(outline)
    each = max(request.words // len(titles), 500)
    parts = material_text.split("\n## 素材 ")
    sections = []
    for i, title in enumerate(titles):
        own = "\n## 素材 ".join(parts[i :: len(titles)])
        sections.append(f"## {title}\n\n" + (model.complete(f"请写“{title}”一节，约 {each} 字。\n提纲：\n{outline}\n资料：\n{material_text}") or own[: 2 * each]))
    text = model.complete("请统一下文的语气并补上过渡：\n" + "\n\n".join(sections)) or "\n\n".join(sections)
    return Result(outline, sections, text, len(text.replace(" ", "").replace("\n", "")))
