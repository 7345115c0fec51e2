"""Lines, headings, their ranges and tree; chunks by structure. One partition unit is a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import SPACE, strip

# Heading patterns in the order of priority, and the level each gives.
PATTERNS = [
    (r"^第[一二三四五六七八九十百千万\p{Nd}]+[章节回部卷篇集]", 1),
    (rf"^(Book|Chapter|Section|Part|Volume)[{SPACE}]+[\p{{Nd}}IVXLC]+", 2),
    (rf"^[一二三四五六七八九十百千万]+[、.{SPACE}]+[^\n]", 2),
    (rf"^\p{{Nd}}+(\.\p{{Nd}}+)*[.{SPACE}]+[^\n]", 2),
    (r"^[（(][一二三四五六七八九十]+[）)]", 3),
    (rf"^(Part|Chapter|Section)[{SPACE}]+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)", 2),
    (r"^(前言|序言|引言|绪论|绪言|导论|导言|附录|后记|跋|参考文献|参考书目|致谢|鸣谢)$", 1),
]
# Levels that a title's own form gives.
LEVELS = [
    (r"^第[一二三四五六七八九十百千万\p{Nd}]+[部卷集]", 0),
    (r"^第[一二三四五六七八九十百千万\p{Nd}]+[章回]", 1),
    (r"^第[一二三四五六七八九十百千万\p{Nd}]+[节篇]", 2),
    (r"^(前言|序言|引言|绪论|附录|后记|跋|参考文献)", 0),
    (r"^\p{Nd}+\.\p{Nd}+\.", 3),
    (r"^\p{Nd}+\.", 2),
]
PAGE = 50
MARK = "￿"  # no character: put before every line that may be a heading
INNER_SPACE = f"[{SPACE}&&[^\n]]*"
#: One look at a line tells whether any of the patterns can match it.
MAYBE = f"(?md)^(?={INNER_SPACE}(?:" + "|".join(p[1:].replace("$", f"{INNER_SPACE}$") for p, _ in PATTERNS) + "))"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, n_lines): all lines, stripped, blank ones included."""
    parts = F.split(F.col(text_col), "\n")
    of = df.select(F.col(id_col).alias("id"), F.size(parts).alias("n_lines"), F.posexplode(parts).alias("line_no", "raw"))
    return of.select("id", "line_no", strip(F.col("raw")).alias("line"), "n_lines", "raw")


def pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page, n_lines, n_chars): non-blank lines in pages of 50 source lines; the last page is kept."""
    some = lines(df, id_col, text_col).where(F.length("line") > 0)
    per = some.groupBy("id", F.floor(F.col("line_no") / PAGE).cast("int").alias("page"))
    return per.agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def _first_match(line: Column, rules: list[tuple[str, int]], value=lambda n: F.lit(n)) -> Column:
    out = None
    for pattern, level in rules:
        out = F.when(line.rlike(pattern), value(level)) if out is None else out.when(line.rlike(pattern), value(level))
    return out


def structured(df: DataFrame, id_col: str, text_col: str, min_heading_len: int = 3) -> DataFrame:
    """(id, sections, heads): the text of each document, cut before every line that may be a heading, and its headings.

    Everything stays in the row of the document: no line becomes a row and no text is shuffled. A heading is a
    (level, title, section, start_line, start_char); of headings with one beginning the first counts."""
    text = F.col(text_col)
    parts = F.split(F.regexp_replace(text, MAYBE, MARK), MARK)
    rows = df.select(F.col(id_col).alias("id"), (F.size(F.split(text, "\n"))).alias("n_lines"), parts.alias("sections"))
    size = F.transform("sections", lambda s: F.struct(F.length(s).alias("chars"), (F.length(s) - F.length(F.translate(s, "\n", ""))).alias("breaks")))
    upto = F.aggregate(
        size,
        F.struct(F.lit(0).alias("chars"), F.lit(0).alias("breaks"), F.array().cast("array<struct<chars:int,breaks:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["chars"] + x["chars"]).alias("chars"),
            (a["breaks"] + x["breaks"]).alias("breaks"),
            F.array_append(a["out"], F.struct(a["chars"].alias("chars"), a["breaks"].alias("breaks"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    first = F.transform("sections", lambda s: strip(F.substring_index(s, "\n", 1)))
    rows = rows.withColumn("first", first).withColumn("upto", upto)
    formed = F.transform("first", lambda x: F.struct(x.alias("line"), _first_match(x, LEVELS).alias("form")))
    level = lambda x: F.when(F.length(x["line"]) >= min_heading_len, _first_match(x["line"], PATTERNS, lambda n: F.coalesce(x["form"], F.lit(n))))
    rows = rows.withColumn("formed", formed).withColumn("levels", F.transform("formed", level))
    every = F.filter(F.sequence(F.lit(0), F.size("sections") - 1), lambda i: F.get(F.col("levels"), i).isNotNull())
    keys = F.transform("at", lambda i: F.substring(F.get(F.col("first"), i), 1, 30))
    rows = rows.withColumn("at", every).withColumn("keys", keys)
    kept = F.filter("at", lambda i: F.array_position("keys", F.substring(F.get(F.col("first"), i), 1, 30)) == F.array_position("at", i))
    head = lambda i: F.struct(
        F.get(F.col("levels"), i).alias("level"),
        F.substring(F.get(F.col("first"), i), 1, 100).alias("title"),
        i.alias("section"),
        F.get(F.col("upto"), i)["breaks"].alias("start_line"),
        F.get(F.col("upto"), i)["chars"].alias("start_char"),
    )
    return rows.select("id", "n_lines", "sections", F.transform(kept, head).alias("heads"))


def headings(df: DataFrame, id_col: str, text_col: str, min_heading_len: int = 3) -> DataFrame:
    """(id, level, title, start_line, end_line, start_char): the first heading of each title, up to the next one."""
    rows = structured(df, id_col, text_col, min_heading_len)
    end = lambda i: F.coalesce(F.get(F.col("heads"), i + 1)["start_line"], F.col("n_lines"))
    row = lambda h, i: F.struct(h["level"].alias("level"), h["title"].alias("title"), h["start_line"].alias("start_line"), end(i).alias("end_line"), h["start_char"].alias("start_char"))
    return rows.select("id", F.inline(F.transform("heads", row)))


def merged(heads: DataFrame, least: int = 3) -> DataFrame:
    """Chapters of fewer than least lines are absorbed by the one before; ranges stay without gaps."""
    w = W.partitionBy("id").orderBy("start_line")
    ranked = heads.withColumn("k", F.row_number().over(w)).withColumn("stop", F.max("end_line").over(W.partitionBy("id")))
    kept = ranked.where((F.col("k") == 1) | (F.col("end_line") - F.col("start_line") >= least))
    return kept.select("id", "level", "title", "start_line", F.coalesce(F.lead("start_line").over(w), F.col("stop")).alias("end_line"))


def _stacks(heads: Column) -> Column:
    """For each heading the headings above it, the outermost first: one pass with a stack, as deep as there are levels."""
    kind = "array<struct<level:int,title:string,start_line:int>>"
    one = lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title"), h["start_line"].alias("start_line"))
    return F.aggregate(
        heads,
        F.struct(F.array().cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda a, h: F.struct(
            F.array_append(F.filter(a["open"], lambda x: x["level"] < h["level"]), one(h)).alias("open"),
            F.array_append(a["out"], F.filter(a["open"], lambda x: x["level"] < h["level"])).alias("out"),
        ),
        lambda a: a["out"],
    )


def heading_tree(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start_line, level, parent_line, leaf): the nearest heading before of a lower level; null under the root."""
    rows = structured(df, id_col, text_col)
    rows = rows.select("id", "heads", F.posexplode(F.arrays_zip("heads", _stacks(F.col("heads")).alias("stack"))).alias("k", "x"))
    following = F.get(F.col("heads"), F.col("k") + 1)["level"]
    parent = F.try_element_at(F.col("x.stack"), F.lit(-1))["start_line"]
    return rows.select("id", F.col("x.heads.start_line").alias("start_line"), F.col("x.heads.level").alias("level"), parent.alias("parent_line"), (F.coalesce(following, F.lit(-1)) <= F.col("x.heads.level")).alias("leaf"))


def nested(heads: DataFrame) -> DataFrame:
    """(id, tree): the headings of each document as one nested JSON text, in document order, with their depth."""
    item = F.struct("start_line", "level", "title")
    return heads.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("tree"))


def chapter_chunks(df: DataFrame, id_col: str, text_col: str, limit: int = 1024, keep_preamble: bool = False) -> DataFrame:
    """(id, start_line, struct_path, content, start_char, end_char, token_count, heading_stack): a chunk per chapter.

    Longer chunks and those of texts without chapters have no path. Offsets are absolute, of the chapter as it
    stands; the content is without white space at its ends. With keep_preamble the text before the first
    chapter is a chunk too."""
    rows = structured(df, id_col, text_col).withColumn("stacks", _stacks(F.col("heads")))
    bare = F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("section"), F.lit(0).alias("start_line"), F.lit(0).alias("start_char"))
    before = F.when((F.size("heads") == 0) | (F.lit(keep_preamble) & (F.get(F.col("heads"), F.lit(0))["section"] > 0)), F.array(bare)).otherwise(F.slice(F.array(bare), 1, 0))
    rows = rows.withColumn("n_before", F.size(before)).withColumn("all", F.concat(before, F.col("heads")))

    def piece(k: Column) -> Column:
        here, after = F.get(F.col("all"), k), F.get(F.col("all"), k + 1)
        stop = F.coalesce(after["section"], F.size("sections"))
        raw = F.array_join(F.slice("sections", here["section"] + 1, stop - here["section"]), "")
        above = F.transform(F.get(F.col("stacks"), k - F.col("n_before")), lambda x: x["title"])
        return F.struct(
            here["start_line"].alias("start_line"),
            here["title"].alias("title"),
            here["start_char"].alias("start_char"),
            # the line break before the next heading isn't the chapter's
            (F.length(raw) - F.when(after.isNotNull(), 1).otherwise(0)).alias("chars"),
            F.coalesce(above, F.array().cast("array<string>")).alias("above"),
            strip(raw).alias("content"),
        )

    pieces = F.transform(F.sequence(F.lit(0), F.size("all") - 1), piece)
    pieces = F.when(F.size("all") > 0, F.filter(pieces, lambda x: F.length(x["content"]) > 0))
    rows = rows.select("id", F.inline(pieces))
    path = F.when(F.col("title").isNotNull() & (F.length("content") <= limit), F.concat_ws("/", F.col("id").cast("string"), "title")).otherwise("")
    stack = F.when(F.col("title").isNull(), F.col("above")).otherwise(F.array_append("above", F.col("title")))
    end = F.col("start_char") + F.col("chars")
    return rows.select("id", "start_line", path.alias("struct_path"), "content", "start_char", end.alias("end_char"), F.length("content").alias("token_count"), stack.alias("heading_stack"))
