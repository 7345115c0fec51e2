"""Splitting of oversized texts at natural boundaries: structure-tree packing.

A text above the limit is parsed into a tree: sections nested by the level of their headings, in these lists with
nested items, fenced blocks and paragraphs, in these lines, sentences, words and characters. Only an oversized
node is descended into; sibling subtrees are merged from the bottom up while they fit. A heading stays with what
follows it. Chapter starts are hard: pieces never merge across one. Every piece but the first begins with the last
``overlap`` characters before its cut, and no piece is longer than ``limit``. The heading stack of a piece is that
of its text and the headings above its cut within the text.

Defined results: a null or short text gives no rows; cuts that are null, repeated or not strictly inside the
text are ignored; without start_char absolute offsets are null and no chapter is looked up; repeated rows
count once; an empty table gives an empty table; only the named columns are read. Offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import blocks

LIMIT, OVERLAP = 1024, 128
BUCKET = 4096
# Headings, the widest first, and the level of each; Markdown and numbered ones tell theirs themselves.
HEADINGS = [
    (re.compile(r"第[〇零一二三四五六七八九十百千两0-9]+[部卷集]|(?:Part|Partie|Teil|Parte|Часть)\s+\S"), 1),
    (re.compile(r"第[〇零一二三四五六七八九十百千两0-9]+[章回]|(?:Chapter|Chapitre|Kapitel|Capítulo|Глава)\s+\S"), 2),
    (re.compile(r"第[〇零一二三四五六七八九十百千两0-9]+[节篇]|Section\s+\S"), 3),
    (re.compile(r"[一二三四五六七八九十]+、"), 4),
    (re.compile(r"（[一二三四五六七八九十]+）"), 5),
]
MARKDOWN, NUMBERED = re.compile(r"(#{1,6})\s"), re.compile(r"(\d+(?:\.\d+)+)\s")
LONGEST_HEADING = 80
ITEM = re.compile(r"([ \t\u3000]*)(?:[-*+•·□■○●◦▪✓☐]\s+|\d{1,3}[.)、]\s*(?!\d)|[（(]\d{1,3}[)）])")
FENCE = ("```", "~~~")
LINE = re.compile(r"\n+")
SENTENCE = re.compile(r"[。！？!?；;…]+[”’」』）)\"»]*|\.+[\"”’»)]*(?=\s|$)")
WORD = re.compile(r"[\s，、,]+")
LEAVES = ("line", "sentence", "word", "character")


def heading_level(line: str) -> int | None:
    """The level of a heading line, or None."""
    if not line or len(line) > LONGEST_HEADING:
        return None
    if m := MARKDOWN.match(line):
        return len(m.group(1))
    for pattern, level in HEADINGS:
        if pattern.match(line):
            return level
    if m := NUMBERED.match(line):
        return 1 + m.group(1).count(".")
    return None


@dataclass(slots=True)
class Node:
    start: int
    kind: str
    level: int = 0  # of a section its heading's, of an item its indent
    title: str = ""
    end: int = 0
    children: list[Node] = field(default_factory=list)

    def close(self, end: int) -> None:
        """Children lie side by side and fill their parent."""
        self.end = end
        if self.children:
            self.children[0].start = self.start
        for child, stop in zip(self.children, [*(c.start for c in self.children[1:]), end]):
            child.close(stop)


def parse(text: str, lo: int, hi: int, after_heading: set[int]) -> Node:
    """The tree of text[lo:hi]; adds where the first line after each heading begins."""
    root = Node(lo, "section")
    sections, block, items = [root], None, []
    fence = None  # the mark that ends the open fenced block
    ended = glued = False  # a blank line was met; a heading waits for what follows it
    at = lo
    while at < hi:
        stop = text.find("\n", at, hi)
        stop = hi if stop < 0 else stop + 1
        line = text[at:stop]
        bare = line.strip()
        if glued and bare:
            after_heading.add(at)
        if fence:
            if bare.startswith(fence):
                fence, ended = None, True
        elif not bare:
            ended = not glued
        elif bare.startswith(FENCE):
            fence = bare[:3]
            if not glued:
                block = Node(at, "fence")
                sections[-1].children.append(block)
            glued, items = False, []
        elif level := heading_level(bare):
            while len(sections) > 1 and sections[-1].level >= level:
                sections.pop()
            section = Node(at, "heading", level, bare.lstrip("# "))
            sections[-1].children.append(section)
            sections.append(section)
            block, items = Node(at, "paragraph"), []
            section.children.append(block)
            ended, glued = False, True
        elif m := ITEM.match(line):
            indent = len(m.group(1))
            if not items or block is None or block.kind != "list":
                if glued:
                    block.kind = "list"
                else:
                    block = Node(at, "list")
                    sections[-1].children.append(block)
                items, block.level = [block], -1
            while len(items) > 1 and items[-1].level >= indent:
                items.pop()
            item = Node(at, "item", indent)
            items[-1].children.append(item)
            items.append(item)
            ended = glued = False
        else:
            inside = bool(items) and line[0] in " \t\u3000"  # an item goes on
            if block is None or (ended and not inside) or block.kind == "fence" or (items and not inside):
                block, items = Node(at, "paragraph"), []
                sections[-1].children.append(block)
            ended = glued = False
        at = stop
    root.close(hi)
    return root


def pack(text: str, cuts: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str, list[str]]]:
    """(own start, end, kind of the cut at its start, headings above it) of the pieces; own parts follow each other without gap."""
    hard = sorted({c for c in cuts if 0 < c < len(text)})
    after_heading: set[int] = set()
    trees = [parse(text, s, e, after_heading) for s, e in zip([0, *hard], [*hard, len(text)])]
    marks = [[m.end() for m in p.finditer(text) if m.end() not in after_heading] for p in (LINE, SENTENCE, WORD)]

    def fits(a: int, b: int) -> bool:
        return b - a <= (limit if a == 0 else limit - overlap)

    def joined(parts: Iterator[list[tuple[int, int, str]]]) -> list[tuple[int, int, str]]:
        """Pieces of siblings, whole ones merged while they fit."""
        out: list[tuple[int, int, str]] = []
        open_ = False  # the last piece consists of whole siblings
        for pieces in parts:
            if open_ and len(pieces) == 1 and fits(out[-1][0], pieces[0][1]):
                out[-1] = (out[-1][0], pieces[0][1], out[-1][2])
                continue
            out += pieces
            open_ = len(pieces) == 1
        return out

    def leaf(a: int, b: int, kind: str, depth: int) -> list[tuple[int, int, str]]:
        if fits(a, b):
            return [(a, b, kind)]
        if depth == len(marks):
            starts = [a, *range(a + (limit if a == 0 else limit - overlap), b, limit - overlap)]
            return [(s, e, kind if s == a else LEAVES[depth]) for s, e in zip(starts, [*starts[1:], b])]
        inner = marks[depth][bisect_right(marks[depth], a) : bisect_left(marks[depth], b)]
        if not inner:
            return leaf(a, b, kind, depth + 1)
        return joined(leaf(s, e, kind if s == a else LEAVES[depth], depth + 1) for s, e in zip([a, *inner], [*inner, b]))

    def down(node: Node, kind: str) -> list[tuple[int, int, str]]:
        if fits(node.start, node.end):
            return [(node.start, node.end, kind)]
        if not node.children:
            return leaf(node.start, node.end, kind, 0)
        return joined(down(c, kind if c.start == node.start else c.kind) for c in node.children)

    def above(node: Node, at: int) -> list[str]:
        titles = []
        while node.children:
            i = bisect_right([c.start for c in node.children], at) - 1
            node = node.children[i]
            if node.title:
                titles.append(node.title)
        return titles

    return [(a, b, kind, above(tree, a)) for tree in trees for a, b, kind in down(tree, "chapter" if tree.start else "start")]


SCHEMA = "chunk_id string, piece int, start long, end long, cut long, kind string, abs_start long, abs_end long, heading_stack array<string>, text string"


def _split_batches(limit: int, overlap: int):
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "content"):
            out: list[tuple] = []
            for chunk, text, at, stack, cuts in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "content", "start_char", "heading_stack", "cuts"))):
                for i, (own, end, kind, above) in enumerate(pack(text, [c - at for c in cuts or ()], limit, overlap)):
                    known = stack or []
                    full = known + [t for t in above if t not in known] if stack is not None or above else None
                    start = max(0, own - overlap) if i else own
                    out.append((chunk, i, start, end, own, kind, None if at is None else at + start, None if at is None else at + end, full, text[start:end]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def split_oversized(chunks: DataFrame, chapters: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose content is longer than limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    cols = ["chunk_id", "book_id", "content", "start_char", "heading_stack"]
    long_ = chunks.select(*cols).where(F.length("content") > limit).withColumn("key", F.md5(F.concat_ws("|", "chunk_id", "book_id", F.col("start_char").cast("string"), "content")))
    long_ = long_.dropDuplicates(["key"])
    spans = long_.select("key", "book_id", "start_char", (F.col("start_char") + F.length("content")).alias("stop")).where(F.col("start_char").isNotNull())
    # a range join as an equi-join: both sides meet in buckets of the book's offsets
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_char") / BUCKET), F.floor(F.col("stop") / BUCKET))))
    starts = chapters.select("book_id", F.col("start_char").alias("cut")).where(F.col("cut").isNotNull()).distinct().withColumn("bucket", F.floor(F.col("cut") / BUCKET))
    inside = spans.join(starts, ["book_id", "bucket"]).where("cut > start_char AND cut < stop")
    cuts = inside.groupBy("key").agg(F.collect_set("cut").alias("cuts"))
    rows = long_.join(cuts, "key", "left").select("chunk_id", "content", "start_char", "heading_stack", "cuts")
    return rows.mapInArrow(_split_batches(limit, overlap), SCHEMA)
