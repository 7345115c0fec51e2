"""One consistent form for texts that look the same and differ in their characters.

Every text is exploded to positioned code points; these are joined to small broadcast tables (indexed arrays
over all code points, so the join is a lookup and no code point is shuffled): decompositions, look-alikes,
combining classes. Invisible characters drop out, every kind of space becomes one kind, decompositions are
expanded in place, runs of combining marks are ordered by class, pairs are recomposed, and the strings are
rebuilt. The tables come from the Unicode data of the Python runtime by rule; only look-alike letters and
ideographs, which that data lacks, are stated here.

What a reader can see still counts: case, accents, digits, punctuation. So superscripts, circled and other
signs keep their own form; only canonical, width, no-break, ligature and radical decompositions are used.

Defined results: null stays null; an empty text or one of invisible characters only becomes ''; white space
at either end isn't visible and is dropped. Repeated rows count once in pairs; other columns aren't read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.blocks import blocks, code_points, strings

# Letters of other scripts, and ideographs, that look like the second of each pair.
LOOK_ALIKES = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY Ԛ" + "Q ԜW ҺH аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs уy ѵv ԝw хx ɡg",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX Ϲ" + "C ϳj οo ρp νv υu αa ιi κk γy χx ϲc",
    "Armenian": "օo հh ոn սu Տ" + "S",
    "Latin": "ɑa ɩi ı" + "i ℓl",
    "Ideographs": "⼀一 〡丨 ー一 ⻁虎 ⻄西 ⻅见 ⻆角 ⻇角 ⻉贝 ⻋车 ⻌辶 ⻓长 ⻔门 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻠饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻨麦 ⻩黄 ⻬齐 ⻮齿 ⻰龙 ⻳龟",
}
TOP = sys.maxunicode + 1
DROP = 0xFFFFFFFF


def look_alikes() -> dict[int, int]:
    return {ord(p[0]): ord(p[1]) for pairs in LOOK_ALIKES.values() for p in pairs.split()}


def _invisible(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0) or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r\x0b\x0c\x85")


def _used(ch: str) -> str:
    """The decomposition of ch that keeps what a reader can see."""
    raw = unicodedata.decomposition(ch)
    if not raw:
        return ch
    kind, _, rest = raw.partition(" ") if raw[0] == "<" else ("", "", raw)
    parts = "".join(chr(int(x, 16)) for x in rest.split())
    if kind == "<compat>":
        letters = all(unicodedata.category(x)[0] in "LM" for x in parts)
        if not (letters and unicodedata.category(ch)[0] in "LNS") and not (ch.isspace() or unicodedata.category(ch) == "Zs"):
            return ch
        if unicodedata.category(ch) == "No":
            return ch
    elif kind not in ("", "<wide>", "<narrow>", "<noBreak>"):
        return ch
    return "".join(map(_used, parts))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[tuple[int, int], int]]:
    """first (one code point, DROP, or itself), rows of longer expansions by code point, class, and composites."""
    first = np.arange(TOP, dtype=np.uint32)
    row = np.zeros(TOP, np.int32)
    ccc = np.zeros(TOP, np.uint8)
    longer: list[list[int]] = [[]]
    pairs: dict[tuple[int, int], int] = {}
    alike = look_alikes()
    for o in (*range(0x3400), *range(0x4DC0, 0x4E00), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        ch = chr(o)
        ccc[o] = unicodedata.combining(ch)
        raw = unicodedata.decomposition(ch)
        if raw and raw[0] != "<" and " " in raw and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in raw.split())
            pairs[a, b] = o
        if _invisible(ch):
            first[o] = DROP
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            first[o] = 32
        elif ch in "\x0b\x0c\x85  ":
            first[o] = 10
        else:
            to = [alike.get(ord(x), ord(x)) for x in _used(ch)]
            if len(to) == 1:
                first[o] = to[0]
            else:
                row[o] = len(longer)
                longer.append(to)
    for o, to in alike.items():
        first[o] = to
    for i in range(19):  # Hangul: the leading and vowel pairs, then the trailing ones
        for j in range(21):
            lv = 0xAC00 + (i * 21 + j) * 28
            pairs[0x1100 + i, 0x1161 + j] = lv
            for k in range(1, 28):  # a syllable is its composed form already
                pairs[lv, 0x11A7 + k] = lv + k
    width = max(map(len, longer))
    wide = np.zeros((len(longer), width + 1), np.uint32)
    for i, to in enumerate(longer):
        wide[i, 0] = len(to)
        wide[i, 1 : len(to) + 1] = to
    return first, row, wide, ccc, pairs


def _recompose(points: list[int], ccc: np.ndarray, pairs: dict) -> list[int]:
    """Canonical composition of one starter with the ordered marks after it."""
    out: list[int] = []
    starter, last = -1, 0
    for p in points:
        c = int(ccc[p])
        if starter >= 0 and (last < c or (last == 0 and len(out) - 1 == starter)) and (to := pairs.get((out[starter], p))):
            out[starter] = to
            continue
        if c == 0:
            starter = len(out)
        last = c
        out.append(p)
    return out


def unify(texts: list[str], using: tuple | None = None) -> list[str]:
    """The consistent form of each text."""
    first, row, wide, ccc, pairs = using or tables()
    flat, bounds = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    to, at = first[flat], row[flat]
    if at.any():  # expand in place
        n = np.where(at > 0, wide[at, 0], 1).astype(np.int64)
        src = np.repeat(np.arange(len(flat)), n)
        inner = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        to = np.where(at[src] > 0, wide[at[src], inner + 1], to[src])
        owner = owner[src]
    keep = to != DROP
    to, owner = to[keep], owner[keep]
    cr = to == 13  # a carriage return, alone or before a line feed, is a line end
    if cr.any():
        pair = np.zeros(len(to), bool)
        pair[:-1] = cr[:-1] & (to[1:] == 10) & (owner[:-1] == owner[1:])
        to = np.where(cr, np.uint32(10), to)
        to, owner = to[~pair], owner[~pair]
    marks = ccc[to] > 0
    jamo = (to >= 0x1161) & (to < 0x11C3)
    if marks.any() or jamo.any():
        start = ~(marks | jamo)
        start[np.flatnonzero(np.diff(owner)) + 1] = True
        start[:1] = True
        group = np.cumsum(start) - 1
        order = np.lexsort((np.where(marks, ccc[to], 0), np.cumsum(~marks), group))  # stable: equal classes keep their order
        to, owner, group = to[order], owner[order], group[order]
        sizes = np.bincount(group)
        firsts = np.cumsum(sizes) - sizes
        many = np.flatnonzero(sizes > 1)
        keep = np.ones(len(to), bool)
        memo: dict[bytes, list[int]] = {}
        for g in many:
            a, b = firsts[g], firsts[g] + sizes[g]
            key = to[a:b].tobytes()
            if (got := memo.get(key)) is None:
                got = memo[key] = _recompose(to[a:b].tolist(), ccc, pairs)
            to[a : a + len(got)] = got
            keep[a + len(got) : b] = False
        to, owner = to[keep], owner[keep]
    return [s.strip() for s in strings(to, np.searchsorted(owner, np.arange(len(texts) + 1)))]


def _unify_batches(column: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, column):
            c = b.column(column)
            texts = c.to_pylist()
            done = iter(unify([t for t in texts if t is not None], shared.value))
            same = pa.array([None if t is None else next(done) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, same], names=[*b.schema.names, "same_look"])

    return run


def same_look(df: DataFrame, column: str) -> DataFrame:
    """df with same_look, the consistent form of column; a column of that name already there is replaced."""
    df = df.drop("same_look") if column != "same_look" else df.withColumnRenamed(column, "text")
    column = "text" if column == "same_look" else column
    schema = T.StructType([*df.schema.fields, T.StructField("same_look", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(tables())  # some 10 MB, whatever the data
    return df.mapInArrow(_unify_batches(column, shared), schema)


def _looks(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, raw, look): the distinct texts of each id, and what they look like, as 128-bit hashes."""
    rows = same_look(df.select(F.col(id_col).cast("string").alias("id"), F.col(column).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()), "text")
    return rows.where(F.length("same_look") > 0).select("id", F.unhex(F.md5("text")).alias("raw"), F.unhex(F.md5("same_look")).alias("look")).distinct()


def same_look_classes(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, class_id, n_texts, n_ids): each id whose text looks like a different string, with its class, the smallest id of it.

    A row for an id, however many others look like it."""
    keys = _looks(df, id_col, column)
    classes = keys.groupBy("look").agg(F.min("id").alias("class_id"), F.count_distinct("raw").alias("n_texts"), F.count_distinct("id").alias("n_ids"))
    return keys.select("id", "look").distinct().join(classes.where("n_texts > 1"), "look").select("id", "class_id", "n_texts", "n_ids")


def same_look_pairs(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id_a, id_b): ids whose texts look the same and are different strings; same_look_classes says it with a row for each id."""
    keys = _looks(df, id_col, column)
    mixed = keys.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look")
    some = keys.join(mixed, "look", "left_semi")
    pairs = some.alias("a").join(some.alias("b"), F.expr("a.look = b.look AND a.raw <> b.raw AND a.id < b.id"))
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
