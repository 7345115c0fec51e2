"""Texts cut off by a field limit or in transfer.

A backward character n-gram model over the whole corpus: for a context (the last k characters, k = 1 .. 8)
it has how often that context occurs, and how often a line, a sentence or a clause ends right after it. Each
value's final context gives the log-odds of an end against a continuation, interpolated from short to long
contexts and without the value's own evidence. What end is asked for depends on what stands there: a line's
end for a value that stops without a sign, a clause's end for an item of a list or a line of verse, a
sentence's end for one with a mark added.

How a line begins (as an item, a heading, a signature, a note, or none of these) is part of every context in it, so
names and numbers that end signatures and notes are known as ends there. In items, headings and talk, whose words
are those of plain lines, what is known of plain lines comes first. Digits count as one character.

The shape of an ending (bare, item, verse, signed, note, marked, bracketed, trailing: a mark after a clause alone in
its line) is only where its threshold starts from. Thresholds are learnt for each language, script and shape of the
column: an end is held against how often any place of the language's texts is one, which is what a cut at any place
hits by chance, and the share of cut values among the endings of that shape is estimated by expectation
maximisation over all of them, starting from ``PRIOR_CUT``, which counts as much as so many values. Labels that
are no language codes, or a missing column of them, count as none.

Two exits need no model: a value that ends in a sign that ends sentences can't stop inside one, and one that ends
in a replacement character has lost bytes.

Contexts are counted only where some value ends in them. That set is a bitmap of fixed size, built by
aggregation; a false hit in it only costs a count nobody asks for. So counts cover every position of every
text, and what is shuffled is bounded by the contexts asked for. The counts are pooled over languages: labels
are wrong at times, and a context of a few letters tells its language.

Defined results: null, empty and blank texts aren't cut; copies of a text get the same answer and don't
support each other; repeated rows are each answered; a null source forms a group of its own in the report; an
empty table gives empty results; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import blocks, code_points
from quire.session import small_side, written

ORDERS = (1, 2, 3, 4, 6, 8)
BITS = 24
PRIOR = 4.0  # weight of the shorter context's estimate
#: What must end at an ending of each shape.
ASKED = {"bare": "line", "signed": "line", "note": "line", "item": "clause", "verse": "clause", "bracketed": "sentence", "marked": "sentence", "trailing": "sentence"}
#: The share of cut ones among such endings to start from, and the number of values it counts as.
PRIOR_CUT = {"bare": (0.97, 30), "signed": (0.02, 30), "note": (0.02, 30), "item": (0.1, 30), "verse": (0.1, 30), "bracketed": (0.999, 300), "marked": (0.99, 300), "trailing": (0.3, 30)}
BIN = 0.25  # of log-odds
LEAN = 10_000  # characters by which a language leans on the rates of its script
# Signs and shapes of endings.
TERMINAL = "。．.!！?？…”\"』」»’"
SENTENCE_END = "。．.!！?？；;”』」»\n"
CLAUSE_END = SENTENCE_END + "，、,：:)）"
INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]+")
MARK = re.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|（…+）|【…+】|…+|\.{3,}|。{3,})$")
BROKEN = re.compile("�+$")
CLOSED = re.compile(r"[。．.!！?？”』」»\"】〕\]）)*_=~—》]$")
LIST = re.compile(r"^\s*(?:[*•·□■○●◦▪✓☐+\-–]\s|[(（]?\d{1,3}[.)、）](?!\d)|[a-z]\)\s|[①-⑳])")
SIGNED = re.compile(r"^\s*(?:(?:[—–―/~]|--)\s*|(?:signed|signé|gezeichnet|gez|firmado|подписано|署名|记)\s*[:：.]\s*)[^，。,;；!?！？]{1,40}$")
HEADING = re.compile(r"^\s*(?:#{1,6}\s|第\s?[0-9０-９零〇一二三四五六七八九十百千两]+\s?[章节回卷篇部集]|(?:chapter|chapitre|kapitel|cap[ií]tulo|глава)\b|\d+(?:\.\d+)+\s)", re.I)
SIGN = re.compile(r"[。！？!?；，、,;：:]|\.\s|[.…”』」»\")）\]】〕]$")
# How a line of each class begins.
BEGINS = re.compile(r"^[ \t\u3000]*(?:(?P<head>#{1,6}\s|第\s?[0-9０-９零〇一二三四五六七八九十百千两]+\s?[章节回卷篇部集])|(?P<dash>[—–―]{2}|--|[—–―]\s)|(?P<talk>[—–―])|(?P<slash>[/~])|(?P<sign>(?:signed|signé|gezeichnet|gez|firmado|подписано|署名|记)\s*[:：.])|(?P<item>[*•·□■○●◦▪✓☐+-]\s|[(（]?\d{1,3}[.)、）](?!\d)|[a-z]\)\s|[①-⑳])|(?P<bracket>〔)|(?P<note>附|图|注|见|参见|参看|第|#\s?\d|№|(?:No|no|Nr|fig|Fig|p|pp|S|vol|cf|см|стр|рис|núm|n°)\.?\s*№?\s*\d))", re.M)
CLASSES = {"head": 1, "sign": 2, "item": 3, "note": 4, "dash": 5, "slash": 6, "talk": 7, "bracket": 8}
PROSE = {CLASSES[c] for c in ("head", "item", "talk")}  # their words are those of plain lines
VERSE = 2  # lines above the last one that must look like verse too
CLAUSE = re.compile(r"[。！？!?；，、,;：:]|\.\s")
NOTE = re.compile(r"^\s*(?:〔[^，。]*|(?:No|no|Nr|fig|Fig|p|pp|S|vol|cf|см|стр|рис|núm|n°)\.?\s*№?\s*\d[\d.–-]*|(?:附|图|注|见|参见|参看|第)[：:]?[^，。]{0,12}\d+|#\s*\d+|№\s*\d+|附[：:].*)$")


def _verse_line(line: str) -> bool:
    line = line.strip()
    return 0 < len(line) <= 80 and not (HEADING.match(line) or NOTE.match(line) or LIST.match(line) or SIGN.search(line))


def _look(text: str | None) -> tuple[str, str]:
    """(kind, stem): kind is whole, broken, or a shape; stem is the text before a mark."""
    t = INVISIBLE.sub("", text or "").rstrip()
    if not t:
        return "whole", ""
    if BROKEN.search(t):
        return "broken", BROKEN.sub("", t)
    if m := MARK.search(t):
        stem = t[: m.start()].rstrip()
        if not stem or stem[-1] in TERMINAL:
            return "whole", stem
        line = stem.rpartition("\n")[2]
        if any(c in m.group() for c in "[(（【"):
            return "bracketed", stem
        return ("marked" if "\n" not in stem or CLAUSE.search(line) else "trailing"), stem
    if CLOSED.search(t):
        return "whole", t
    lines = t.rsplit("\n", VERSE + 1)
    last = lines[-1]
    for kind, pattern in (("signed", SIGNED), ("note", NOTE), ("item", LIST)):
        if pattern.match(last):
            return kind, t
    if len(lines) > VERSE and all(map(_verse_line, lines[-VERSE - 1 :])):
        return "verse", t  # several lines without signs
    return "bare", t


def _hash(flat: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points that end at each place, and of the class of the line there; places before k - 1 are left out."""
    h = classes[k - 1 :].astype(np.uint64) << np.uint64(40) | np.uint64(k << 32)
    for i in range(k):
        h = (h ^ flat[i : len(flat) - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with one digit for all, and the class of the line of each."""
    whole = "".join(texts)
    flat, _ = code_points([whole])
    classes = np.zeros(len(flat), np.uint8)
    for m in BEGINS.finditer(whole):
        end = whole.find("\n", m.start())
        classes[m.start() : end + 1 if end >= 0 else len(flat)] = CLASSES[m.lastgroup]
    return np.where((flat >= 48) & (flat <= 57), np.uint32(48), flat), classes


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "script", "key", "contexts", "others", "n_line", "n_sentence", "n_clause", "n_chars"]
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for b in blocks(batches, "text"):
        out = []
        for text in b.column("text").to_pylist():
            kind, stem = _look(text)
            contexts, key, script, others = None, None, "alphabetic", 0
            if stem and any(ord(c) >= 0x2E80 for c in stem[-2:]):
                script = "ideographic"
            if kind in ASKED and stem:
                line = stem.rfind("\n") + 1
                flat, classes = _points([stem[min(line, max(0, len(stem) - max(ORDERS))) :]])
                kinds = [0, classes[-1]] if classes[-1] in PROSE else [classes[-1]]
                contexts = [int(_hash(flat[-k:], np.full(k, c, np.uint8), k)[-1].astype(np.int64)) for c in kinds for k in ORDERS if len(flat) >= k]
                others = len(contexts) // 2 if classes[-1] in PROSE else 0
                key = int.from_bytes(blake2b(f"{kind}|{stem}".encode(), digest_size=8).digest(), "big", signed=True)
            text = text or ""
            line = text.count("\n") + 1
            sentence = line + sum(text.count(c) for c in SENTENCE_END if c != "\n")
            out.append((kind, script, key, contexts, others, line, sentence, sentence + sum(text.count(c) for c in CLAUSE_END if c not in SENTENCE_END), len(text)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang")), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["doc_id", "source", "lang", *names])


def _counts(shared):
    """Occurrences, and ends of lines, sentences and clauses, of the contexts asked for; summed within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint64)
        held: list[np.ndarray] = []

        def summed(parts: list[np.ndarray]) -> np.ndarray:
            whole = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
            keys, where = np.unique(whole[:, 0], return_inverse=True)
            return np.column_stack([keys, *(np.bincount(where, whole[:, i], len(keys)).astype(np.int64) for i in (1, 2, 3, 4))])

        for b in blocks(batches, "text"):
            texts = [INVISIBLE.sub("", t).rstrip() + "\n\0" for t in b.column("text").to_pylist() if t]
            flat, classes = _points(texts)
            line_end = flat == 10
            dots = np.zeros(len(flat), bool)  # the same sign again is a mark, not an end
            dots[:-1] = (flat[:-1] == flat[1:]) & (flat[:-1] != 10)
            sentence = np.isin(flat, np.array([ord(c) for c in SENTENCE_END], np.uint32)) & ~dots
            clause = np.isin(flat, np.array([ord(c) for c in CLAUSE_END], np.uint32)) & ~dots
            for k in ORDERS:
                h = _hash(flat, classes, k)[:-1] if len(flat) > k else np.zeros(0, np.uint64)
                slot = h >> np.uint64(64 - BITS)
                ask = np.flatnonzero(bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                after = ask + k
                held.append(np.column_stack([h[ask].astype(np.int64), np.ones(len(ask), np.int64), line_end[after], sentence[after], clause[after]]))
            if sum(map(len, held)) > 500_000:
                held[:] = [summed(held)]
        done = summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[:, i])) for i in range(5)], names=["context", "n", "line_ends", "sentence_ends", "clause_ends"])

    return run


def thresholds(seen: dict[tuple[str, str, str], dict[int, int]], rates: dict[tuple[str, str], dict[str, tuple[float, float]]]) -> dict[tuple[str, str, str], float]:
    """Log-odds below which a value is cut, for each (language, script, kind).

    seen: the number of endings of each bin of log-odds; rates: in how many characters, how many ends of each sort
    the (language, script) has. With chance p of an end in the context, b at any place, and s the share of cut values,
    the odds of a complete ending are p / b * (1 - s) / s: where they are even is the threshold."""
    out = {}
    for script, kind in {k[1:] for k in seen}:
        groups = {k: h for k, h in seen.items() if k[1:] == (script, kind)}
        whole: dict[int, int] = {}
        for h in groups.values():
            for i, n in h.items():
                whole[i] = whole.get(i, 0) + n
        rate, (start, weight) = _rate(rates, script, ASKED[kind]), PRIOR_CUT[kind]
        pooled = _share(whole, rate, start, weight)
        for k, h in groups.items():
            c, e = rates[k[:2]][ASKED[kind]]
            base = (e + LEAN * rate) / (c + LEAN)
            share = _share(h, base, pooled, weight)
            p = base * share / (1 - share)
            out[k] = math.log(p / (1 - p)) if p < 1 else math.inf
    return out


def _rate(rates: dict[tuple[str, str], dict[str, tuple[float, float]]], script: str, sort: str) -> float:
    """How often a character of the script's texts is followed by an end of this sort."""
    chars, ends = (sum(r[sort][j] for (_, s), r in rates.items() if s == script) for j in (0, 1))
    return min(max(ends / max(chars, 1), 1e-4), 0.5)


def _share(bins: dict[int, int], base: float, start: float, weight: float) -> float:
    """The share of cut values among a set of endings, by expectation maximisation."""
    share, n = start, sum(bins.values())
    for _ in range(50):
        odds = (1 - share) / share / max(base, 1e-9)
        cut = sum(m / (1 + odds / (1 + math.exp(min(-i * BIN, 60.0)))) for i, m in bins.items())
        share = min(max((cut + weight * start) / (n + weight), 1e-4), 1 - 1e-4)
    return share


def cut_off(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, source, kind, log_odds, threshold, is_cut) of every row; log_odds is null where the model isn't asked."""
    spark = df.sparkSession
    code = F.lower(F.trim(F.col(lang_col))) if lang_col in df.columns else F.lit(None).cast("string")
    code = F.when(code.rlike("^[a-z]{2,3}(-[a-z]{2,3})?$"), code).otherwise("und")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), code.alias("lang"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ends = rows.mapInArrow(_endings, f"doc_id {id_type}, source string, lang string, kind string, script string, key long, contexts array<long>, others int, n_line long, n_sentence long, n_clause long, n_chars long")
    ends, _ = written(ends, "cut")
    # copies of an ending are scored once
    endings = ends.where(F.col("contexts").isNotNull()).groupBy("key", "kind", "script").agg(F.count("*").alias("copies"), F.first("contexts").alias("contexts"), F.first("others").alias("others"))
    rates = {(r[0], r[1]): {s: (r[2], r[3 + i]) for i, s in enumerate(("line", "sentence", "clause"))} for r in ends.groupBy("lang", "script").agg(*(F.sum(c) for c in ("n_chars", "n_line", "n_sentence", "n_clause"))).collect()}
    asked = endings.select(F.explode("contexts").alias("c"))
    slot = F.shiftrightunsigned("c", 64 - BITS)
    words = asked.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(c, {64 - BITS}) & 63 as int))").alias("bit")).groupBy("w").agg(F.expr("bit_or(bit)").alias("bits"))
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    got = words.toPandas()  # at most 2^(BITS - 6) rows, however many texts there are
    bitmap[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    counts = rows.select("text").mapInArrow(_counts(shared), "context long, n long, line_ends long, sentence_ends long, clause_ends long").groupBy("context").agg(*(F.sum(c).alias(c) for c in ("n", "line_ends", "sentence_ends", "clause_ends")))
    met = endings.select("key", "kind", "script", "copies", "others", F.posexplode("contexts").alias("k", "context")).join(counts, "context")
    met = met.withColumn("copies", F.when(F.col("k") < F.col("others"), F.lit(0)).otherwise(F.col("copies")))  # their own line isn't counted there
    sort = F.coalesce(*(F.when(F.col("kind").isin([k for k, s in ASKED.items() if s == sort]), F.lit(sort)) for sort in ("line", "clause", "sentence")))
    own = F.when(sort == "sentence", F.lit(0)).otherwise(F.col("copies"))
    n = F.greatest(F.col("n") - F.col("copies"), F.lit(0))
    hits = F.greatest(F.when(sort == "line", F.col("line_ends")).when(sort == "clause", F.col("clause_ends")).otherwise(F.col("sentence_ends")) - own, F.lit(0))
    per = met.groupBy("key", "kind", "script").agg(F.array_sort(F.collect_list(F.struct("k", n.cast("double").alias("n"), hits.cast("double").alias("hits")))).alias("chain"))
    start = {(script, k): _rate(rates, script, s) for script in ("ideographic", "alphabetic") for k, s in ASKED.items()}
    base = F.coalesce(*(F.when((F.col("script") == s) & (F.col("kind") == k), F.lit(v)) for (s, k), v in start.items()))
    p = F.expr(f"aggregate(chain, base, (p, x) -> (x.hits + {PRIOR} * p) / (x.n + {PRIOR}))")
    scores = per.withColumn("base", base).select("key", "kind", F.log(p / (1 - F.least(p, F.lit(1 - 1e-9)))).alias("log_odds"))
    scored, _ = written(ends.select("doc_id", "source", "lang", "script", "kind", "key").join(scores, ["key", "kind"], "left"), "cut")
    # what reaches the driver: counts for each language, script, kind and bin
    seen: dict[tuple[str, str, str], dict[int, int]] = {}
    for r in scored.where(F.col("log_odds").isNotNull()).groupBy("lang", "script", "kind", F.round(F.col("log_odds") / BIN).cast("int").alias("bin")).count().collect():
        seen.setdefault((r[0], r[1], r[2]), {})[r[3]] = r[4]
    least = thresholds(seen, rates)
    limit = spark.createDataFrame([(*k, v) for k, v in least.items()], "lang string, script string, kind string, threshold double")
    out = scored.join(small_side(limit), ["lang", "script", "kind"], "left")
    is_cut = F.when(F.col("kind") == "broken", F.lit(True)).otherwise(F.coalesce(F.col("log_odds") < F.col("threshold"), F.lit(False)))
    return out.select("doc_id", "source", "kind", "log_odds", "threshold", is_cut.alias("is_cut"))


def cut_share(cut: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, share) per source."""
    return cut.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("is_cut").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
