"""Evaluation passages in a training corpus.

Seeds: every n-gram of a normalised passage (letters and digits only, case and width folded) that is rare among
the items; what more than ``COMMON`` of them share doesn't tell one from another. One pass over the corpus joins
the n-grams of the documents with the seeds. Hits of a document and an item on near diagonals form a band; a
band that is dense enough is aligned (Smith-Waterman on characters, a row of the matrix at a time, within the
band's range and a margin), whatever the length of the text around it. A piece that an edit splits off goes on within the
band. A document is reported when its best stretch, or its two best ones, wherever in the text they stand, cover
enough of the passage.

Texts aren't shuffled. The passages are the small side: they are broadcast in groups whose seeds number at most
``GROUP``, so the size is bounded however many items there are. How many documents hold a seed doesn't matter, so
a passage that a third of all documents hold is found in each.

Defined results: null or empty texts hold nothing; a null or empty passage is held by none; items with equal
passages are each reported; repeated rows count once; empty tables give an empty table; ids keep their type.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blocks import blocks, code_points
from quire.session import small_side

WIDE, NARROW = 6, 16  # characters of a seed in ideographic and in alphabetic text
GROUP = 2_000_000
COMMON = 50  # items; an item of which most seeds are common keeps them
COVERED = 0.42  # share of a passage within the aligned stretches; an edit near an end takes a few characters from the half
STRETCH = 0.12  # a stretch counts from this share of the passage on
ALIKE = 0.4  # score of a stretch against the best one of its length; one changed word in ten leaves about 0.75
BAND = 16  # difference of neighbouring diagonals of one band
SEEN = 0.5  # share of a stretch that its seeds cover; with one word in ten changed it is 0.8 and more
DENSE = 0.25  # share of a band's range that its seeds cover
MATCH, MISMATCH, GAP = 2, -3, -3
NOT_TEXT = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return NOT_TEXT.sub("", text.casefold())


def _grams(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every seed: WIDE characters where they begin ideographic, else NARROW."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes, places = [], []
    wide = flat >= 0x2E80
    for k, want in ((WIDE, True), (NARROW, False)):
        m = len(flat) - k + 1
        if m <= 0:
            continue
        at = np.flatnonzero((wide[:m] == want) & (owner[:m] == owner[k - 1 :]))
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = (h ^ flat[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        hashes.append(h)
        places.append(at)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Passages:
    """The seeds of a group of items: sorted distinct hashes, and for each the items and places it belongs to."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for _, p in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        flat, bounds = code_points([p for _, p in items])
        h, at = _grams(flat, bounds)
        item = np.searchsorted(bounds, at, "right") - 1
        held = np.unique(np.stack([h, item.astype(np.uint64)]), axis=1)[0]
        seeds, n = np.unique(held, return_counts=True)
        rare = n[np.searchsorted(seeds, h)] <= COMMON
        few = np.bincount(item, rare, len(items)) < 0.5 * np.bincount(item, minlength=len(items))
        keep = rare | few[item]
        h, at, item = h[keep], at[keep], item[keep]
        order = np.lexsort((at, h))
        h, at, item = h[order], at[order], item[order]
        self.hashes, self.begin = np.unique(h, return_index=True)
        self.begin = np.append(self.begin, len(h))
        self.item, self.at, self.width = item, at - bounds[item], np.where(flat[at] >= 0x2E80, WIDE, NARROW)

    def found(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the seeds, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, i, -1)


def _prefilter(p: Passages, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is a seed, and the seeds: a table of leading bits first, then the search."""
    bits = np.zeros(1 << 20, bool)
    bits[(p.hashes >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
    seeds = p.found(h[maybe])
    return maybe[seeds >= 0], seeds[seeds >= 0]


PAIRS = 512  # alignments that advance together
CELLS = 1 << 17  # of a row of all these
WINDOW = 1 << 16  # characters of a text that are aligned at once


def _ends(pairs: list[tuple[np.ndarray, np.ndarray]], anchored: bool = False) -> list[tuple[int, int, int]]:
    """(score, a to, b to) of the best local alignment of each pair (a, b), zeros where nothing matches.

    All pairs advance by a row of their matrix at a time. Anchored: only of alignments that begin where both begin."""
    out = [(0, 0, 0)] * len(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: len(pairs[i][1]))
    k = 0
    while k < len(order):
        n = PAIRS
        while n > 1 and len(pairs[order[min(k + n, len(order)) - 1]][1]) * n > CELLS:
            n //= 2
        part = order[k : k + n]
        k += n
        rows, width = max(len(pairs[i][0]) for i in part), max(len(pairs[i][1]) for i in part)
        a = np.full((len(part), rows), 0xFFFFFFFF, np.uint32)
        b = np.full((len(part), width), 0xFFFFFFFE, np.uint32)
        for r, i in enumerate(part):
            a[r, : len(pairs[i][0])], b[r, : len(pairs[i][1])] = pairs[i]
        kind = np.int32 if 3 * width + 2 * rows < 1 << 30 else np.int64
        never = kind(-(1 << 30)) if kind is np.int32 else kind(-(1 << 60))
        slope = np.arange(width, dtype=kind) * kind(-GAP)
        above = np.zeros((len(part), width + 1), kind)  # the row above, shifted by one
        if anchored:
            above[:, 1:] = never
        best, best_row, best_col = np.zeros(len(part), kind), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        each = np.arange(len(part))
        for i in range(rows):
            cell = np.where(b == a[:, i : i + 1], kind(MATCH), kind(MISMATCH))
            cell += above[:, :-1]
            np.maximum(cell, above[:, 1:] + kind(GAP), out=cell)
            cell += slope
            np.maximum.accumulate(cell, axis=1, out=cell)
            cell -= slope
            if anchored:
                cell[cell <= 0] = never // 2
                above[:, 0] = never // 2
            else:
                np.maximum(cell, 0, out=cell)
            j = cell.argmax(1)
            top = cell[each, j]
            more = top > best
            best[more], best_row[more], best_col[more] = top[more], i, j[more]
            above[:, 1:] = cell
        for r, i in enumerate(part):
            if best[r] > 0:
                out[i] = (int(best[r]), int(best_row[r]) + 1, int(best_col[r]) + 1)
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
    """The best local alignment of each pair (a, b): (a from, a to, b from, b to, score), zeros where nothing matches.

    A long text goes in windows that overlap by twice a, more than an alignment with a can take of it. Where the
    best one begins is found from its end, backward."""
    parts = []
    for n, (a, b) in enumerate(pairs):
        size = max(WINDOW, 4 * len(a))
        parts += [(n, i, b[i : i + size]) for i in range(0, max(len(b) - 2 * len(a), 1), size - 2 * len(a))]
    ends = [(0, 0, 0)] * len(pairs)
    for (n, i, _), (score, a1, b1) in zip(parts, _ends([(pairs[n][0], b) for n, _, b in parts])):
        if score > ends[n][0]:
            ends[n] = (score, a1, i + b1)
    back = _ends([(a[:a1][::-1], b[max(0, b1 - 2 * a1) : b1][::-1]) for (a, b), (_, a1, b1) in zip(pairs, ends)], anchored=True)
    return [(a1 - n, a1, b1 - m, b1, score) for (score, a1, b1), (_, n, m) in zip(ends, back)]


def bands(p: Passages, flat: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """(passage from, to, text from, to) of the bands of each (document, item) that could cover enough of it."""
    h, at = _grams(flat, bounds)
    ok, seeds = _prefilter(p, h)
    n = np.diff(p.begin)[seeds]
    entry = np.repeat(p.begin[seeds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place = np.repeat(at[ok], n)
    doc = np.searchsorted(bounds, place, "right") - 1
    item, a, b = p.item[entry], p.at[entry], place - bounds[doc]
    key = doc * len(p.ids) + item
    order = np.lexsort((b - a, key))
    key, a, b, width = key[order], a[order], b[order], p.width[entry][order]
    band = np.cumsum((np.diff(key, prepend=-1) != 0) | (np.diff(b - a, prepend=0) > BAND))
    order = np.lexsort((a, band))
    key, a, b, width, band = key[order], a[order], b[order], width[order], band[order]
    first = np.flatnonzero(np.diff(band, prepend=0))
    if not len(first):
        return {}
    a0, a1 = np.minimum.reduceat(a, first), np.maximum.reduceat(a + width, first)
    b0, b1 = np.minimum.reduceat(b, first), np.maximum.reduceat(b + width, first)
    further = np.append(a[1:] - a[:-1], 0)  # characters of the passage that its seeds cover
    further[np.append(first[1:], len(a)) - 1] = 1 << 30
    seen = np.add.reduceat(np.minimum(width, further), first)
    key = key[first]
    size = p.sizes[key % len(p.ids)]
    enough = (seen >= SEEN * STRETCH * size) & (seen >= DENSE * (a1 - a0))
    out: dict[tuple[int, int], list] = {}
    for i in np.flatnonzero(enough):
        out.setdefault(divmod(int(key[i]), len(p.ids)), []).append((int(seen[i]), int(a0[i]), int(a1[i]), int(b0[i]), int(b1[i])))
    best = {k: sum(sorted((r for r, *_ in v), reverse=True)[:2]) for k, v in out.items()}
    return {k: [x[1:] for x in v] for k, v in out.items() if best[k] >= SEEN * COVERED * p.sizes[k[1]]}


def stretches(tasks: list[tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]]) -> list[tuple[int, int, int, int]]:
    """For each (passage, text, band) the aligned stretch in it: (passage from, to, text from, to)."""
    whole = [a1 - a0 == len(p) and np.array_equal(p, t[b0:b1]) for p, t, (a0, a1, b0, b1) in tasks]  # nothing to align
    if any(whole):
        others = iter(stretches([x for x, w in zip(tasks, whole) if not w]))
        return [x[2] if w else next(others) for x, w in zip(tasks, whole)]
    windows = []
    for p, t, (a0, a1, b0, b1) in tasks:
        m = 48 + len(p) // 8
        windows.append((max(0, a0 - m), min(len(p), a1 + m), max(0, b0 - m), min(len(t), b1 + m)))
    got, scores = [], []
    for (w0, _, v0, _), (a0, a1, b0, b1, score) in zip(windows, align([(p[w0:w1], t[v0:v1]) for (p, t, _), (w0, w1, v0, v1) in zip(tasks, windows)])):
        got.append((w0 + a0, w0 + a1, v0 + b0, v0 + b1))
        scores.append(score)
    rest = []  # what an edit split off goes on in the band
    for i, ((p, t, _), (w0, w1, v0, v1), (a0, a1, b0, b1)) in enumerate(zip(tasks, windows, got)):
        least = STRETCH * len(p)
        rest += [(i, x0, y0, p[x0:x1], t[y0:y1]) for x0, x1, y0, y1 in ((w0, a0, v0, b0), (a1, w1, b1, v1)) if alike(scores[i], a1 - a0) and x1 - x0 >= least and y1 > y0]
    for (i, x0, y0, p, _), (a0, a1, b0, b1, score) in zip(rest, align([(a, b) for *_, a, b in rest])):
        if a1 - a0 >= 0.5 * STRETCH * len(tasks[i][0]):
            x, y, u, v = got[i]
            more = (min(x, x0 + a0), max(y, x0 + a1), min(u, y0 + b0), max(v, y0 + b1))
            if alike(scores[i] + score, more[1] - more[0]):
                got[i], scores[i] = more, scores[i] + score
    return [x if alike(score, x[1] - x[0]) else (0, 0, 0, 0) for x, score in zip(got, scores)]


def alike(score: int, span: int) -> bool:
    return score >= ALIKE * MATCH * span


def coverage(size: int, found: list[tuple[int, int, int, int]]) -> float:
    """The share of a passage within its longest stretch, or the best two that don't share text."""
    some = sorted((x for x in set(found) if x[1] - x[0] >= STRETCH * size), key=lambda x: x[0] - x[1])
    best = 0
    for i, (a0, a1, b0, b1) in enumerate(some):
        best = max(best, a1 - a0)
        for c0, c1, d0, d1 in some[i + 1 :]:
            if c1 - c0 + a1 - a0 <= best:
                break
            if min(b1, d1) - max(b0, d0) <= 0.2 * (d1 - d0):
                best = max(best, a1 - a0 + c1 - c0 - max(0, min(a1, c1) - max(a0, c0)))
    return best / size


def _candidates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Passages = shared.value
        for b in blocks(batches, "text"):
            flat, bounds = code_points([normalised(t) for t in b.column("text").to_pylist()])
            tasks = [(k, band) for k, found in bands(p, flat, bounds).items() for band in found]
            held: dict[tuple[int, int], list] = {}
            for (k, _), x in zip(tasks, stretches([(p.texts[i], flat[bounds[d] : bounds[d + 1]], band) for (d, i), band in tasks])):
                held.setdefault(k, []).append(x)
            out = [(d, i, c) for (d, i), found in held.items() if (c := coverage(int(p.sizes[i]), found)) >= COVERED]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["doc_id", "item", "covered"])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """(doc_id, item_id, covered): documents with the items they hold, covered being the share of the passage."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    named = items.select(F.col(item_col).alias("item_id"), F.col(passage_col).alias("passage")).distinct()
    groups: list[list[tuple[object, str]]] = [[]]
    held = 0
    for item, passage in named.toLocalIterator():
        text = normalised(passage)
        if not text or item is None:
            continue
        if held + len(text) > GROUP and groups[-1]:
            groups.append([])
            held = 0
        groups[-1].append((item, text))
        held += len(text)
    types = {f.name: f.dataType.simpleString() for f in (*rows.schema, *named.schema)}
    whole = spark.createDataFrame([], f"doc_id {types['doc_id']}, item_id {types['item_id']}, covered double")
    for group in groups:
        if not group:
            continue
        p = Passages(group)
        part = rows.mapInArrow(_candidates(spark.sparkContext.broadcast(p)), f"doc_id {types['doc_id']}, item long, covered double")
        ids = spark.createDataFrame([(n, i) for n, i in enumerate(p.ids)], f"item long, item_id {types['item_id']}")
        whole = whole.unionByName(part.join(small_side(ids), "item").select("doc_id", "item_id", "covered"))
    return whole.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))
