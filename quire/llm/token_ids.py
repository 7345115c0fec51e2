"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. A piece is a row of live byte positions with a
segment tree over them; each leaf holds the rank of the pair that starts there, each inner node the minimum
below it. The root gives the lowest rank, a walk down that prefers the left gives its leftmost place; after a
merge, three leaves (the merged position, its left neighbour, the swallowed position) are updated and their
paths to the root repaired. Many pieces of one length class advance together, a merge each per round, as rows
of arrays. Pieces that occur again, in the batch or earlier in the worker, are looked up.

The tables (pair ranks, at most a fixed multiple of the vocabulary) are built on the driver from the
vocabulary file, whose path is a parameter, and broadcast.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary
text. Repeated rows are each encoded; other columns are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.blocks import blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
MEMO = 200_000  # pieces remembered in a worker before it starts anew


class PairTable:
    """Rank of a pair of token ids, as an open-addressing hash table; and the ids of single bytes."""

    def __init__(self, path: str = VOCABULARY):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        k, v = np.array(keys, np.uint64), np.array(values, np.int32)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE)
        slot, self.probes = self._slot(k), 1
        while len(k):  # of those that want the same free slot one gets it, the others try the next
            free = self.keys[slot] == np.uint64(2**64 - 1)
            self.keys[slot[free]] = k[free]
            won = free & (self.keys[slot] == k)
            self.ranks[slot[won]] = v[won]
            k, v, slot = k[~won], v[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(k))

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(k)
        out = np.where(self.keys[slot] == k, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != k) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == k[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (got != np.uint64(2**64 - 1))]
        return out

    def encode_class(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of 2 to width bytes; width is a power of two."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte_ids[raw]
        after = np.tile(np.arange(1, width + 1), (n, 1))  # size[i] stands for the end
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), NONE)
        pair = np.arange(width - 1)[None, :] < (size - 1)[:, None]
        r, c = np.nonzero(pair)
        tree[r, width + c] = self.rank(token[r, c], token[r, c + 1])
        span = width
        while span > 1:
            half = span // 2
            tree[:, half:span] = np.minimum(tree[:, span : 2 * span : 2], tree[:, span + 1 : 2 * span : 2])
            span = half
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            best = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            while node[0] < width:  # all rows walk down at the same pace
                node = 2 * node
                node += tree[rows, node] != best
            at = node - width
            gone = after[rows, at]
            nxt = after[rows, gone]
            token[rows, at] = best
            after[rows, at] = nxt
            inside = nxt < size[rows]
            before[rows[inside], nxt[inside]] = at[inside]
            tree[rows, width + gone] = NONE
            leaf = np.full(len(rows), NONE)
            leaf[inside] = self.rank(best[inside], token[rows[inside], nxt[inside]])
            tree[rows, node] = leaf
            prev = before[rows, at]
            has = prev >= 0
            tree[rows[has], width + prev[has]] = self.rank(token[rows[has], prev[has]], best[has])
            touched = np.concatenate([rows, rows, rows[has]])
            up = np.concatenate([node, width + gone, width + prev[has]])
            while up[0] > 1:
                up = up >> 1
                tree[touched, up] = np.minimum(tree[touched, 2 * up], tree[touched, 2 * up + 1])
            token[rows, gone] = -1
            rows = rows[tree[rows, 1] < NONE]
        live = (token >= 0) & (np.arange(width)[None, :] < size[:, None])
        flat = token[live]
        ends = np.cumsum(live.sum(1))
        return np.split(flat, ends[:-1])

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.whole.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            else:
                classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in classes.items():
            step = max(1, (1 << 18) // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, ids in zip(part, self.encode_class([pieces[j] for j in part], width)):
                    out[i] = ids
        return out


def _encode_batches(shared, column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        table: PairTable = shared.value
        find = regex.compile(PATTERN).findall
        memo: dict[str, np.ndarray] = {}
        for b in blocks(batches, column):
            found = [find(t) if t else [] for t in b.column(column).to_pylist()]
            index: dict[str, int] = {}
            where = np.fromiter((index.setdefault(p, len(index)) for f in found for p in f), np.int64)
            if len(memo) > MEMO:
                memo.clear()
            new = [p for p in index if p not in memo]
            memo.update(zip(new, table.encode([p.encode() for p in new])))
            ids = [memo[p] for p in index]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            begins = np.cumsum(sizes) - sizes
            n = sizes[where]
            ends = np.cumsum(n)
            values = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[where] - (ends - n), n)]
            docs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            offsets = np.concatenate([[0], ends])[docs].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c not in (name, column)), lists], names=[*(c for c in b.schema.names if c not in (name, column)), name])

    return run


def token_ids(df: DataFrame, column: str = "text", name: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the column name (array of int) in place of column."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(PairTable(vocabulary))
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema if f.name not in (name, column)), T.StructField(name, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_encode_batches(shared, column, name), schema)
