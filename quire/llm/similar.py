"""The k most similar vectors of every vector.

Equal directions are one point with its members' ids, so groups of copies, however large, meet once. The
points are assigned to coarse cells; within a cell, residuals are quantised with 16 words per pair of
dimensions (four bits a code). The words are fitted with a score-aware, anisotropic loss: the error parallel
to the vector costs more than the error across it, which is what inner products of close vectors suffer
from. A query builds the tables of its products with all words, scans the codes of the cells it visits by
table look-up, and the best candidates are reranked with the exact vectors.

Cells and words are fitted on a bounded sample (``SAMPLE`` points); every point is indexed and every point is
a query. How many cells a query visits is measured, at every size: the neighbours of ``ASKED`` points are
searched exactly among all points, and so many cells are visited that these hold ``REACH`` of them.

On disk there is little but the index, about as large as the input: a vector is moved once, packed, to the area
of its cell (near cells form areas) and stored there as it came, with its code and the ids of its members. No
query is moved, and no candidate: a task takes queries of one area, reads the areas that hold their cells from
the shared folder, ``BLOCK`` points at a time, and keeps the best k of each query. It answers with ids, so that
nothing is joined after it.

Defined results: vectors that are null, of another length, all zero or hold a null or NaN are ignored; rows
repeated in full count once, and of several vectors of one id the smallest counts; ties of similarity go to
the smaller id; with fewer than k others all are given; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import small_side, written

DIM, SUB, WORDS = 64, 32, 16
SAMPLE = 40_000  # points that cells and words are fitted on
CELL = 400  # points of a cell on average
MAX_CELLS = 8_192
REACH = 0.97  # share of true neighbours that lie in the cells a query visits, as measured on ASKED points
ASKED = 512  # points whose neighbours are searched exactly, to choose how many cells a query visits
AREA = 24  # near cells that are stored together, and whose points ask in one task
ETA = 4.0  # weight of the parallel error against the error across
RERANK = 64  # candidates of a query and cell that are scored exactly
SCAN = 4_096  # points of a cell that are scanned together
BLOCK = 16_384  # points of an area that are read at once
QUERIES = 1_024  # scored at once
ASKING = 16_384  # queries of an area that go to one task
MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, DIM), np.uint64) << np.uint64(1) | np.uint64(1)  # of the hash of a point


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; an empty cell takes a random point."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-12), x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


class Quantiser:
    """Coarse cells, and score-aware words for the residuals."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.cells = _kmeans(sample, min(cells, len(sample)), 8, rng)
        own = self.cell_of(sample, 1)[:, 0]
        residual = sample - self.cells[own]
        width = DIM // SUB
        self.words = np.zeros((SUB, WORDS, width), np.float32)
        parts, along = residual.reshape(-1, SUB, width), sample.reshape(-1, SUB, width)
        for s in range(SUB):
            r, x = parts[:, s], along[:, s]
            w = r[rng.choice(len(r), WORDS, replace=len(r) < WORDS)].copy()
            for _ in range(10):
                code = self._losses(r, x, w).argmin(1)
                for j in range(WORDS):  # the weighted mean that minimises the anisotropic loss
                    m = code == j
                    if m.any():
                        u = x[m] / np.maximum(np.linalg.norm(x[m], axis=1, keepdims=True), 1e-9)
                        a = np.eye(width) * m.sum() + (ETA - 1) * u.T @ u
                        b = r[m].sum(0) + (ETA - 1) * (u * (u * r[m]).sum(1, keepdims=True)).sum(0)
                        w[j] = np.linalg.solve(a, b)
            self.words[s] = w
        self.probes = len(self.cells)  # cells a query visits
        self.area = self._areas(rng)

    def _areas(self, rng: np.random.Generator) -> np.ndarray:
        """Area of each cell: near cells together, at most 2 * AREA."""
        own = (self.cells @ _kmeans(self.cells, -(-len(self.cells) // AREA), 8, rng).T).argmax(1)
        area, n = np.zeros(len(own), np.int32), 0
        for a in np.unique(own):
            members = np.flatnonzero(own == a)
            for i in range(0, len(members), 2 * AREA):
                area[members[i : i + 2 * AREA]] = n
                n += 1
        return area

    @staticmethod
    def _losses(r: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        across = (w * w).sum(1)[None] - 2 * r @ w.T  # up to a constant of the row
        return across + (ETA - 1) * ((u * r).sum(1, keepdims=True) - u @ w.T) ** 2

    def cell_of(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each point, the nearest first."""
        out = []
        for i in range(0, len(x), 2048):
            score = x[i : i + 2048] @ self.cells.T
            n = min(n, score.shape[1])
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(top, np.take_along_axis(-score, top, 1).argsort(1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Codes of points, two to a byte."""
        r = (x - self.cells[own]).reshape(-1, SUB, DIM // SUB)
        a = x.reshape(-1, SUB, DIM // SUB)
        code = np.stack([self._losses(r[:, s], a[:, s], self.words[s]).argmin(1) for s in range(SUB)], 1).astype(np.uint8)
        return code[:, 0::2] << 4 | code[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(SUB, queries, WORDS): the products of each query with the words, in 8-bit steps of the query."""
        p = np.einsum("qsd,swd->sqw", q.reshape(-1, SUB, DIM // SUB), self.words)
        low = p.min(2, keepdims=True)
        step = np.maximum((p - low).max((0, 2)), 1e-9) / 255
        return np.round((p - low) / step[None, :, None]).astype(np.uint8)


class Packing:
    """Vectors in few bits a value, where a sample has few different values; others as they are. Nothing is lost."""

    def __init__(self, sample: np.ndarray):
        values = np.unique(sample)
        self.values = values if len(values) <= 1 << 16 else np.zeros(0, np.float32)
        self.bits = max(1, (len(self.values) - 1).bit_length())

    def pack(self, x: np.ndarray) -> list[bytes]:
        if not len(self.values):
            return [r.tobytes() for r in x]
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        known = (self.values[at] == x).all(1)
        bits = (at[:, :, None] >> np.arange(self.bits) & 1).astype(np.uint8).reshape(len(x), -1)
        return [(p if k else r).tobytes() for p, k, r in zip(np.packbits(bits, axis=1), known, x)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        out = np.zeros((len(packed), DIM), np.float32)
        whole = np.fromiter((len(p) == 4 * DIM for p in packed), bool, len(packed))
        out[whole] = np.frombuffer(b"".join(p for p, w in zip(packed, whole) if w), np.float32).reshape(-1, DIM)
        if not whole.all():
            raw = np.frombuffer(b"".join(p for p, w in zip(packed, whole) if not w), np.uint8).reshape(-1, DIM * self.bits // 8)
            bits = np.unpackbits(raw, axis=1).reshape(-1, DIM, self.bits)
            out[~whole] = self.values[bits @ (1 << np.arange(self.bits))]
        return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps of 2^-22, so that multiples of one vector become equal."""
    x = x.astype(np.float64)
    return np.round((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) * 2**22).astype(np.int32)


def _unit(steps: np.ndarray) -> np.ndarray:
    return steps.astype(np.float32) / np.float32(2**22)


def _points(steps: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    y = (steps.astype(np.int64).view(np.uint64) + MIX[0]) * np.uint64(0x9E3779B97F4A7C15)
    y = ((y ^ y >> np.uint64(32)) * MIX[1]).sum(1, dtype=np.uint64)
    y = (y ^ y >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (y ^ y >> np.uint64(32)).view(np.int64)


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector can be used, and these vectors."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == DIM)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, DIM)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, usable rows, their vectors, steps and points)."""
    for b in batches:
        rows, x = _usable(b.column("v"))
        if len(rows):
            steps = _steps(x)
            yield b, rows, x, steps, _points(steps)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, rows, _, _, points in _batches(batches):
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(points)], names=["id", "point"])


def _drawn(below: int):
    """Points whose hash says so, once for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, x, _, points in _batches(batches):
            drawn = np.flatnonzero((points.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(34)).astype(np.int64) < below)
            new = [i for i, p in zip(drawn.tolist(), points[drawn].tolist()) if p not in seen and not seen.add(p)]
            yield pa.RecordBatch.from_arrays([pa.array(points[new]), pa.array([x[i].tobytes() for i in new], pa.binary())], names=["point", "vector"])

    return run


def _exact(shared, asked: np.ndarray, k: int):
    """The k points of a partition that are most similar to each of the asked ones, by exact products, with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, near = np.zeros((len(asked), 0), np.float32), np.zeros((len(asked), 0), np.int64)
        cell: dict[int, int] = {}
        seen: set[int] = set()
        for _, _, _, steps, points in _batches(batches):
            new = [i for i, p in enumerate(points.tolist()) if p not in seen and not seen.add(p)]
            for i in range(0, len(new), 4096):
                part, which = _unit(steps[new[i : i + 4096]]), points[new[i : i + 4096]]
                s = asked @ part.T
                s[s > 1 - 1e-6] = -2.0  # itself
                top = np.argpartition(-s, min(k, len(part)) - 1, axis=1)[:, :k]
                score, near = np.concatenate([score, np.take_along_axis(s, top, 1)], 1), np.concatenate([near, which[top]], 1)
                best = np.argsort(-score, axis=1)[:, :k]
                score, near = np.take_along_axis(score, best, 1), np.take_along_axis(near, best, 1)
                fresh = np.flatnonzero(np.isin(which, near))
                cell.update(zip(which[fresh].tolist(), shared.value.cell_of(part[fresh], 1)[:, 0].tolist()))
        who, j = np.nonzero(score > -2.0)
        found = near[who, j]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(score[who, j].astype(np.float64)), pa.array(found), pa.array([cell[p] for p in found.tolist()], pa.int64())], names=["who", "similarity", "point", "cell"])

    return run


def probes_needed(rows: DataFrame, shared, asked: np.ndarray, k: int) -> int:
    """How many cells the asked points must visit, so that these hold REACH of their k nearest among all points."""
    from pyspark.sql import Window as W

    near = rows.select("v").mapInArrow(_exact(shared, asked, k), "who long, similarity double, point long, cell long")
    near = near.groupBy("who", "point").agg(F.max("similarity").alias("similarity"), F.first("cell").alias("cell"))
    best = near.withColumn("r", F.row_number().over(W.partitionBy("who").orderBy(F.desc("similarity"), "point"))).where(F.col("r") <= k)
    got = best.select("who", "cell").collect()
    if not got:
        return 1
    order = shared.value.cell_of(asked, len(shared.value.cells))[[r[0] for r in got]]
    place = np.sort((order == np.array([r[1] for r in got])[:, None]).argmax(1))
    return int(place[math.ceil(REACH * len(place)) - 1]) + 1


def _assign(shared, packing: Packing, k: int):
    """Every vector with its cell; of many copies in a batch, those of the k + 2 smallest ids, which say that there are more than k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser: Quantiser = shared.value
        for b, rows, x, steps, points in _batches(batches):
            ids = b.column("id").take(pa.array(rows))
            _, group, count = np.unique(points, return_inverse=True, return_counts=True)
            keep = count[group] <= k + 2
            for g in np.flatnonzero(count > k + 2):
                some = np.flatnonzero(group == g)
                first = {i: n for n, i in zip(some.tolist(), ids.take(pa.array(some)).to_pylist())}
                keep[[first[i] for i in sorted(first)[: k + 2]]] = True
            at = np.flatnonzero(keep)
            cell = quantiser.cell_of(_unit(steps[at]), 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(quantiser.area[cell]), pa.array(cell), pa.array(points[at]), ids.take(pa.array(at)), pa.array(packing.pack(x[at]), pa.binary())], names=["area", "cell", "point", "id", "packed"])

    return run


def _stored(shared, packing: Packing, k: int):
    """Rows sorted by area, cell, point and id: one for each point, with its first k + 1 ids; many is its hash if it has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser: Quantiser = shared.value
        kept: list[pa.RecordBatch] = []  # rows of the last point, which may go on
        while True:
            b = next(batches, None)
            t = pa.Table.from_batches([*kept, *([] if b is None else [b])]) if kept or b is not None else None
            if t is None:
                return
            points = t["point"].to_numpy()
            end = t.num_rows if b is None else int(np.flatnonzero(np.diff(points, prepend=~points[:1]))[-1]) if len(points) else 0
            kept = t.slice(end).combine_chunks().to_batches() if b is not None else []
            if end:
                t = t.slice(0, end).combine_chunks()
                points, ids = points[:end], t["id"].combine_chunks()
                same = np.diff(points, prepend=~points[:1]) == 0
                again = same.copy()
                again[1:] &= pc.equal(ids.slice(1), ids.slice(0, end - 1)).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(~again)
                first = np.flatnonzero(~same[rows])
                count = np.diff(first, append=len(rows))
                named = rows[np.arange(len(rows)) - np.repeat(first, count) < k + 1]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(count, k + 1))]).astype(np.int32)), ids.take(pa.array(named)))
                at = rows[first]
                cell = t["cell"].to_numpy()[at]
                x = packing.unpack(t["packed"].take(pa.array(at)).to_pylist())
                codes = quantiser.encode(_unit(_steps(x)), cell)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(quantiser.area[cell]), pa.array(cell), lists, pa.array(points[at], mask=count <= k + 1), pa.array([c.tobytes() for c in codes], pa.binary()), vectors], names=["area", "cell", "ids", "many", "code", "v"])
            if b is None:
                return

    return run


def _read(files: list[str], columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number of the first row, rows) of the stored points of an area."""
    at = 0
    for uri in files:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(BLOCK, columns=columns):
                yield at, b
                at += b.num_rows


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return _unit(_steps(b.column("v").flatten().to_numpy().reshape(-1, DIM)))


class _Best:
    """The best k of each query so far: similarities, and where the points are stored (area << 32 | row)."""

    def __init__(self, quantiser: Quantiser, q: np.ndarray, at: np.ndarray, k: int):
        self.quantiser, self.q, self.at, self.k = quantiser, q, at, k
        self.score, self.other = np.full((len(q), k), -2.0, np.float32), np.full((len(q), k), -1, np.int64)
        self.tables = quantiser.tables(q).transpose(0, 2, 1).astype(np.uint16)  # the cell's own share of the product is the same for all its points

    def scan(self, rows: np.ndarray, x: np.ndarray, codes: np.ndarray, places: np.ndarray) -> None:
        """The points of one cell, met by the queries rows."""
        q, n = self.q[rows], len(x)
        if n > RERANK:
            tables = self.tables[:, :, rows]
            total, one = np.zeros((n, len(rows)), np.uint16), np.empty((n, len(rows)), np.uint16)
            for s in range(SUB):
                total += np.take(tables[s], codes[s], axis=0, out=one, mode="clip")
            key = np.ascontiguousarray(total.T).astype(np.uint32) * np.uint32(SCAN) + np.arange(n, dtype=np.uint32)
            best = np.partition(key, n - RERANK, axis=1)[:, n - RERANK :] % np.uint32(SCAN)
            score = (x[best] @ q[:, :, None])[:, :, 0]
            other = places[best]
        else:
            score = q @ x.T
            other = np.broadcast_to(places, score.shape)
        score = np.concatenate([self.score[rows], np.where(other == self.at[rows][:, None], np.float32(-2.0), score)], 1)
        other = np.concatenate([self.other[rows], other], 1)
        top = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
        self.score[rows], self.other[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(other, top, 1)


def _asked(quantiser: Quantiser, files: dict[int, list[str]], area: int, start: int, k: int) -> tuple[_Best, pa.Array]:
    """The queries of one task, having visited their cells, and the ids of each."""
    at, ids, x = [], [], []
    for first, b in _read(files[area], ["ids", "many", "v"]):
        lo, hi = max(start - first, 0), min(start + ASKING - first, b.num_rows)
        if lo < hi:
            rows = lo + np.flatnonzero(b.column("many").slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False))
            at.append(np.int64(area) << 32 | first + rows)
            ids.append(b.column("ids").take(pa.array(rows)))
            x.append(_vectors(b)[rows])
    best = _Best(quantiser, np.concatenate(x), np.concatenate(at), k)
    near = quantiser.cell_of(best.q, quantiser.probes)
    order = near.ravel().argsort(kind="stable")
    bounds = np.searchsorted(near.ravel()[order], np.arange(len(quantiser.cells) + 1))
    order //= near.shape[1]
    for there in np.unique(quantiser.area[near]).tolist():
        for first, b in _read(files.get(there, []), ["cell", "code", "v"]):
            cell = b.column("cell").to_numpy()
            sort = cell.argsort(kind="stable")
            cell, points, places = cell[sort], _vectors(b)[sort], np.int64(there) << 32 | first + sort
            packed = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, SUB // 2)[sort]
            codes = np.stack([packed >> 4, packed & 15], 2).reshape(-1, SUB).T.astype(np.intp)
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(cell)]):
                rows = order[bounds[cell[lo]] : bounds[cell[lo] + 1]]
                for r in range(0, len(rows), QUERIES):
                    for i in range(lo, hi, SCAN):
                        j = min(i + SCAN, hi)
                        best.scan(rows[r : r + QUERIES], points[i:j], codes[:, i:j], places[i:j])
    return best, pa.concat_arrays(ids)


def _answers(best: _Best, ids: pa.Array, files: dict[int, list[str]], k: int, least: float) -> pa.RecordBatch:
    """From points to their members: every id sees the first members of the near points, and of its own."""
    who, j = np.nonzero((best.score > -2.0) & (best.score.astype(np.float64) >= least))
    score = best.score[who, j].astype(np.float64)
    places, at = np.unique(best.other[who, j], return_inverse=True)
    names = []
    for area in np.unique(places >> 32).tolist():
        here = places[places >> 32 == area] & 0xFFFFFFFF
        for first, b in _read(files[area], ["ids"]):
            names.append(b.column("ids").take(pa.array(here[(here >= first) & (here < first + b.num_rows)] - first)))
    names = pa.concat_arrays(names) if names else pa.array([], pa.list_(pa.string()))
    many = pc.list_value_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(many)])
    flat = names.flatten()
    rank = np.empty(len(flat), np.int64)
    rank[pc.sort_indices(flat).to_numpy()] = np.arange(len(flat))
    times = many[at]
    entry = np.repeat(starts[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    who, score = np.repeat(who, times), np.repeat(score, times)
    order = np.lexsort((rank[entry], -score, who))
    who, score, entry = who[order], score[order], entry[order]
    own = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    place = np.arange(len(who)) - np.searchsorted(who, who)
    one = np.flatnonzero((own[who] == 1) & (place < k))
    out = [pa.RecordBatch.from_arrays([pc.list_element(ids.take(pa.array(who[one])), 0), flat.take(pa.array(entry[one])), pa.array(score[one]), pa.array((place[one] + 1).astype(np.int32))], names=NAMES)]
    rows: list[tuple[str, str, float, int]] = []
    for q in np.flatnonzero(own > 1):
        members = ids[int(q)].as_py()
        lo, hi = np.searchsorted(who, [q, q + 1])
        seen = [(-s, n) for s, n in zip(score[lo:hi].tolist(), flat.take(pa.array(entry[lo:hi])).to_pylist())] + [(-1.0, m) for m in members if least <= 1.0]
        seen.sort()
        for m in members:
            rows += [(m, n, -s, i + 1) for i, (s, n) in enumerate([x for x in seen[: k + 1] if x[1] != m][:k])]
    out.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.int32()))], names=NAMES))
    return pa.Table.from_batches(out).combine_chunks()


NAMES = ["id", "neighbour", "similarity", "rank"]


def _answered(shared, tasks: list[tuple[int, int]], files: dict[int, list[str]], k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column("id").to_pylist():
                yield from _answers(*_asked(shared.value, files, *tasks[task], k), files, k, least).to_batches()

    return run


def rows_of(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) with one direction for each id, rows that repeat or can't be used among them; and about how many points there are."""
    v = F.col(vector_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("string").alias("id"), v.alias("v")).where(F.col("id").isNotNull())
    # ids meet by their hash; where two share one, they only count as to be looked at
    each = rows.mapInArrow(_keyed, "id string, point long").groupBy(F.xxhash64("id").alias("key")).agg(F.min("point").alias("low"), F.max("point").alias("high"))
    open_, n = each.agg(F.sum((F.col("low") != F.col("high")).cast("long")), F.approx_count_distinct("low", 0.01)).first()
    if open_:
        keyed, several = rows.withColumn("key", F.xxhash64("id")), each.where("low <> high").select("key")
        ok = (F.size("v") == DIM) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
        least = keyed.where(ok).join(several, "key", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        rows, _ = written(keyed.join(several, "key", "left_anti").select("id", "v").unionByName(least), "similar")
    return rows, n


def neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 10, seed: int = 11, least: float = -2.0) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar others of every usable vector, those of at least this similarity."""
    spark = df.sparkSession
    rows, n = rows_of(df, id_col, vector_col)
    if n == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    draw = lambda share: sorted((r[0], r[1]) for r in rows.select("v").mapInArrow(_drawn(int((1 << 30) * share)), "point long, vector binary").dropDuplicates(["point"]).collect())
    drawn = draw(min(1.0, 0.95 * SAMPLE / n) if n > SAMPLE else 1.0)
    plain = np.frombuffer(b"".join(r[1] for r in drawn), np.float32).reshape(-1, DIM)
    sample, packing = _unit(_steps(plain)), Packing(plain)
    cells = max(1, min(MAX_CELLS, len(sample) // 4, math.ceil(n / CELL)))
    quantiser = Quantiser(sample, cells, seed)
    if cells > 1:
        asked = sample[np.random.default_rng(seed).permutation(len(sample))[:ASKED]]
        quantiser.probes = probes_needed(rows, spark.sparkContext.broadcast(quantiser), asked, k)
    shared = spark.sparkContext.broadcast(quantiser)
    moved = rows.mapInArrow(_assign(shared, packing, k), "area int, cell int, point long, id string, packed binary")
    points = moved.repartition("area").sortWithinPartitions("area", "cell", "point", "id").mapInArrow(_stored(shared, packing, k), "area int, cell int, ids array<string>, many long, code binary, v array<float>")
    index, _ = written(points.sortWithinPartitions("area", "cell"), "similar", by="area")
    files: dict[int, list[str]] = {}
    for uri in sorted(index.inputFiles()):
        files.setdefault(int(uri.split("/area=")[1].split("/")[0]), []).append(uri.replace("s3a://", "s3://"))
    sizes = index.groupBy("area").agg(F.count("*").alias("n"), F.count("many").alias("many")).collect()
    tasks = [(r["area"], start) for r in sorted(sizes) for start in range(0, r["n"], ASKING)]
    schema = "id string, neighbour string, similarity double, rank int"
    near = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(_answered(shared, tasks, files, k, least), schema)
    if least <= 1.0 and any(r["many"] for r in sizes):  # with more than k copies, these are what their ids see
        many = small_side(index.where("many IS NOT NULL").select(F.col("many").alias("point"), "ids"))
        others = F.slice(F.filter("ids", lambda i: i != F.col("id")), 1, k)
        copies = rows.mapInArrow(_keyed, "id string, point long").join(many, "point").distinct().select("id", F.posexplode(others).alias("rank", "neighbour"))
        near = near.unionByName(copies.select("id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("rank") + 1).alias("rank")))
    return near


def close_pairs(df: DataFrame, id_col: str, vector_col: str, least: float = 0.95, k: int = 10) -> DataFrame:
    """(id_a, id_b): pairs of at least this similarity where one is among the k most similar of the other."""
    near = neighbours(df, id_col, vector_col, k, least=least)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
