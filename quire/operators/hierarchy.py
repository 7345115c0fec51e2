"""Parent-child rows to full hierarchies.

Three steps. (1) Connected components by pointer doubling: every node has at most one parent, so after k
rounds a node knows its ancestor 2^k levels up; a component is named by its root, or by the smallest id of
its cycle. The number of rounds is the logarithm of the depth. (2) Each component is co-located by its name.
(3) In each component an iterative depth-first traversal colours nodes white, grey and black and gives
paths, depths, descendant counts and back edges (cycles). A component above ``max_component`` nodes or
``MAX_VOLUME`` path entries isn't brought together: its paths are doubled by joins instead, with the same
result; its cycle is the image of the doubled pointers.

Defined results: a row with a null id is ignored; rows repeated in full count once; an id with several
parents keeps the smallest parent that isn't empty; a null, empty or dangling parent makes a root; a node
that is its own parent is a cycle of one; a node whose chain of parents ends in a cycle has that cycle's
cycle_id and null path, depth and root. An empty table gives an empty table. Other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import dropped, written

MAX_COMPONENT = 200_000  # nodes that one task takes
MAX_VOLUME = 50_000_000  # path entries that one task makes
FLUSH = 200_000  # path entries that are handed on together
SCHEMA = "id string, root string, depth int, path array<string>, n_descendants long, cycle_id string, on_cycle boolean"


def parent_links(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, par): one row per id; par is null for roots."""
    raw = df.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("par"))
    one = raw.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.when(F.length("par") > 0, F.col("par"))).alias("par"))
    # only rows that name a parent are joined: the roots would share one join key
    real = one.where(F.col("par").isNotNull()).join(one.select(F.col("id").alias("par"), F.lit(True).alias("there")), "par", "left")
    linked = real.select("id", F.when(F.col("there"), F.col("par")).alias("par"))
    return linked.unionByName(one.where(F.col("par").isNull()))


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, par, comp, cyclic, dist, on_cycle) and the written stages behind it.

    dist is the number of steps to the root. Rooted nodes are done when no more of them arrive in a round: with a node
    of some depth there are nodes of every smaller one, so the rest never arrives. The rest are the cyclic components,
    and rounds go on with these alone, until the pointers' images (then the cycles themselves) and the smallest
    ids met are stable."""
    spark = links.sparkSession
    has = F.col("par").isNotNull()
    start = links.select("id", "par", F.when(has, F.col("par")).alias("ptr"), F.when(~has, F.col("id")).alias("top"), F.col("id").alias("low"), has.cast("long").alias("dist"))
    state, at = written(start, "hierarchy")

    def doubled(left: DataFrame) -> DataFrame:
        to = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("top").alias("top2"), F.col("low").alias("low2"), F.col("dist").alias("dist2"))
        return left.join(to, "ptr").select("id", "par", F.col("ptr2").alias("ptr"), F.col("top2").alias("top"), F.least("low", "low2").alias("low"), (F.col("dist") + F.col("dist2")).alias("dist"))

    before = None
    while (n := state.where(F.col("ptr").isNotNull()).count()) and n != before:
        before = n
        state, new = written(doubled(state.where(F.col("ptr").isNotNull())).unionByName(state.where(F.col("ptr").isNull())), "hierarchy")
        dropped(spark, at)
        at = new
    done = state.where(F.col("ptr").isNull()).select("id", "par", F.col("top").alias("comp"), F.lit(False).alias("cyclic"), "dist", F.lit(False).alias("on_cycle"))
    stages = [at]
    if n:
        state, at = written(state.where(F.col("ptr").isNotNull()), "hierarchy")
        before = None
        while True:
            r = state.agg(F.count_distinct("ptr").alias("images"), F.sum(F.xxhash64("low").cast("decimal(38,0)")).alias("lows")).first()
            if (now := (r["images"], r["lows"])) == before:
                break
            before = now
            state, new = written(doubled(state), "hierarchy")
            dropped(spark, at)
            at = new
        stages.append(at)
        lows = state.select(F.col("id").alias("ptr"), F.col("low").alias("comp"))
        ring = state.select(F.col("ptr").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
        looped = state.join(lows, "ptr").join(ring, "id", "left")
        done = done.unionByName(looped.select("id", "par", "comp", F.lit(True).alias("cyclic"), "dist", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")))
    return done, stages


def cycles(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_component: int = MAX_COMPONENT) -> DataFrame:
    """(id, cycle_id, on_cycle) of the nodes that reach no root. Only cyclic components are traversed; no path is made."""
    nodes, _ = components(parent_links(df, id_col, parent_col))
    return _tree(nodes.where("cyclic"), max_component).select("id", "cycle_id", "on_cycle")


def _traverse(parent: dict[str, str | None], cycle: str | None) -> Iterator[tuple]:
    """Depth-first traversal of one component with node colouring; yields rows of SCHEMA."""
    if not parent:
        return
    children: dict[str, list[str]] = {}
    starts = []
    for node, par in parent.items():
        if par is None:
            starts.append(node)
        else:
            children.setdefault(par, []).append(node)
    ring: list[str] = []
    if not starts:  # a back edge closes the chain of parents: walk it with grey nodes until one comes again
        grey: dict[str, int] = {}
        node = min(parent)
        walk = []
        while node not in grey:
            grey[node] = len(walk)
            walk.append(node)
            node = parent[node]
        ring = walk[grey[node] :]
        starts = [min(ring)]
    colour: dict[str, int] = {}
    below: dict[str, int] = {}
    rings = set(ring)
    for start in starts:
        path: list[str] = []
        todo = [(start, False)]
        while todo:
            node, leaving = todo.pop()
            if leaving:
                colour[node] = 2
                path.pop()
                if path:
                    below[path[-1]] = below.get(path[-1], 0) + below.get(node, 0) + 1
                if ring:
                    yield (node, None, None, None, None, cycle, node in rings)
                else:
                    yield (node, start, len(path), [*path, node], below.get(node, 0), None, False)
                continue
            if node in colour:  # grey or black: the back edge of a cycle
                continue
            colour[node] = 1
            path.append(node)
            todo.append((node, True))
            todo.extend((c, False) for c in children.get(node, ()))


def _traverse_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components arrive whole and sorted by name within a partition; one at a time is held."""
    types = pa.schema([("id", pa.string()), ("root", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("n_descendants", pa.int64()), ("cycle_id", pa.string()), ("on_cycle", pa.bool_())])
    out: list[tuple] = []
    volume = 0  # path entries that out holds
    name, cyclic, held = None, False, {}

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types.types)], schema=types)
        out.clear()
        nonlocal volume
        volume = 0
        return b

    def rows(parent: dict[str, str | None], cycle: str | None) -> Iterator[pa.RecordBatch]:
        nonlocal volume
        for row in _traverse(parent, cycle):
            out.append(row)
            volume += 1 + (row[2] or 0)
            if volume >= FLUSH:
                yield flush()

    for batch in batches:
        for comp, node, par, cyc in zip(*(batch.column(c).to_pylist() for c in ("comp", "id", "par", "cyclic"))):
            if comp != name:
                yield from rows(held, name if cyclic else None)
                name, cyclic, held = comp, cyc, {}
            held[node] = par
    yield from rows(held, name if cyclic else None)
    yield flush()


def _doubled(nodes: DataFrame) -> DataFrame:
    """The same rows for components too large for one task, by doubling of paths. nodes: (id, par, comp, cyclic)."""
    spark = nodes.sparkSession
    trees = nodes.where(~F.col("cyclic"))
    state, at = written(trees.select("id", "comp", F.col("par").alias("ptr"), F.array("id").alias("path")), "hierarchy")
    while state.where(F.col("ptr").isNotNull()).limit(1).count():
        up = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("path").alias("path2"))
        moved = state.where(F.col("ptr").isNotNull()).join(up, "ptr").select("id", "comp", F.col("ptr2").alias("ptr"), F.concat("path2", "path").alias("path"))
        state, new = written(moved.unionByName(state.where(F.col("ptr").isNull())), "hierarchy")
        dropped(spark, at)
        at = new
    above = state.select(F.explode("path").alias("id")).groupBy("id").agg((F.count("*") - 1).alias("n_descendants"))
    paths = state.join(above, "id").select("id", F.col("comp").alias("root"), (F.size("path") - 1).alias("depth"), "path", "n_descendants", F.lit(None).cast("string").alias("cycle_id"), F.lit(False).alias("on_cycle"))
    none = {"root": "string", "depth": "int", "path": "array<string>", "n_descendants": "long"}
    loops = nodes.where("cyclic").select("id", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.col("comp").alias("cycle_id"), "on_cycle")
    return paths.unionByName(loops)


def _tree(nodes: DataFrame, max_component: int, max_volume: int = MAX_VOLUME) -> DataFrame:
    volume = F.sum(F.when(F.col("cyclic"), F.lit(0)).otherwise(F.col("dist") + 1))
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"), volume.alias("volume")).where((F.col("size") > max_component) | (F.col("volume") > max_volume))
    large, _ = written(sizes.select("comp"), "hierarchy")
    if large.limit(1).count() == 0:
        here, there = nodes, None
    else:
        here, there = nodes.join(large, "comp", "left_anti"), nodes.join(large, "comp", "left_semi").select(*nodes.columns)
    done = here.repartition("comp").sortWithinPartitions("comp").select("comp", "id", "par", "cyclic").mapInArrow(_traverse_sorted, SCHEMA)
    return done if there is None else done.unionByName(_doubled(there))


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_component: int = MAX_COMPONENT) -> DataFrame:
    """For each id: root, depth (0 at the root), path (ids from the root to the node), n_descendants, cycle_id, on_cycle.

    The paths together have as many entries as the depths add up to: of a chain of n nodes half of n squared."""
    nodes, _ = components(parent_links(df, id_col, parent_col))
    return _tree(nodes, max_component)


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant_id, distance): every node with each node below it; the inverse of the paths, so no group is ever gathered."""
    up = tree.where(F.col("path").isNotNull()).select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "id"))
    return up.where(F.col("id") != F.col("descendant_id")).select("id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
