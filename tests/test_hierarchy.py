import random

import pytest

from quire.operators.hierarchy import cycles, descendants, hierarchy


def by_hand(rows):
    """Walks up from every node."""
    par = {}
    for i, p in rows:
        if i is not None:
            real = [x for x in (par.get(i), p) if x]
            par[i] = min(real) if real else None
    out = {}
    for n in par:
        path, at = [n], par[n]
        while at in par and at not in path:
            path.append(at)
            at = par[at]
        if at in par:
            ring = path[path.index(at) :]
            out[n] = (None, None, min(ring), n in ring)
        else:
            out[n] = (path[-1], path[::-1], None, False)
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in rows], "id string, parent_id string, path string, depth int")
    got = {r["id"]: (r["root"], r["path"], r["cycle_id"], r["on_cycle"]) for r in hierarchy(df, **kw).collect()}
    want = by_hand(rows)
    assert got == want
    lost = {r["id"]: (r["cycle_id"], r["on_cycle"]) for r in cycles(df, **kw).collect()}
    assert lost == {i: (c, on) for i, (_, _, c, on) in want.items() if c is not None}


@pytest.mark.parametrize("most", [200_000, 3])
def test_random_links(spark, most):
    g = random.Random(4)
    rows = [(f"n{i:03}", g.choice([None, "", "gone", *[f"n{g.randrange(120):03}" for _ in range(9)]])) for i in range(120)]
    check(spark, rows + rows[:20], max_component=most)


def test_cases(spark):
    check(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "d"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "y"), (None, "a"), ("b", "a")])


@pytest.mark.parametrize("most", [200_000, 10])
def test_deep_chain_with_a_tail_into_a_ring(spark, most):
    chain = [("k000", None)] + [(f"k{i:03}", f"k{i - 1:03}") for i in range(1, 70)]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("a0", "r3")] + [(f"a{i}", f"a{i - 1}") for i in range(1, 30)]
    check(spark, chain + ring, max_component=most)


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent_id string")
    tree = hierarchy(df)
    assert {(r[0], r[1], r[2]) for r in descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}
    assert {r["id"]: r["n_descendants"] for r in tree.collect()} == {"a": 3, "b": 1, "c": 0, "d": 0}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_very_long_chains(spark):
    """A chain of 200,000 nodes and a tail of 100,000 on a ring: only the lost ones come out, and no path is made."""
    n, tail = 200_000, 100_000
    chain = spark.range(n).selectExpr("format_string('k%06d', id) AS id", "IF(id = 0, NULL, format_string('k%06d', id - 1)) AS parent_id")
    ring = spark.range(tail).selectExpr("format_string('r%06d', id) AS id", "IF(id = 0, 'r000006', format_string('r%06d', id - 1)) AS parent_id")
    got = cycles(chain.unionByName(ring)).groupBy("cycle_id", "on_cycle").count().collect()
    assert {tuple(r) for r in got} == {("r000000", True, 7), ("r000000", False, tail - 7)}
