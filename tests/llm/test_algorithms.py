import random

import numpy as np
import pytest

from quire.llm.quota_sample import sample_to_targets
from quire.llm.similar import close_pairs, neighbours
from quire.llm.split_tree import heading_level, pack, parse, split_oversized


def test_sample(spark):
    books = [(f"b{i:03}", c) for i, c in enumerate(["甲"] * 120 + [" 乙　"] * 60 + ["丙"] * 3 + [None] * 10 + [""] * 7 + ["其他"] * 50)] + [("b000", "甲"), (None, "甲")]
    df = spark.createDataFrame([(i, c, 0.5) for i, c in books], "id string, category string, pi double").repartition(7)
    goals = spark.createDataFrame([("甲", 6000, 1), ("乙", 3500, 1), ("丙", 500, 5), ("丁", 0, 2)], "category string, share_bp int, min_books int")
    sample, report = sample_to_targets(df, goals)
    got = {r["category"]: (r["available"], r["quota"], r["sampled"], r["residual"]) for r in report.collect()}
    assert got == {"甲": (120, 30, 30, 0), "乙": (60, 18, 18, 0), "丙": (3, 5, 3, -2), "丁": (0, 2, 0, -2)}
    ids = [r["id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 51
    assert sorted(ids) == sorted(r["id"] for r in sample_to_targets(df, goals)[0].collect())
    assert {r["sampled"] for r in sample_to_targets(df.limit(0), goals)[1].collect()} == {0}


def test_sample_is_the_same_in_any_layout(spark):
    rows = [(f"b{i:04}", "甲" if i % 3 else "乙") for i in range(2000)]
    goals = spark.createDataFrame([("甲", 6000, 1), ("乙", 4000, 1)], "category string, share_bp int, min_books int")
    drawn = set()
    for parts, shuffles in ((1, 1), (3, 8), (7, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        df = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "id string, category string").repartition(parts)
        sample, report = sample_to_targets(df, goals, per_bucket=60)
        drawn.add(frozenset(r["id"] for r in sample.collect()))
        assert {r["residual"] for r in report.collect()} == {0}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(drawn) == 1 and len(next(iter(drawn))) == 400


def vectors(n=1500, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n // 3, 64))
    return np.concatenate([x, x + 0.08 * g.normal(size=x.shape), g.normal(size=(n - 2 * len(x), 64))]).astype(np.float32)


def test_neighbours_against_brute_force(spark):
    x = vectors()
    ids = [f"v{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in zip(ids, x)], "id string, v array<float>, similarity double")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :10]
    got: dict = {}
    for r in neighbours(df, "id", "v").collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    recall = np.mean([len(got[ids[i]] & {ids[j] for j in top[i]}) / 10 for i in range(len(ids))])
    assert recall >= 0.9
    pairs = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in top[i] if s[i, j] >= 0.95}
    assert {tuple(r) for r in close_pairs(df, "id", "v").collect()} == pairs


def test_neighbours_without_clusters(spark):
    """Neighbours lie in far more than ten of the 25 cells; as many are visited as hold them."""
    x = np.random.default_rng(5).normal(size=(10_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:05}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    got: dict = {}
    for r in neighbours(df, "id", "v").collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = range(0, len(x), 20)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    top = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(got[f"v{i:05}"] & {f"v{j:05}" for j in t}) / 10 for i, t in zip(asked, top)]) >= 0.9


def test_neighbours_cases(spark):
    a, b = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    rows = [(f"c{i:02}", [2.0 * y for y in a] if i % 2 else a) for i in range(30)] + [("z", b), ("n", None), ("s", [1.0]), ("0", [0.0] * 64), ("x", [float("nan")] + a[1:]), ("y", [None] + a[1:]), ("c00", a), (None, a)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    near = {}
    for r in neighbours(df, "id", "v").collect():
        near.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert set(near) == {f"c{i:02}" for i in range(30)} | {"z"}
    assert [n for _, n in sorted(near["c05"])] == [f"c{i:02}" for i in range(11) if i != 5]
    assert len(near["z"]) == 10 and neighbours(df.limit(0), "id", "v").count() == 0


def test_neighbours_take_little_disk(spark, tmp_path, monkeypatch):
    """Stages and shuffles together stay below four times the table, of whose values there are few different ones."""
    from quire import session
    from quire.llm import similar

    monkeypatch.setattr(similar, "SAMPLE", 600)  # what is taken for fitting doesn't grow with the table
    monkeypatch.setattr(similar, "ASKED", 64)
    g = np.random.default_rng(2)
    x = np.round(g.normal(size=(6_000, 64)) * 40) / 256
    spark.createDataFrame([(f"{i:08x}-{g.integers(1 << 48):012x}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>").write.option("compression", "zstd").parquet(f"{tmp_path}/in")
    size = lambda at: sum(p.stat().st_size for p in __import__("pathlib").Path(at.removeprefix("file://")).rglob("*.parquet"))
    files = lambda: {f.getName(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())}
    stages, shuffled = list(session._STAGES), files()
    neighbours(spark.read.parquet(f"{tmp_path}/in"), "id", "v").write.parquet(f"{tmp_path}/out")
    taken = sum(size(at) for at in session._STAGES if at not in stages) + sum(n for f, n in files().items() if f not in shuffled)
    assert taken < 4 * size(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60_000


def test_neighbours_of_copies_and_of_ids_with_several_vectors(spark):
    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(300, 64)) * 40) / 256
    rows = [(f"v{i:03}", v.tolist()) for i, v in enumerate(x)] + [(f"w{i:03}", (x[i] * 2).tolist()) for i in range(5)] + [("v000", (x[0] * 3).tolist()), ("v009", max(x[9].tolist(), (-x[9]).tolist())), ("v010", g.normal(size=64).tolist()), ("t", (x[4] / 7).tolist())]
    best: dict = {}
    for i, v in rows:
        v = np.array(v, np.float32).tolist()
        best[i] = min(v, best.get(i, v))
    ids = sorted(best)
    u = np.array([best[i] for i in ids])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {i: [ids[j] for j in sorted(set(range(len(ids))) - {n}, key=lambda j, n=n: (-s[n, j], ids[j]))[:3]] for n, i in enumerate(ids)}
    got: dict = {}
    for r in neighbours(spark.createDataFrame(rows, "id string, v array<float>").repartition(3), "id", "v", 3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got["t"][:2] == ["v004", "w004"] and set(got) == set(want)
    assert np.mean([got[i] == want[i] for i in ids]) > 0.9


@pytest.mark.parametrize("seed", range(6))
def test_pack_keeps_every_character(seed):
    g = random.Random(seed)
    text = "".join(g.choice(["第一章 标题\n", "很长的句子，没有停。", "word ", "x" * g.randrange(1, 1500), "\n\n", "End. ", "- item\n", "  - inner\n", "```\ncode\n", "# A\n", "## B\n\n"]) for _ in range(60))
    cuts = [g.randrange(-5, len(text) + 5) for _ in range(8)]
    pieces = pack(text, cuts)
    assert "".join(text[a:b] for a, b, *_ in pieces) == text
    assert all(b - a + (128 if i else 0) <= 1024 for i, (a, b, *_) in enumerate(pieces))
    assert {a for a, _, k, _ in pieces if k == "chapter"} == {c for c in cuts if 0 < c < len(text)}


def test_tree_of_a_text():
    text = "intro\n# A\n\nfirst\nmore\n\n- one\n  - two\n  goes on\n- three\n## B\n```\n# no heading\n```\nend\n# C\nlast"
    root = parse(text, 0, len(text), set())

    def shape(n):
        return (n.kind, n.title, [shape(c) for c in n.children], text[n.start : n.end])

    def kinds(n):
        return [(c.kind, c.title, kinds(c)) for c in n.children]

    assert kinds(root) == [
        ("paragraph", "", []),
        ("heading", "A", [("paragraph", "", []), ("list", "", [("item", "", [("item", "", [])]), ("item", "", [])]), ("heading", "B", [("paragraph", "", []), ("paragraph", "", [])])]),
        ("heading", "C", [("paragraph", "", [])]),
    ]
    assert shape(root.children[1].children[1])[3] == "- one\n  - two\n  goes on\n- three\n"


def test_headings_stay_with_what_follows_and_stacks_grow():
    text = "# A\n" + "word " * 150 + "\n\n## B\n\n" + "word " * 300 + "\n# C\n- one\n- two\n" + "word " * 100
    pieces = pack(text, [])
    assert [(p[2], p[3]) for p in pieces] == [("start", ["A"]), ("heading", ["A", "B"]), ("word", ["A", "B"]), ("heading", ["C"])]
    assert all(not text[a:b].rstrip().endswith(("# A", "## B", "# C")) for a, b, *_ in pieces)
    levels = [heading_level(x) for x in ("第一部 甲", "第二章 乙", "第三节", "一、丙", "（一）丁", "1.2 x", "1.2.3 x", "### x", "word", "", "x" * 90)]
    assert levels == [1, 2, 3, 4, 5, 2, 3, 3, None, None, None]


def test_split(spark):
    text = ("句子很多。" * 60 + "\n") * 6
    rows = [("a", "B", text, 100, ["h"]), ("a", "B", text, 100, ["h"]), ("b", "B", "short", 1, None), ("c", None, text, None, None), ("d", "B", None, 1, None), ("e", "B", text, 5000, [])]
    chunks = spark.createDataFrame([(*r, 9) for r in rows], "chunk_id string, book_id string, content string, start_char long, heading_stack array<string>, piece int")
    chapters = spark.createDataFrame([("B", 100, 1), ("B", 700, 1), ("B", 700, 2), ("B", None, 1), ("B", 100 + len(text), 1), ("C", 800, 1)], "book_id string, start_char long, level int")
    out = split_oversized(chunks, chapters).collect()
    assert {r["chunk_id"] for r in out} == {"a", "c", "e"} and all(len(r["text"]) <= 1024 for r in out)
    assert {(r["chunk_id"], r["cut"]) for r in out if r["kind"] == "chapter"} == {("a", 600)}
    assert all(r["text"] == text[r["start"] : r["end"]] for r in out) and all(r["abs_start"] is None for r in out if r["chunk_id"] == "c")
    own = sorted((r["piece"], r["start"], r["end"], r["cut"]) for r in out if r["chunk_id"] == "a")
    assert all(x[2] == y[3] and y[1] == y[3] - 128 for x, y in zip(own, own[1:]))
    assert split_oversized(chunks.limit(0), chapters.limit(0)).count() == 0
