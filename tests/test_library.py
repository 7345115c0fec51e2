import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, retrieval, store, structure
from quire.sources.files import decode_bytes, list_files, read_files, read_pdf


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("你好世界", 6), ("Hello 你好 World 世界", 9), ("Hello World" * 100, 275), ("", 0)])
def test_token_estimate(spark, text, n):
    assert one(spark, text, T.token_estimate) == n


@pytest.mark.parametrize("text,label", [("今天天气很好", "中文"), ("今天 is good", "英文"), ("你好你好 hello", "中英混合"), ("hello there", "英文"), ("123", "其他"), ("", "未知"), (None, "未知")])
def test_language(spark, text, label):
    assert one(spark, text, T.language_label) == label


@pytest.mark.parametrize("path,category", [("/data/历史军事/test.txt", "历史军事"), ("/data/test.txt", "未分类"), ("/a/books/raw_books/t.txt", "未分类"), ("/诗/data/t.txt", "诗")])
def test_category(spark, path, category):
    assert one(spark, path, T.category_of_path) == category


def test_strip_and_title(spark):
    assert one(spark, "　\t a b  ", T.strip) == "a b"
    assert one(spark, "\n# 书名 \n第一章", T.title) == "书名"
    assert one(spark, "", T.title) == "未命名书籍"


@pytest.mark.parametrize("text,target,overlap,n", [("测试文本 " * 200, 50, 10, 13), ("简短文本", 100, 20, 1), ("A" * 100, 10, 5, 10), ("A" * 50, 10, 3, 4), ("Hello World! " * 30, 20, 5, 13), ("x" * 1024, 512, 128, 2), ("", 512, 128, 0)])
def test_fixed(spark, text, target, overlap, n):
    rows = chunking.fixed_chunks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", target, overlap).orderBy("start").collect()
    assert len(rows) == n
    step = 2 * (target - overlap)
    assert "".join(r["content"][:step] for r in rows[:-1]) + (rows[-1]["content"] if rows else "") == text


def test_fixed_refuses_overlap(spark):
    with pytest.raises(ValueError):
        chunking.fixed_chunks(spark.createDataFrame([(1, "a")], "id int, t string"), "id", "t", 10, 10)


@pytest.mark.parametrize("n,target,overlap,want", [(100, 500, 128, 1), (500, 50, 10, 7), (1000, 10, 2, 63)])
def test_recursive(spark, n, target, overlap, want):
    assert chunking.recursive_chunks(spark.createDataFrame([(1, "A" * n)], "id int, t string"), "id", "t", target, overlap).count() == want


def test_pack(spark):
    rows = chunking.packed_paragraphs(spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\n" + "d" * 30)], "id int, t string"), "id", "t", 10).collect()
    assert [r["content"] for r in rows] == ["aaaa\nbbbb", "cccc", "d" * 30]


HEADS = [
    ("第一章 引言\n这是引言内容\n第二章 方法\n这是方法内容", [(1, "第一章 引言", 0, 2), (1, "第二章 方法", 2, 4)]),
    ("1.1 背景\n背景内容\n1.2 目的\n目的内容", [(2, "1.1 背景", 0, 2), (2, "1.2 目的", 2, 4)]),
    ("一、引言\n这是引言", [(2, "一、引言", 0, 2)]),
    ("Chapter 1 Introduction\nSome content", [(2, "Chapter 1 Introduction", 0, 2)]),
    ("（一）准备工作\n准备内容", [(3, "（一）准备工作", 0, 2)]),
    ("前言", []),
    ("参考文献", [(0, "参考文献", 0, 1)]),
    ("这是一段简单的文本。", []),
]


@pytest.mark.parametrize("text,want", HEADS)
def test_headings(spark, text, want):
    rows = structure.headings(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("start_line").collect()
    assert [tuple(r)[1:5] for r in rows] == want
    assert all(text[r["start_char"] :].startswith(r["title"][:2]) for r in rows)


def test_merge_and_tree_against_loops(spark):
    import random

    g = random.Random(1)
    levels = [g.randrange(4) for _ in range(40)]
    starts = sorted(g.sample(range(200), 40))
    rows = [(1, lv, f"t{i}", s, e) for i, (lv, s, e) in enumerate(zip(levels, starts, [*starts[1:], 200]))]
    df = spark.createDataFrame(rows, "id int, level int, title string, start_line int, end_line int")
    form = {0: "第{}部 x", 1: "第{}章 x", 2: "第{}节 x", 3: "{}.1. x"}
    text = ["filler"] * 200
    for i, (lv, s) in enumerate(zip(levels, starts)):
        text[s] = form[lv].format(i)
    stack, parents = [], {}
    for _, lv, _, s, _ in rows:
        while stack and stack[-1][0] >= lv:
            stack.pop()
        parents[s] = stack[-1][1] if stack else None
        stack.append((lv, s))
    tree = structure.heading_tree(spark.createDataFrame([(1, "\n".join(text)), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert {r["start_line"]: r["parent_line"] for r in tree} == parents
    assert {r["start_line"] for r in tree if r["leaf"]} == set(starts) - set(parents.values())
    kept = []
    for r in rows:
        if kept and r[4] - r[3] < 3:
            kept[-1][1] = r[4]
        else:
            kept.append([r[3], r[4]])
    assert [[r["start_line"], r["end_line"]] for r in structure.merged(df).orderBy("start_line").collect()] == kept


def test_chapter_chunks_offsets(spark):
    text = "preface\n\n第一部 甲\n第一章 乙\n 文。 \n第二章 丙\n字" + "。" * 1100 + "\n第一章 乙\n尾"
    df = spark.createDataFrame([(1, text), (2, "no heading "), (3, "  \n"), (4, None)], "id int, t string")
    rows = structure.chapter_chunks(df, "id", "t").orderBy("id", "start_char").collect()
    assert [(r["id"], r["heading_stack"], r["struct_path"]) for r in rows] == [(1, ["第一部 甲"], "1/第一部 甲"), (1, ["第一部 甲", "第一章 乙"], "1/第一章 乙"), (1, ["第一部 甲", "第二章 丙"], ""), (2, [], "")]
    for r in rows[:3]:
        assert text[r["start_char"] : r["end_char"]].strip() == r["content"] and r["token_count"] == len(r["content"])
    kept = structure.chapter_chunks(df, "id", "t", keep_preamble=True).where("id = 1").orderBy("start_char").collect()
    assert len(kept) == 4 and kept[0]["content"] == "preface" and kept[0]["end_char"] + 1 == kept[1]["start_char"]


def test_short_headings_are_an_option(spark):
    df = spark.createDataFrame([(1, "前言\n字\n跋\n字")], "id int, t string")
    assert structure.headings(df, "id", "t").count() == 0 and structure.headings(df, "id", "t", min_heading_len=1).count() == 2


def test_bm25(spark):
    rows = [("a1", "red fox jumps"), ("a2", "red red dog"), ("a3", "blue cat sat on the mat"), ("a4", "green"), ("a5", "fox")]
    df = spark.createDataFrame([(i, f"{i} {t}") for i, t in rows], "id string, t string")
    got = [(r["id"], r["score"]) for r in retrieval.full_text(df, "id", "t", "red").collect()]
    assert got == [("a2", pytest.approx(0.45590079386601945)), ("a1", pytest.approx(0.32938031594301403))]
    assert retrieval.full_text(df, "id", "t", "").count() == 0
    assert retrieval.full_text(df, "id", "t", 'red-"dog"').count() == 1


def test_analysers(spark):
    df = spark.createDataFrame([("c1", "Python机器学习入门"), ("c2", "深度学习与神经网络"), ("c3", "机器学习 是 Python 的 应用"), ("c4", "python, PYTHON! x-y café")], "id string, t string")
    ids = lambda q, **k: {r["id"] for r in retrieval.full_text(df, "id", "t", q, **k).collect()}
    assert ids("Python") == {"c3", "c4"} and ids("机器学习") == {"c3"} and ids("x-y") == {"c4"}
    assert ids("Python", analyser=T.bigram_tokens) >= {"c3", "c4"} and ids("机器", analyser=T.bigram_tokens) == {"c1", "c3"}


def test_rrf(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "id string, score double")
    f = spark.createDataFrame([("b", 0.7), ("c", 0.6)], "id string, score double")
    rows = retrieval.fuse([v, f]).collect()
    assert [(r["id"], round(r["rrf"], 10), r["source"]) for r in rows] == [("b", 0.0325224749, "hybrid"), ("a", 0.0163934426, "vector"), ("c", 0.0161290323, "fts")]


def test_reorder_and_budget(spark):
    df = spark.createDataFrame([(i, "字" * 10) for i in range(5)], "p int, t string")
    assert [r["p"] for r in retrieval.reordered(df, "p", [3, 0, 3, 9, -1]).orderBy("place").collect()] == [3, 0, 1, 2, 4]
    assert retrieval.within_budget(df, "t", ["p"], 44).count() == 2


def test_store(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, h string")
    assert {r["id"] for r in store.first_of(df, "h", F.col("id")).collect()} == {1, 3, 4}
    assert {r["id"] for r in store.without(df, "id", df.where("id = 2").select("id")).collect()} == {1, 3, 4}
    assert store.upserted(df, df).count() == 4


def test_decode():
    assert decode_bytes("第一行内容\n".encode())[0] == "utf-8"
    assert decode_bytes("中文GBK测试内容".encode("gbk")) == ("gb18030", "中文GBK测试内容")
    assert decode_bytes(b"") == ("utf-8", "") and decode_bytes(None) == ("utf-8", "")
    assert decode_bytes("﻿ab".encode()) == ("utf-8", "ab") and decode_bytes("ab中".encode("utf-16")) == ("utf-16", "ab中")
    decode_bytes(bytes([0, 1, 2, 3, 255, 254, 253, 252]))


def test_files_and_stream(spark, tmp_path):
    from quire.streaming.incremental import import_stream

    d = tmp_path / "诗" / "in"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes("甲乙".encode("gbk"))
    (d / "b.txt").write_bytes("甲乙".encode("gbk"))
    (d / "c.TXT").write_text("abc")
    assert {(r["encoding"], r["text"]) for r in read_files(spark, str(d)).collect()} == {("gb18030", "甲乙"), ("utf-8", "abc")}
    assert list_files(spark, str(d)).count() == 3
    with pytest.raises(RuntimeError):
        read_pdf(spark, str(d))
    books, mark = str(tmp_path / "books"), str(tmp_path / "mark")
    for _ in range(2):
        import_stream(spark, str(d), books, mark).awaitTermination()
    assert spark.read.parquet(books).count() == 1
    (d / "e.txt").write_text("new")
    import_stream(spark, str(d), books, mark).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(books).collect()) == ["new", "甲乙"]


def test_catalogue():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
