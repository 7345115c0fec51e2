"""The stored index, the library's tables, import, charset detection, contexts, models and commands."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.functions import models, text as T
from quire.operators import chunking, context, retrieval
from quire.operators.fulltext import FullTextIndex, hits
from quire.operators.library import SCHEMAS, Library
from quire.plans import importing, reports, writing
from quire.sources import charset, files

CHINESE = "深秋的早晨，老人推开木门，看见院子里落满了黄叶。他慢慢走到井边，打了一桶水，又回头望了望远处的山。"
TRADITIONAL = "深秋的早晨，老人推開木門，看見院子裡落滿了黃葉。他慢慢走到井邊，打了一桶水，又回頭望了望遠處的山。"


@pytest.mark.parametrize(
    ("text", "name", "want"),
    [(CHINESE, "gb18030", "gb18030"), (CHINESE, "gbk", "gb18030"), (TRADITIONAL, "big5", "big5"), (CHINESE, "utf-8", "utf-8"), (CHINESE, "utf-8-sig", "utf-8"), (CHINESE, "utf-16", "utf-16"), ("plain", "ascii", "utf-8"), ("これはテストの文章です。雨が降っています。", "shift_jis", "shift_jis"), ("Les élèves étaient déjà là, près du café.", "cp1252", "cp1252"), ("", "utf-8", "utf-8")],
)
def test_charset(text, name, want):
    assert files.decode_bytes(text.encode(name)) == (want, text)
    assert charset.detect(text.encode(name)).startswith(want)


def test_wrong_bytes_are_shown():
    name, text = files.decode_bytes(CHINESE.encode("gb18030")[:-1])
    assert name == "gb18030" and text.startswith(CHINESE[:-1]) and text.endswith("�")


@pytest.fixture
def index(spark, tmp_path):
    rows = [("a", "The iron key lay on the table"), ("b", "iron-key and lamp"), ("c", "key iron lamp lamp"), ("d", ""), ("e", None), ("f", "深度学习与神经网络")]
    return FullTextIndex(spark, f"file://{tmp_path}/ix", buckets=4).insert(spark.createDataFrame(rows, "chunk_id string, content string"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_index_search(spark, index):
    assert ids(index.search("iron key")) == ["a", "b", "c"]
    assert ids(index.search("iron-key")) == ["a", "b"]
    assert ids(index.search('"lamp')) == ["b", "c"] and ids(index.search("")) == [] and ids(index.search("absent")) == []
    assert ids(index.search("深度学习与神经网络")) == ["f"] and ids(index.search("学习")) == []
    assert [r["id"] for r in index.search("lamp").collect()] == ["c", "b"]
    only = spark.createDataFrame([("c",)], "id string")
    assert ids(index.search("iron", where=only)) == ["c"]
    many = spark.createDataFrame([(1, "lamp"), (2, "iron key"), (3, "nothing")], "query_id int, query string")
    got = index.search_many(many, 2)
    assert sorted((r["query_id"], r["rank"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    one = {r["id"]: r["score"] for r in index.search("lamp").collect()}
    assert {r["id"]: r["score"] for r in got.where("query_id = 1").collect()} == pytest.approx(one)


def test_index_insert_delete_compact(spark, index):
    index.insert(spark.createDataFrame([("g", "a lamp")], "chunk_id string, content string"))
    assert ids(index.search("lamp")) == ["b", "c", "g"]
    index.delete(spark.createDataFrame([("c",), ("zz",)], "id string"))
    assert ids(index.search("lamp")) == ["b", "g"]
    before = {r["id"]: r["score"] for r in index.search("lamp").collect()}
    index.compact()
    assert {r["id"]: r["score"] for r in index.search("lamp").collect()} == pytest.approx(before)
    assert index.lengths().count() == 5
    empty = FullTextIndex(spark, index.path + "-none")
    assert empty.search("lamp").count() == 0


BOOK = "第一部 河边\n第一章 早晨\n" + "老人在河边走路。" * 30 + "\n第二章 夜里\n" + "灯灭了，没有人说话。" * 200


def sources(spark, tmp_path, name="books"):
    root = tmp_path / name
    for folder, file, raw in (("历史", "河.txt", BOOK.encode("gb18030")), ("历史", "copy.txt", BOOK.encode("gb18030")), ("文学", "灯.txt", "A lamp and an iron key.\nNobody came.".encode()), ("文学", "short.txt", b"x"), ("文学", "scan.doc", b"no text")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / file).write_bytes(raw)
    return str(root)


def test_import_search_delete(spark, tmp_path):
    root = sources(spark, tmp_path)
    library = Library(spark, f"file://{tmp_path}/library", index_buckets=4)
    found = files.read_files(spark, root)
    counts = {r["status"]: r["n"] for r in importing.import_files(library, found).collect()}
    assert counts == {"imported": 2, "too short": 1}
    assert {r["status"]: r["n"] for r in importing.import_files(library, found).collect()} == {"skipped": 2, "too short": 1}
    books = {r["title"]: r for r in library.books().collect()}
    assert set(books) <= {"河", "copy", "灯"} and len(books) == 2
    river = next(b for b in books.values() if b["title"] != "灯")
    assert river["category"] == "历史" and river["language"] == "中文" and river["total_chunks"] == library.of_book("chunks", river["id"]).count() > 2
    chunks = library.of_book("chunks", river["id"]).collect()
    assert [c["start_char"] for c in chunks] == sorted(c["start_char"] for c in chunks)
    assert all(c["heading_stack"][0] == "第一部 河边" for c in chunks) and all(c["end_char"] - c["start_char"] == len(c["content"]) for c in chunks)
    chapters = {r["title"]: r for r in library.table("chapters").collect()}
    assert chapters["第一章 早晨"]["parent_id"] == chapters["第一部 河边"]["id"] and chapters["第一部 河边"]["parent_id"] is None
    lamp = hits(library.index.search("iron lamp"), library.table("chunks"), library.table("books")).collect()
    assert [h["metadata"]["book_title"] for h in lamp] == ["灯"]
    assert library.reindex_vectors(models.embedding(F.col("content"))) == library.table("chunks").count()
    assert library.reindex_vectors(models.embedding(F.col("content"))) == 0
    text, titles = cli.searched(library, "iron lamp")
    assert text.startswith("## 素材 [1]\n") and "灯" in titles
    library.add_tags(library.table("chunks").select("chunk_id", F.lit("旧").alias("tag")))
    library.add_tags(library.table("chunks").select("chunk_id", F.lit("旧").alias("tag")))
    assert library.table("chunk_tags").count() == library.by_tag("旧").count() == library.table("chunks").count()
    library.delete_books(spark.createDataFrame([(river["id"],)], "id string"))
    assert [library.table(t).count() for t in SCHEMAS] == [1, 0, 1, 1, 1]
    assert ids(library.index.search("灯灭了")) == [] and library.get("books", "id", river["id"]).count() == 0
    again = importing.import_files(library, found, skip_existing=False, reindex=True)
    assert {r["status"]: r["n"] for r in again.collect()} == {"imported": 2, "too short": 1}
    assert library.table("books").count() == 2 and library.index.search("iron").count() == 1


def test_older_files_get_new_columns(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/l")
    spark.createDataFrame([("b", "t")], "id string, title string").write.parquet(f"{tmp_path}/l/books/v0")
    library._switch("books", "v0")
    assert "language" in library.missing_columns("books")
    assert library.table("books").select("language", "total_chars").first() == ("中文", 0)
    assert library.table("chunks").count() == 0 and library.missing_columns("chunks") == []


def test_folders(spark, tmp_path):
    root = sources(spark, tmp_path)
    rows = files.library_files(spark, root).collect()
    assert {r["category"] for r in rows} == {"历史", "文学"} and sum(r["supported"] for r in rows) == 4
    assert files.library_files(spark, root, "历史").count() == 2
    assert files.library_files(spark, root + "/历史").select("category").distinct().collect()[0][0] == "历史"
    assert {r["category"]: r["n_files"] for r in files.folder_summary(spark, root).collect()} == {"历史": 2, "文学": 3}
    heads = files.heads(spark, root, n=1).collect()
    assert len(heads) == 2 and any("第一章" in r["markers"] for r in heads)
    with pytest.raises(RuntimeError):
        files.read_pdf_blocks(spark, root)


def test_context(spark):
    meta = "metadata struct<book_id:string,book_title:string,heading:string,start_char:long>"
    rows = [("1", 0.5, "甲" * 40, ("b", "Z", "h", 5)), ("2", 0.9, "乙", ("a", None, "", 9)), ("3", 0.7, None, ("b", "Z", None, 1))]
    found = spark.createDataFrame(rows, f"id string, score double, content string, {meta}")
    blocks = context.context_blocks(found, 10_000).orderBy("number").collect()
    assert [r["id"] for r in blocks] == ["2", "3", "1"] and blocks[0]["block"] == "## 素材 [1]\n**来源**：《未知书籍》\n**相关性**：0.90\n**内容**：乙\n"
    assert context.context_blocks(found, blocks[1]["spent"]).count() == 2 and context.context_blocks(found, 1).count() == 0
    assert context.assembled(context.context_blocks(found)).first()[0].count("## 素材") == 3
    order = lambda rank: [r["id"] for r in context.reranked(found, "q", rank).orderBy("place").collect()]
    assert order(None) == ["2", "3", "1"] and order(lambda q, p: "[2, 0, 2, 9, -1]") == ["1", "2", "3"]
    assert order(lambda q, p: "none") == ["2", "3", "1"] and order(lambda q, p: 1 / 0) == ["2", "3", "1"]


@pytest.mark.parametrize(("reply", "want"), [("[1, 2]", [1, 2]), ("order: [3,1 , 2] ok", [3, 1, 2]), ("none", []), ("", []), ("[ ]", [])])
def test_indices(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "r string").select(context.parsed_indices(F.col("r"))).first()[0] == want


def test_objects(spark):
    replies = ['say ```json\n{"a": 1}\n``` done', 'x {"a": 2} y', "no", "{broken", None, "} {"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", context.parsed_object(F.col("r"), "a int").alias("o"))
    assert [r["o"]["a"] if r["o"] else None for r in rows.orderBy("i").collect()] == [1, 2, None, None, None, None]


def test_topics(spark):
    topics = spark.createDataFrame([("a",), ("b",), ("a",)], "topic string")
    planned = spark.createDataFrame([(1, "a", ["later"]), (0, "a", ["first", "second"]), (2, "c", ["other"])], "plan_no int, topic string, queries array<string>")
    got = sorted((r["topic"], r["query_no"], r["query"]) for r in context.topic_queries(topics, planned).collect())
    assert got == [("a", 0, "first"), ("a", 1, "second"), ("b", 0, "b"), ("b", 1, "b 定义 概念"), ("b", 2, "b 案例 例子")]
    found = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 1, "x"), ("b", 0, 1, "x"), ("a", 1, 2, "y")], "topic string, query_no int, rank int, id string")
    assert context.topic_hits(found).count() == 3 and context.topic_hits(found, True).count() == 2
    plan = {r["topic"]: (r["hits"], r["first_ids"], r["coverage"]) for r in context.topic_coverage(context.topic_hits(found), topics, 2).collect()}
    assert plan == {"a": (2, ["x", "y"], "adequate"), "b": (1, ["x"], "insufficient")}


def test_chunk_variants(spark):
    df = spark.createDataFrame([(1, "# A\none two\n\nx\n# B\nthree"), (2, "plain text"), (3, None), (4, "")], "id int, t string")
    got = sorted((r["id"], r["piece"], r["title"], r["content"]) for r in chunking.sections_by_line(df, "id", "t", "#").collect())
    assert got == [(1, 0, "# A", "# A\none two\n\nx"), (1, 1, "# B", "# B\nthree"), (2, 0, "", "plain text")]
    guided = sorted((r["id"], r["piece"], r["start_line"], r["content"]) for r in chunking.guided_chunks(df, "id", "t", F.array(F.lit("# B"))).collect())
    assert guided[:2] == [(1, 0, 0, "# A\none two\n\nx"), (1, 1, 4, "# B\nthree")] and "".join(g[3] for g in guided[2:]) == "plain text"
    para = spark.createDataFrame([(1, "red fox runs\n\nred fox runs fast\n\nstock market fell\n \n")], "id int, t string")
    rows = chunking.semantic_chunks(para, "id", "t", models.embedding).orderBy("piece").collect()
    assert [r["n_paragraphs"] for r in rows] == [2, 1]
    fixed = chunking.fixed_chunks(df, "id", "t", 4, 1)
    full = chunking.with_stack(fixed, spark.createDataFrame([(1, ["H"])], "id int, heading_stack array<string>")).collect()
    assert all(r["end_char"] - r["start"] == r["token_count"] == len(r["content"]) for r in full) and {tuple(r["heading_stack"] or ()) for r in full if r["id"] == 1} == {("H",)}


def test_vectors_in_batches(spark):
    import random

    g = random.Random(2)
    rows = [(i, [g.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(200, None), (201, [1.0]), (None, [0.0] * 6), (202, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = retrieval.vector_search_batch(df, "id", "v", F.col("id") % 20 == 0, 6, 3)
    for q in (0, 40):
        want = [r["id"] for r in retrieval.vector_search(df.where(f"id <> {q} AND size(v) = 6"), "id", "v", rows[q][1], 3).collect()]
        assert [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want
    assert retrieval.vector_search_batch(df.limit(0), "id", "v", F.col("id") == 0, 6).count() == 0


def test_writing(spark, tmp_path):
    class Echo:
        def complete(self, prompt, max_tokens=4096, temperature=0.7):
            if "fail" in prompt:
                raise RuntimeError
            return "## 一\n## 二" if "提纲，各节" in prompt else "text"

    themes = spark.createDataFrame([("茶", "轻松", 900)], "theme string, style string, words int")
    row = writing.analysed(themes).first()
    assert row["is_default"] and row["analysis"]["sub_themes"] == ["茶"] and row["analysis"]["estimated_sections"] == 3
    reply = F.lit('{"core_theme": "茶史", "sub_themes": ["产地", "贸易"], "estimated_sections": 5}')
    row = writing.analysed(themes, reply).first()
    assert not row["is_default"] and row["analysis"]["core_theme"] == "茶史" and row["analysis"]["target_word_count"] == 900
    made = writing.generate(writing.Request("茶"), "## 素材 [1]\nA\n## 素材 [2]\nB")
    assert len(made.sections) == 3 and "A" in made.text and made.words == len(made.text.replace(" ", "").replace("\n", ""))
    assert writing.generate(writing.Request("茶"), "m", Echo()).sections == ["## 一\n\ntext", "## 二\n\ntext"]
    at = reports.markdown_report(spark, f"file://{tmp_path}/out", "茶 与/水", made.text, made.outline, ["书"], datetime.date(2024, 1, 2))
    assert at.endswith("2024-01-02-茶_与_水.md") and "- 书" in open(at[7:]).read()
    at = reports.json_report(spark, f"file://{tmp_path}/r.json", kinds=spark.createDataFrame([("txt", 2)], "kind string, n int"), extra={"n": 1})
    assert json.load(open(at[7:])) == {"kinds": [{"kind": "txt", "n": 2}], "extra": {"n": 1}}
    said = spark.createDataFrame([("a",), ("fail",), (None,)], "p string").select(models.completion(F.col("p"), Echo())).collect()
    assert [r[0] for r in said] == ["text", None, None]
    with pytest.raises(RuntimeError):
        models.Command(["/no/such/program", "{prompt}"]).complete("x")


def test_small_functions(spark):
    row = spark.createDataFrame([(900, 2048, 3 << 20, ["a", "b"], [], "一。二！三？")], "a int, b int, c int, s array<string>, e array<string>, t string")
    got = row.select(T.file_size(F.col("a")), T.file_size(F.col("b")), T.file_size(F.col("c")), T.heading(F.col("s")), T.heading(F.col("e")), T.short_summary(F.col("t"))).first()
    assert tuple(got) == ("900B", "2.0KB", "3.0MB", "b", "", "一二")
    assert models.HashedWords().embed(["", "a b"]).shape == (2, 64) and models.HashedWords(longest=512).longest == 512


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    root, lib = sources(spark, tmp_path), f"file://{tmp_path}/lib"
    cli.main(["--library", lib, "import", root, "--dry-run"])
    cli.main(["--library", lib, "import", root])
    cli.main(["--library", lib, "import", "--list"])
    cli.main(["--library", lib, "index"])
    cli.main(["--library", lib, "generate", "iron lamp", "--step", "material"])
    cli.main(["--library", lib, "generate", "iron lamp", "--show-sources", "--output", f"file://{tmp_path}/out"])
    cli.main(["--library", lib, "analyse", root, "--output", f"file://{tmp_path}/a.json"])
    assert "## 素材 [1]" in capsys.readouterr().out and len(list((tmp_path / "out").glob("*.md"))) == 1
    assert len(json.load(open(tmp_path / "a.json"))["folders"]) == 2
