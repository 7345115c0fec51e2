"""The commands: import files, index vectors, search for material and write, analyse a folder.

python -m quire.cli COMMAND --library PATH ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from quire.functions.models import embedding
from quire.operators import context, retrieval
from quire.operators.fulltext import hits
from quire.operators.library import Library
from quire.plans import importing, reports, writing
from quire.session import build_session
from quire.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--library", required=True, help="folder of the library's tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("import", help="import text files")
    c.add_argument("paths", nargs="*")
    c.add_argument("--category")
    c.add_argument("--list", action="store_true", help="show the books by category")
    c.add_argument("--reindex", action="store_true")
    c.add_argument("--skip-existing", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("index", help="compute missing vectors")
    c.add_argument("--book-id")
    c.add_argument("--all", action="store_true", help="vectors that are there too")
    c.add_argument("--batch-size", type=int, default=256)
    c = sub.add_parser("generate", help="search for material on a theme and write")
    c.add_argument("theme")
    c.add_argument("--style", default="通俗易懂")
    c.add_argument("--words", type=int, default=3000)
    c.add_argument("--audience", default="大众")
    c.add_argument("--step", choices=("all", "material"), default="all")
    c.add_argument("--show-sources", action="store_true")
    c.add_argument("--output", default="output")
    c = sub.add_parser("analyse", help="figures of a folder of files, as JSON")
    c.add_argument("path")
    c.add_argument("--output", required=True)
    c = sub.add_parser("delete", help="remove books")
    c.add_argument("ids", nargs="+")
    return p


def searched(library: Library, theme: str, budget: int = 4096) -> tuple[str, list[str]]:
    """(context, titles of the sources) for a theme: both legs, fused, as blocks within the budget."""
    vectors = library.table("chunk_vectors").where(F.col("embedding").isNotNull())
    asked = [float(x) for x in library.spark.createDataFrame([(theme,)], "t string").select(embedding(F.col("t"))).first()[0]]
    fused = retrieval.fuse([retrieval.vector_search(vectors, "chunk_id", "embedding", asked), library.index.search(theme)])
    found = hits(fused.select("id", F.col("rrf").alias("score")), library.table("chunks"), library.table("books"))
    blocks = context.context_blocks(context.reranked(found, theme), budget).cache()
    text = context.assembled(blocks).first()[0] or ""
    titles = [r[0] for r in found.join(blocks.select("id"), "id").select("metadata.book_title").distinct().orderBy("book_title").collect()]
    return text, titles


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session("quire")
    library = Library(spark, a.library)
    if a.command == "import":
        if a.list:
            library.table("books").groupBy("category").count().orderBy(F.desc("count"), "category").show(1000, False)
        elif a.dry_run:
            files.list_files(spark, a.paths).groupBy("category").count().orderBy(F.desc("count"), "category").show(1000, False)
        else:
            found = files.read_files(spark, a.paths)
            found = found if a.category is None else found.withColumn("category", F.lit(a.category))
            importing.import_files(library, found, None, a.skip_existing or not a.reindex, a.reindex).show(100, False)
    elif a.command == "index":
        print(library.reindex_vectors(embedding(F.col("content"), batch=a.batch_size), a.book_id, not a.all), "vectors")
    elif a.command == "generate":
        text, titles = searched(library, a.theme)
        if a.step == "material":
            print(text)
        else:
            made = writing.generate(writing.Request(a.theme, a.style, a.words, a.audience), text)
            print(reports.markdown_report(spark, a.output, a.theme, made.text, made.outline, titles if a.show_sources else []))
    elif a.command == "analyse":
        from quire.operators.store import counted

        listed = files.list_files(spark, a.path)
        texts = files.read_files(spark, a.path)
        print(reports.json_report(spark, a.output, folders=files.folder_summary(spark, a.path), kinds=counted(listed, "file_type"), encodings=counted(texts, "encoding")))
    else:
        library.delete_books(spark.createDataFrame([(i,) for i in a.ids], "id string"))


if __name__ == "__main__":
    main()
