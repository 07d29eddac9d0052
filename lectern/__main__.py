"""Command line.

``inspect PATH`` reports on EPUB files; ``convert PATH OUT`` makes audio of them with a given voice; ``edit PATH OUT``
has an editor read Russian books through; ``query NAME SF_DIR`` runs a query. Models are named ``module:factory``.
Exit codes: 0 done, 1 something is missing from what was made, 2 wrong use or no book.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import narration
from lectern.operators import contracts, pipeline, structure
from lectern.session import local_session
from lectern.sources import epub, files


def factory(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as error:
        raise argparse.ArgumentTypeError(f"no factory {name}: {error}") from error


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lectern")
    commands = out.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("path")
    shared.add_argument("--max-chars", type=int, default=narration.MAX_CHARS)
    shared.add_argument("--latin", choices=narration.LATIN_MODES, default="route")
    shared.add_argument("--lang")
    shared.add_argument("--chapters", help="like 1,3,7-9")
    commands.add_parser("inspect", parents=[shared], help="chapters, characters, hours and chunks of EPUB files")
    convert = commands.add_parser("convert", parents=[shared], help="audio of EPUB files")
    convert.add_argument("out")
    convert.add_argument("--voice", type=factory, required=True)
    convert.add_argument("--ears", type=factory, help="without it only the signal is checked")
    convert.add_argument("--limit", type=int)
    convert.add_argument("--retries", type=int, default=2)
    convert.add_argument("--seed", type=int, default=0)
    convert.add_argument("--sample-rate", type=int, default=24_000)
    edit = commands.add_parser("edit", parents=[shared], help="edits of Russian EPUB files")
    edit.add_argument("out")
    edit.add_argument("--editor", type=factory, required=True)
    query = commands.add_parser("query", help="a query over the tables of a folder")
    query.add_argument("name")
    query.add_argument("sf_dir")
    query.add_argument("--rows", type=int, default=20)
    return out


def print_rows(df: DataFrame) -> int:
    """Prints all rows, one partition at a time, and returns how many there were."""
    print("\t".join(df.columns))
    count = 0
    for count, row in enumerate(df.toLocalIterator(), 1):
        print("\t".join("" if v is None else str(v) for v in row))
    return count


def inspected(books: DataFrame, options: pipeline.Options) -> DataFrame:
    chunks = pipeline.chunked_books(books, options).groupBy("book_id").agg(F.count(F.lit(1)).alias("chunks"))
    chars = F.aggregate("paragraphs", F.lit(0), lambda s, p: s + F.length(p))
    found = epub.chapters(books).groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum(chars).alias("chars"), F.round(F.sum(chars) / structure.CHARS_PER_HOUR, 2).alias("hours"))
    return found.join(chunks, "book_id", "left").orderBy("book_id")


def edited(books: DataFrame, options: pipeline.Options, editor: Callable, out: str) -> DataFrame:
    """Writes the edits of all chapters and a cache of each, and returns the outcomes by how often they came."""
    spark = books.sparkSession
    chunks = pipeline.chunked_books(books, options).withColumn("chapter", F.to_json(F.struct("book_id", "chapter_index")))
    contracts.edit(chunks, "chapter", "chunk_index", editor).write.mode("overwrite").parquet(f"{out}/edits")
    judged = structure.judge_edits(chunks, spark.read.parquet(f"{out}/edits").filter("not failed"), ["chapter", "chunk_index"])
    own = structure.edit_cache(judged, chunks.withColumn("i", F.col("chunk_index")), "chapter", "chunk_index", ["chapter", "chunk_index"], "editor")
    files.write_json(own, f"{out}/cache")
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def main(arguments: list[str] | None = None) -> int:
    known = parser()
    given = known.parse_args(arguments)
    if given.command == "query":
        from lectern.plans.queries import QUERIES

        if given.name not in QUERIES:
            known.error(f"no query {given.name}; there are {', '.join(sorted(QUERIES))}")
        QUERIES[given.name](local_session(), given.sf_dir).show(given.rows, truncate=80)
        return 0
    books = epub.read_epubs(local_session(), given.path).filter("size(spine) > 0")
    if books.isEmpty():
        return 2
    fields = {"max_chars": given.max_chars, "latin": given.latin, "lang": given.lang, "chapters": given.chapters}
    if given.command == "inspect":
        print_rows(inspected(books, pipeline.Options(**fields)))
        return 0
    if given.command == "edit":
        if given.lang not in (None, "ru") or not books.filter(~F.col("language").startswith("ru")).isEmpty():
            return 2  # the editor's rules are for Russian
        print_rows(edited(books, pipeline.Options(**fields), given.editor, given.out))
        return 0
    options = pipeline.Options(**fields, limit=given.limit, retries=given.retries, seed=given.seed, sample_rate=given.sample_rate)
    made = pipeline.convert(books, given.out, given.voice, given.ears, options)
    print_rows(made["report"].orderBy("book_id", "chapter_index"))
    return 1 if print_rows(made["problems"]) else 0


if __name__ == "__main__":
    raise SystemExit(main())
