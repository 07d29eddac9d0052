"""Books to chapters of audio: the operators in the order of a whole conversion, with models that are passed in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import arrays, narration
from lectern.functions import text as T
from lectern.operators import contracts, reports, structure, verify
from lectern.sources import epub, files


@dataclass(frozen=True)
class Options:
    """What a conversion depends on. ``chapters`` is a list like ``1,3,7-9``; ``limit`` counts chunks of each chapter."""

    max_chars: int = narration.MAX_CHARS
    latin: str = "route"
    lang: str | None = None
    chapters: str | None = None
    limit: int | None = None
    retries: int = 2
    seed: int = 0
    sample_rate: int = 24_000


def chunked_books(books: DataFrame, options: Options = Options()) -> DataFrame:
    """``book_id, chapter_index, chunk_index, title, text, pause_ms, is_paragraph_end, lang`` of archives."""
    made = epub.chapters(books).drop("warnings")
    if options.chapters is not None:
        made = made.filter(F.array_contains(T.chapter_numbers(F.lit(options.chapters), F.lit((1 << 31) - 1)), F.col("chapter_index")))
    langs = books.select(F.col("path").alias("book_id"), F.lit(options.lang).alias("lang") if options.lang else F.col("language").alias("lang"))
    texts = made.join(langs, "book_id").withColumn("key", F.to_json(F.struct("book_id", "chapter_index")))
    chunks = structure.chunk_documents(texts.select("key", "lang", F.array_join("paragraphs", "\n\n").alias("text")), "key", options.max_chars, options.latin)
    if options.limit is not None:
        chunks = chunks.filter(F.col("chunk_i") <= options.limit)
    joined = chunks.join(texts.select("key", "book_id", "chapter_index", "title", F.col("lang").alias("book_lang")), "key")
    lang = F.when(F.col("voice") != "", F.col("voice")).otherwise(F.col("book_lang"))
    return joined.select("book_id", "chapter_index", F.col("chunk_i").alias("chunk_index"), "title", "text", "pause_ms", "is_paragraph_end", lang.alias("lang"))


KEYS = ["book_id", "chapter_index", "chunk_index"]


def render(chunks: DataFrame, folder: str, voice: Callable, ears: Callable | None, options: Options = Options()) -> DataFrame:
    """Adds ``attempt, audio, sample_rate, heard, ok, cer, reasons``: the kept attempt of every chunk.

    Only chunks whose attempt was not good are tried again. Every round is a table below ``folder``, which executors
    must share, so no work is done twice when some are lost. Without ``ears`` only the signal is checked.
    """
    spark = chunks.sparkSession
    pending = chunks
    for attempt in range(1, options.retries + 2):
        made = contracts.synthesise(pending, voice, 0, options.seed + contracts.SEED_STEP * (attempt - 1)).withColumn("attempt", F.lit(attempt))
        made = contracts.transcribe(made, ears) if ears is not None else made.withColumn("heard", F.lit(None).cast("string"))
        made = made.withColumn("signal_reasons", arrays.signal_reasons(F.col("audio"), F.col("sample_rate"), F.col("text")))
        verify.verdicts(made).drop("signal_reasons").write.mode("overwrite").parquet(f"{folder}/attempt={attempt}")
        pending = chunks.join(spark.read.parquet(f"{folder}/attempt={attempt}").filter("not ok").select(*KEYS), KEYS, "left_semi")
    every = spark.read.option("basePath", folder).parquet(*(f"{folder}/attempt={k}" for k in range(1, options.retries + 2)))
    # The first good attempt, or the last one.
    place = F.when(F.col("ok"), F.col("attempt")).otherwise(F.lit(1 << 20) - F.col("attempt"))
    kept = every.groupBy(*KEYS).agg(F.min_by("attempt", place).alias("attempt"))
    return every.join(kept, [*KEYS, "attempt"])


def convert(books: DataFrame, folder: str, voice: Callable, ears: Callable | None = None, options: Options = Options()) -> dict[str, DataFrame]:
    """The tables of a conversion, read from below ``folder``: ``chunks``, ``chapters`` (audio and figures),
    ``metadata`` (chapter marks of each book), ``report`` and ``problems`` (chapters without audio)."""
    spark = books.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    chunks = stored(chunked_books(books, options), "chunks")
    kept = stored(render(chunks, f"{folder}/attempts", voice, ears, options), "renders")
    chapter = F.to_json(F.struct("book_id", "chapter_index"))
    pieces = kept.withColumn("chapter", chapter)
    audio = stored(contracts.assemble(pieces, "chapter", "chunk_index", options.sample_rate), "chapters")
    titles = chunks.select(chapter.alias("chapter"), "book_id", "chapter_index", "title").distinct()
    marks = reports.chapter_markers(audio.select("chapter", "seconds").join(titles, "chapter"), "book_id", "chapter_index")
    report = kept.groupBy("book_id", "chapter_index").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("attempt") - 1).alias("retries"), F.count_if(~F.col("ok")).alias("flagged"))
    found = epub.chapters(books).select(chapter.alias("chapter"))
    expected = titles.select("chapter") if options.chapters is not None else found
    return {
        "chunks": chunks,
        "chapters": audio,
        "metadata": stored(files.chapter_metadata(marks, "book_id", "chapter_index"), "metadata"),
        "report": stored(report, "report"),
        "problems": stored(reports.missing_rows(expected, audio.filter("seconds > 0"), ["chapter"]), "problems"),
    }
