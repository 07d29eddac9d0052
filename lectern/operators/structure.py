"""Structure of books: chapters from tables of contents, unlisted text, edits, batches and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import narration
from lectern.functions import text as T

UNLISTED_LEAST = 500
UNKNOWN_POSITION = 1_000_000
CHARS_PER_HOUR = 15 * 3600


def chapters_of(toc: DataFrame, spine: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``book_id, chapter_index, title, nav_path, src, paragraphs`` from the entries of a table of contents.

    ``toc``: ``book_id, entry, nav_path, file, anchor``; ``spine``: ``book_id, file, position``; ``paragraphs``:
    ``book_id, file, anchor, p_i, text``. Entries follow the spine, unknown files last; entries that name no content or
    have no text are dropped, as is a first paragraph that repeats the label; what is left is numbered from 1.
    """
    label = F.try_element_at("nav_path", F.lit(-1))
    texts = paragraphs.filter(F.length("text") > 0).groupBy("book_id", "file", "anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_i", "text"))), lambda x: x["text"]).alias("paragraphs"))
    placed = toc.join(spine, ["book_id", "file"], "left").withColumn("position", F.coalesce("position", F.lit(UNKNOWN_POSITION)))
    joined = placed.filter(~T.is_non_content(label, F.col("nav_path"))).join(texts, ["book_id", "file", "anchor"])
    repeats = F.coalesce(F.lower(F.element_at("paragraphs", 1)) == F.lower(label), F.lit(False))
    kept = joined.withColumn("paragraphs", F.when(repeats, F.slice("paragraphs", 2, F.size("paragraphs"))).otherwise(F.col("paragraphs"))).filter(F.size("paragraphs") > 0)
    number = F.row_number().over(W.partitionBy("book_id").orderBy("position", "entry"))
    return kept.select("book_id", number.alias("chapter_index"), T.flatten_title(F.col("nav_path")).alias("title"), "nav_path", F.concat_ws("#", "file", F.nullif("anchor", F.lit(""))).alias("src"), "paragraphs")


def unlisted_text(texts: DataFrame, listed: DataFrame, key: str, least: int = UNLISTED_LEAST) -> DataFrame:
    """``key, chars``: files that no entry lists and whose text together is longer than ``least`` characters."""
    return texts.join(listed.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars")).filter(F.col("chars") > least)


def apply_edits(chunks: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with the text and pause of their edit, where there is one; the last edit of a key wins by ``edit_i``."""
    last = edits.groupBy(*keys).agg(F.max_by(F.struct(F.col("text").alias("new_text"), F.col("pause").alias("new_pause")), "edit_i").alias("e"))
    joined = chunks.join(last, keys, "left")
    return joined.withColumn("text", F.coalesce("e.new_text", "text")).withColumn("pause_ms", T.scale_pause(F.col("pause_ms"), F.col("e.new_pause"))).drop("e")


def judge_edits(chunks: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``outcome`` to each edit: unknown, blank, rejected (its letters differ), unchanged or accepted."""
    own = chunks.select(*keys, F.col("text").alias("own_text"))
    joined = edits.join(own, keys, "left")
    blank = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    outcome = (
        F.when(F.col("own_text").isNull(), "unknown")
        .when(blank, "blank")
        .when(T.letters_only(F.col("text")) != T.letters_only(F.col("own_text")), "rejected")
        .when((F.col("text") == F.col("own_text")) & F.col("pause").isNull(), "unchanged")
        .otherwise("accepted")
    )
    return joined.withColumn("outcome", outcome).drop("own_text")


def batches(rows: DataFrame, group: str, order: str, size: int = 20) -> DataFrame:
    """Adds ``batch`` from 0: rows of a group in order, ``size`` to a batch."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size).cast("long"))


def passage(chunks: DataFrame, group: str, order: str, seconds: float) -> DataFrame:
    """The first chunks of each group that together last ``seconds`` and end with a paragraph; all where none do."""
    running = F.sum(F.lit(0.55) + F.length("text") / 15.0).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    enough = F.coalesce(F.col("is_paragraph_end"), F.lit(False)) & (F.col("_t") >= seconds)
    timed = chunks.withColumn("_t", running)
    last = F.min(F.when(enough, F.col(order))).over(W.partitionBy(group))
    return timed.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_t", "_last")


def ordered_digest(chunks: DataFrame, group: str, order: str) -> DataFrame:
    """``group, digest`` over the texts of a group in order; the texts of a group must fit a task."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return chunks.groupBy(group).agg(T.digest(texts).alias("digest"))


def inspect_by(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, characters, sentences, mean length and hours of audio by key; one pass with partial aggregation."""
    clean = T.clean_inline(F.col("text"))
    rows = documents.select(*keys, clean.alias("clean")).withColumn("n", F.size(T.sentences_crude(F.col("clean"))))
    chars = F.sum(F.length("clean"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(chars, F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.sum(F.when(F.col("clean").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("sentences"),
        F.round(F.avg(F.length("clean")), 4).alias("mean_chars"),
        F.round(F.coalesce(chars, F.lit(0)) / CHARS_PER_HOUR, 6).alias("hours"),
    )


_CHUNKS = "chunk_i int, text string, pause_ms int, is_paragraph_end boolean, voice string"


def chunk_documents(documents: DataFrame, key: str, max_chars: int = narration.MAX_CHARS, latin: str = "route") -> DataFrame:
    """``key`` and the chunks of each document of ``key, lang, text``; paragraphs are parted by empty lines.

    Null and empty texts have no chunk; a null language takes the rules for English. The mode is checked at once.
    """
    if latin not in narration.LATIN_MODES:
        raise ValueError(f"latin must be one of {narration.LATIN_MODES}, not {latin!r}")
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, lang, text in zip(frame[key], frame["lang"], frame["text"]):
                found = narration.chunk_paragraphs((text or "").split("\n\n"), (lang or "").lower(), max_chars, latin=latin)
                rows += [(k, c.index, c.text, c.pause_ms, c.is_paragraph_end, c.lang) for c in found.chunks]
            yield pd.DataFrame(rows, columns=[key, "chunk_i", "text", "pause_ms", "is_paragraph_end", "voice"])

    return documents.select(key, "lang", "text").mapInPandas(run, f"`{key}` {kind}, {_CHUNKS}")


def expansion_counts(documents: DataFrame, key: str) -> DataFrame:
    """``key, kind, n``: how often each kind of rewriting happened in each document of ``key, lang, text``."""
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, what, n) for k, lang, text in zip(frame[key], frame["lang"], frame["text"]) for what, n in narration.normalise(text or "", (lang or "").lower())[1].items()]
            yield pd.DataFrame(rows, columns=[key, "kind", "n"])

    return documents.select(key, "lang", "text").mapInPandas(run, f"`{key}` {kind}, kind string, n long")


def edit_cache(judged: DataFrame, chunks: DataFrame, group: str, order: str, keys: list[str], model: str) -> DataFrame:
    """``group, json``: for each group the digest of its texts, its accepted edits and its rejected ones, as one record.

    ``judged`` is the result of :func:`judge_edits` with the columns of ``keys``; a group without edits has a record too.
    A cache is of use only while the digest is that of the texts.
    """
    digests = ordered_digest(chunks, group, order).join(chunks.groupBy(group).agg(F.count(F.lit(1)).alias("chunks")), group)
    place = chunks.select(*keys, F.col(group).alias("_group"), F.col(order).alias("i"))
    own = judged.select(*keys, "text", "pause", "outcome").join(place, keys)
    own = own.drop("_group") if group in keys else own.withColumnRenamed("_group", group)
    pick = lambda outcome, *fields: F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.struct("i", *fields))))
    found = own.groupBy(group).agg(pick("accepted", "text", "pause").alias("edits"), pick("rejected", "text").alias("rejected"))
    joined = digests.join(found, group, "left")
    return joined.select(group, F.to_json(F.struct(F.lit(model).alias("model"), "chunks", "digest", "edits", "rejected")).alias("json"))
