"""Reports: summaries, pivots, rankings, markers and checks, over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LADDER = (32, 40, 48, 56, 64)


def backend_summary(rows: DataFrame, book_hours: float) -> DataFrame:
    """By backend: median and highest error rate, median rtf (without null and zero), clipped and failed rows, hours."""
    median = F.median(F.nullif(F.col("rtf"), F.lit(0.0)))
    return rows.groupBy("backend").agg(
        F.round(F.median("cer"), 6).alias("median_cer"),
        F.round(F.max("cer"), 6).alias("max_cer"),
        F.round(median, 6).alias("median_rtf"),
        F.count_if(F.col("peak") >= 1).alias("clipped"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.round(median * book_hours, 6).alias("hours"),
    )


def cell_status(ok: Column, cer: Column) -> Column:
    return F.when(~ok, "bad").when(cer > 0.10, "warn").otherwise("good")


def pivot_first(rows: DataFrame, row: str, column: str, values: Sequence[str], cell: str, order: str, missing: str = "-") -> DataFrame:
    """One column for each of ``values``: the first cell by ``order``, or a mark where there is none."""
    out = rows.groupBy(row).pivot(column, list(values)).agg(F.min_by(cell, order))
    return out.fillna(missing, list(values))


def first_appearance(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the place of their first row."""
    return rows.groupBy(column).agg(F.min(order).alias("first"))


def strided_windows(timelines: DataFrame, key: str, begin: str, end: str, skip: int, stride: int, length: int, margin: int) -> DataFrame:
    """``key, window_start``: windows at a stride from ``begin + skip`` that end before ``end - margin``; whole seconds."""
    first = F.col(begin) + skip
    last = F.col(end) - margin - length - 1
    return timelines.filter(last >= first).select(key, F.explode(F.sequence(first, last, F.lit(stride))).alias("window_start"))


def band_filter(rows: DataFrame, bands: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows within all bands; null values are outside."""
    keep = F.lit(True)
    for name, (low, high) in bands.items():
        keep = keep & (F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high)
    return rows.filter(keep)


def top_rows(rows: DataFrame, order: Sequence[Column | str], count: int) -> DataFrame:
    """The first rows in an order that ends with a unique key; a heap for each task, no full sort."""
    return rows.orderBy(*order).limit(count)


def best_voices(rows: DataFrame, count: int, first_order: Sequence[Column | str], last_order: Sequence[Column | str], least_words: int = 8) -> DataFrame:
    """Three times ``count`` by the first order; of those with enough words twice ``count``; of these ``count`` by the last."""
    short = top_rows(rows, first_order, 3 * count).filter(F.col("words") >= least_words)
    return top_rows(top_rows(short, first_order, 2 * count), last_order, count)


def complete_sentence(text: Column) -> Column:
    """Whether a stop stands among the last three characters."""
    return F.coalesce(F.substring(F.trim(text), -3, 3).rlike("[.!?…]"), F.lit(False))


def nonfinite_scan(samples: DataFrame, sample_rate: int) -> DataFrame:
    """``file, bad, total, first_seconds`` of ``file, position, sample`` for files with a sample that is no number."""
    bad = F.isnan("sample") | (F.abs("sample") == float("inf"))
    found = samples.groupBy("file").agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("total"), F.min(F.when(bad, F.col("position"))).alias("first"))
    return found.filter("bad > 0").select("file", "bad", "total", (F.col("first") / sample_rate).alias("first_seconds"))


def bitrate(limit_mb: Column, seconds: Column, has_cover: Column, least: int = 32) -> Column:
    """The highest rung at which a file stays below the limit, or the least allowed one."""
    bits = (limit_mb - F.lit(0.4) - F.when(has_cover, 0.25).otherwise(0.0)) * 1048576 * 8
    wanted = F.floor(bits / seconds / 1000 * 0.97)
    rungs = F.array(*(F.lit(r) for r in LADDER if r >= least))
    return F.coalesce(F.array_max(F.filter(rungs, lambda r: r <= wanted)), F.lit(least))


def chapter_markers(chapters: DataFrame, book: str, order: str) -> DataFrame:
    """Adds ``start_ms, end_ms`` from the running sum of ``seconds`` by book; each starts where the one before ends."""
    by = W.partitionBy(book).orderBy(order)
    end = F.bround(F.sum("seconds").over(by.rowsBetween(W.unboundedPreceding, 0)) * 1000).cast("long")
    out = chapters.withColumn("end_ms", end)
    return out.withColumn("start_ms", F.coalesce(F.lag("end_ms").over(by), F.lit(0)).cast("long"))


def missing_rows(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected rows whose keys are not there; null keys match nothing."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def container_problems(probe: Column) -> Column:
    """What keeps a file from being an audiobook: ``struct<media_type, title, chapters, audio_codecs, has_video>``."""
    codec = F.try_element_at(probe["audio_codecs"], F.lit(1))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(probe["media_type"], F.lit("")) != "2", "media_type is not 2"),
            F.when(F.coalesce(probe["chapters"], F.lit(0)) == 0, "no chapters"),
            F.when(codec.isNull(), "no audio stream").when(codec != "aac", F.concat(F.lit("audio codec is "), codec, F.lit(", expected aac"))),
            F.when(F.coalesce(F.length(probe["title"]), F.lit(0)) == 0, "no title tag"),
            F.when(~F.coalesce(probe["has_video"], F.lit(False)), "no cover art"),
        )
    )


def train_val_split(rows: DataFrame, key: str, val_rows: int, seed: int) -> DataFrame:
    """Adds ``part``: the ``val_rows`` rows with the least hash are ``val``, the others ``train``.

    The rows come from a bounded top-k, so nothing is ranked globally; ties are broken by the key, which must be
    unique. Not the permutation of any other generator.
    """
    hashed = rows.drop("part").withColumn("_h", F.md5(F.concat_ws("/", F.lit(seed), F.col(key))))
    chosen = hashed.orderBy("_h", key).limit(val_rows).select(key, F.lit("val").alias("_part"))
    return hashed.drop("_h").join(chosen, key, "left").withColumn("part", F.coalesce("_part", F.lit("train"))).drop("_part")


def longest_runs(rows: DataFrame, group: str, order: Sequence[str], flag: Column) -> DataFrame:
    """``group, longest``: the longest run of consecutive rows with the flag; 0 where there is none. Null is not set."""
    by = W.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(by))
    island = F.col("_n") - F.row_number().over(W.partitionBy(group, "_f").orderBy(*order))
    sizes = marked.withColumn("_i", island).groupBy(group, "_f", "_i").count()
    return sizes.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("count"))), F.lit(0)).alias("longest"))


def chapter_report(chunks: DataFrame, checks: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """By book and chapter: chunks, checks beyond the first of a chunk, and chunks whose checks all failed.

    With ``levels`` (``chunk_id, samples, squares, peak``: how many samples a chunk has, the sum of their squares and the
    highest), ``rms`` and ``peak`` of the chapter in dB too, null where it has no samples.
    """
    by_chunk = checks.groupBy("chunk_id").agg(F.count_distinct("check_id").alias("checks"), F.bool_or("ok").alias("passed"))
    joined = chunks.join(by_chunk, "chunk_id", "left")
    more = []
    if levels is not None:
        joined = joined.join(levels.select("chunk_id", "samples", "squares", F.col("peak").alias("top")), "chunk_id", "left")
        decibels = lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-12)))
        more = [decibels(F.sqrt(F.try_divide(F.sum("squares"), F.sum("samples")))).alias("rms"), decibels(F.max("top")).alias("peak")]
        more = [F.when(F.sum("samples") > 0, c).alias(n) for c, n in zip(more, ("rms", "peak"))]
    return joined.groupBy("book_id", "chapter_index").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum(F.greatest(F.col("checks") - 1, F.lit(0))), F.lit(0)).alias("retries"),
        F.count_if(~F.col("passed")).alias("flagged"),
        *more,
    )
