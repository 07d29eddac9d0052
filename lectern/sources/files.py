"""Sources: dictionaries, delimited corpora, JSON reports, audio files, probe output, word lists; and sinks."""

from __future__ import annotations

import html
import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAKEOFF = (
    "backend string, `case` string, file string, text string, lang string, seconds double, synth_seconds double, rtf double, "
    "sample_rate int, peak double, rms_dbfs double, cer double, transcript string, reasons array<string>, ok boolean"
)
STREAMS = "array<struct<codec_type: string, codec_name: string>>"
PROBE = f"format struct<duration: string, tags: map<string,string>>, streams {STREAMS}, chapters array<struct<start_time: string, end_time: string>>"


def key_value_texts(texts: DataFrame, lower_keys: bool = False) -> DataFrame:
    """``key, value`` of texts ``name, value`` of lines ``key = value # comment``.

    Blank lines and lines without ``=`` are left out. Of equal keys the last wins: by line within a text, by name
    between texts.
    """
    lines = texts.select("name", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    bare = lines.withColumn("text", F.trim(F.substring_index("text", "#", 1))).filter(F.contains("text", F.lit("=")))
    key = F.trim(F.substring_index("text", "=", 1))
    parts = bare.select("name", "line", (F.lower(key) if lower_keys else key).alias("key"), F.trim(F.substring(F.col("text"), F.length(F.substring_index("text", "=", 1)) + 2, F.length("text"))).alias("value"))
    return parts.filter((F.length("key") > 0) & (F.length("value") > 0)).groupBy("key").agg(F.max_by("value", F.struct("name", "line")).alias("value"))


def key_value_file(spark: SparkSession, path: str, lower_keys: bool = False) -> DataFrame:
    """:func:`key_value_texts` of the files that a path names."""
    return key_value_texts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value"), lower_keys)


def piped_lines(lines: DataFrame, base: str = "") -> DataFrame:
    """``path, text`` of lines ``value`` of ``path|text|...``; lines with fewer than two fields are left out."""
    fields = F.split("value", r"\|")
    return lines.filter(F.size(fields) >= 2).select(F.concat(F.lit(base), fields[0]).alias("path"), F.trim(fields[1]).alias("text"))


def piped_corpus(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """:func:`piped_lines` of a file."""
    return piped_lines(spark.read.text(path), base)


def corpus_by_stem(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """``stem, text`` joined to ``path`` by the name of the file without its folder and ending; others drop out."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return metadata.join(files.select("path", stem.alias("stem")), "stem").select("path", "text")


def report_rows(texts: DataFrame) -> DataFrame:
    """The rows of reports ``name, value``, each text one array of rows, with the last part of the name as ``report``.

    A text that is no such array has no row.
    """
    rows = texts.select(F.substring_index("name", "/", -1).alias("report"), F.explode(F.from_json("value", F.lit(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in BAKEOFF.split(', '))}>>"))).alias("r"))
    return rows.select("r.*", "report")


def json_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """:func:`report_rows` of all files that a pattern names; a pattern without a file is an error of the reader."""
    return report_rows(spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("name"), "value"))


def word_list(spark: SparkSession, path: str | None, fallback: Sequence[str]) -> DataFrame:
    """``word``: the fallback, and of a list, where there is one, words of two to six letters."""
    base = spark.createDataFrame([(w,) for w in fallback], "word string")
    return base if path is None else base.unionByName(listed_words(spark.read.text(path))).distinct()


def listed_words(lines: DataFrame) -> DataFrame:
    """``word``: the lines ``value`` of two to six letters, in lower case."""
    return lines.select(F.lower(F.trim("value")).alias("word")).filter(F.length("word").between(2, 6))


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, channels averaged, and the rate of a PCM file."""
    with wave.open(io.BytesIO(data)) as file:
        width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
        raw = file.readframes(file.getnframes())
    if width == 3:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((wide[:, 2] << 24 | wide[:, 1] << 16 | wide[:, 0] << 8) >> 8) / float(1 << 23)
    elif width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        samples = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return samples.reshape(-1, channels).mean(1), rate


def decoded_wavs(files: DataFrame) -> DataFrame:
    """``path, sample_rate, seconds, audio array<double>`` of PCM files ``path, content``; unreadable ones have nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    audio, rate = decode_wav(bytes(content))
                    rows.append((name, rate, len(audio) / rate, audio.tolist()))
                except (wave.Error, EOFError, ValueError):
                    rows.append((name, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "seconds", "audio"])

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, seconds double, audio array<double>")


def wav_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """:func:`decoded_wavs` of the files below a path."""
    return decoded_wavs(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def encode_wav(audio: np.ndarray, rate: int) -> bytes:
    """One channel of 16 bits; samples beyond 1 are cut."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.round(np.clip(audio, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def directory_listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, length, modificationTime`` of the files that fit; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def probe_struct(text: Column) -> Column:
    """The output of a media probe as the struct that :func:`lectern.operators.reports.container_problems` takes."""
    p = F.from_json(text, PROBE)
    tags = F.transform_keys(F.coalesce(p["format"]["tags"], F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    kinds = lambda kind: F.filter(F.coalesce(p["streams"], F.array().cast(STREAMS)), lambda s: s["codec_type"] == kind)
    return F.struct(
        F.try_element_at(tags, F.lit("media_type")).alias("media_type"),
        F.try_element_at(tags, F.lit("title")).alias("title"),
        F.coalesce(F.size(p["chapters"]), F.lit(0)).alias("chapters"),
        F.transform(kinds("audio"), lambda s: s["codec_name"]).alias("audio_codecs"),
        (F.size(kinds("video")) > 0).alias("has_video"),
    )


def probe_chapters(probes: DataFrame) -> DataFrame:
    """``file, chapter, start, end`` of ``file, probe``: the chapters of a file, or the whole of it as one."""
    p = probes.select("file", F.from_json("probe", PROBE).alias("p"))
    named = F.transform("p.chapters", lambda c: F.struct(c["start_time"].cast("double").alias("start"), c["end_time"].cast("double").alias("end")))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.col("p.format.duration").cast("double").alias("end")))
    spans = F.when(F.coalesce(F.size("p.chapters"), F.lit(0)) > 0, named).otherwise(whole)
    return p.select("file", F.posexplode(spans).alias("chapter", "s")).select("file", "chapter", "s.start", "s.end")


# Sinks.


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Appends to a list that is only ever added to; the commit protocol makes each addition whole or absent."""
    df.write.mode("append").json(path)


def chapter_metadata(chapters: DataFrame, book: str, order: str) -> DataFrame:
    """``book, metadata``: a text with a part for each chapter of ``start_ms, end_ms, title``, in order."""
    from lectern.functions.text import escape_metadata

    part = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), "start_ms"), F.concat(F.lit("END="), "end_ms"), F.concat(F.lit("title="), escape_metadata(F.coalesce("title", F.lit("")))))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"])
    return chapters.groupBy(book).agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(parts, "\n"), F.lit("\n")).alias("metadata"))


def html_row(row: Column, css: Column) -> Column:
    """A row of a table from an array of texts, escaped, each cell with its class; null is an empty cell."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = F.zip_with(row, css, lambda c, k: F.concat(F.lit('<td class="'), F.coalesce(k, F.lit("")), F.lit('">'), escaped(c), F.lit("</td>")))
    return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))


def html_report(rows: DataFrame, row: str, column: str, values: Sequence[str], order: str) -> DataFrame:
    """``row, html``: a line of a report for each value of ``row``, with a cell for each of ``values``: the error rate of
    its first row by ``order``, with the class that :func:`lectern.operators.reports.cell_status` gives it, or a dash.

    The lines are rows of a table, so a report of any length is written by the tasks (``write.text``).
    """
    from lectern.operators.reports import cell_status

    ok = F.coalesce("ok", F.lit(False))
    first = rows.groupBy(row).pivot(column, list(values)).agg(F.min_by(F.struct(F.when(F.col("cer").isNotNull(), F.format_string("%.1f %%", F.floor(F.col("cer") * 1000 + 0.5) / 10)).alias("text"), cell_status(ok, F.col("cer")).alias("css")), order))
    texts = F.array(F.col(row).cast("string"), *(F.when(F.col(v).isNull(), "-").otherwise(F.coalesce(F.col(v)["text"], F.lit("?"))) for v in values))
    css = F.array(F.lit("case"), *(F.coalesce(F.col(v)["css"], F.lit("none")) for v in values))
    return first.select(row, html_row(texts, css).alias("html"))


def html_table(df: DataFrame, path: str) -> None:
    """Writes a table as lines of HTML, escaped, head first; each task writes its own rows."""
    head = "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
    rows = df.select(html_row(F.array(*(F.col(f"`{c}`").cast("string") for c in df.columns)), F.array(*(F.lit("") for _ in df.columns))).alias("value"))
    df.sparkSession.createDataFrame([(head,)], "value string").unionByName(rows).write.mode("overwrite").text(path)


def kept_ordinals(lines: DataFrame, order: str) -> DataFrame:
    """Lines with text and their number from 0 among all lines; by file, so that numbers need no global order."""
    number = F.row_number().over(W.partitionBy("file").orderBy(order)) - 1
    return lines.withColumn("ordinal", number).filter(F.length(F.trim("text")) > 0)
