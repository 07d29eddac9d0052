"""Queries of the sources and sinks: files in their formats are made from the tables, and read back.

The readers take ``path, content`` or ``name, value``, as the file sources give them, so the queries need no folder.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import epub, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NOT_XML = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def _xml(text: str | None) -> str:
    return html.escape(_NOT_XML.sub("", text or ""))


class _Book:
    """An archive that grows by a page for each chapter. Its table of contents is a map of points, a list of links, or,
    of every third book, absent."""

    def __init__(self, book: int, title: str | None, author: str | None, language: str | None) -> None:
        self.book, self.chapters, self.out = book, [], io.BytesIO()
        self.meta = f"<dc:title>{_xml(title)}</dc:title><dc:creator>{_xml(author)}</dc:creator><dc:language>{_xml(language)}</dc:language>"
        self.zip = zipfile.ZipFile(self.out, "w")

    def add(self, c: int, paragraphs: list[str | None]) -> None:
        body = f'<h2 id="h">Part {c}</h2>' + "".join(f"<p>{_xml(p)}</p>" for p in paragraphs)
        self.zip.writestr(f"b/text/c{c}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>{body}</body></html>')
        self.chapters.append(c)

    def content(self) -> bytes:
        kind = ("ncx", "nav", "none")[self.book % 3]
        items = [f'<item id="c{c}" href="text/c{c}.xhtml" media-type="application/xhtml+xml"/>' for c in self.chapters]
        items.append('<item id="art" href="img/cover.png" media-type="image/png" properties="cover-image"/>')
        if kind == "ncx":
            items.append('<item id="toc" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
        if kind == "nav":
            items.append('<item id="toc" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>')
        refs = "".join(f'<itemref idref="c{c}"/>' for c in self.chapters)
        with self.zip as z:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b/book.opf"/></rootfiles></container>')
            z.writestr("b/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{self.meta}</metadata><manifest>{"".join(items)}</manifest><spine>{refs}</spine></package>')
            if kind == "ncx":
                points = "".join(f'<navPoint><navLabel><text>Part {c}</text></navLabel><content src="text/c{c}.xhtml#h"/></navPoint>' for c in self.chapters)
                z.writestr("b/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
            if kind == "nav":
                links = "".join(f'<li><a href="text/c{c}.xhtml">Part {c}</a></li>' for c in self.chapters)
                z.writestr("b/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
            z.writestr("b/img/cover.png", f"cover {self.book}")
        return self.out.getvalue()


#: Bytes of archives after which a batch leaves the worker.
_BATCH_BYTES = 4_000_000


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, content`` of rows sorted by book: first the book's own rows, then its chapters, added as they come."""
    book, open_books, paths, contents = None, [], [], []

    def closed() -> None:
        for made in open_books:
            if made.chapters:
                paths.append(f"books/{made.book}.epub")
                contents.append(made.content())
        open_books.clear()

    def batch_made() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        paths.clear()
        contents.clear()
        return found

    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for k, (b, is_chapter) in enumerate(zip(columns["book_id"].to_pylist(), columns["is_chapter"].to_pylist())):
            if b != book:
                closed()
                book = b
                if sum(map(len, contents)) > _BATCH_BYTES:
                    yield batch_made()
            if is_chapter:
                for made in open_books:
                    made.add(columns["chapter_id"][k].as_py(), columns["paragraphs"][k].as_py())
            else:
                open_books.append(_Book(b, *(columns[c][k].as_py() for c in ("title", "author", "language"))))
    closed()
    yield batch_made()


def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the books and their chapters that :func:`_made` takes."""
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    chapters = read(spark, sf_dir, "chapters").select("book_id", F.lit(True).alias("is_chapter"), "chapter_id", F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"), *nothing("string", "title", "author", "language"))
    books = read(spark, sf_dir, "books").select("book_id", F.lit(False).alias("is_chapter"), *nothing("long", "chapter_id"), *nothing("array<string>", "paragraphs"), "title", "author", "language")
    # One shuffle of both brings a book together in order, and a book of any length passes through as rows. A join could
    # be split where a book is large, so that its chapters were in several tasks.
    return books.unionByName(chapters).filter("book_id IS NOT NULL").repartition("book_id").sortWithinPartitions("book_id", "is_chapter", "chapter_id", "paragraphs")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: an archive of each book that has chapters."""
    return _in_order(spark, sf_dir).mapInArrow(_made, "path string, content binary")


def _id(path: str) -> F.Column:
    return F.regexp_extract(path, "books/(\\d+)", 1).cast("long")


@query
def epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, manifest, spine, table of contents and paragraphs of every archive."""
    books = epub.parse_epubs(archives(spark, sf_dir))
    parts = [F.size(c).alias(f"n_{c}") for c in ("manifest", "spine", "toc", "paragraphs", "warnings")]
    return books.select(_id("path").alias("book_id"), "title", "author", "language", *parts)


@query
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of every archive, by whichever table of contents it has."""
    found = epub.archive_chapters(_in_order(spark, sf_dir), _made)
    return found.select(_id("book_id").alias("book_id"), "chapter_index", "title", "src", F.size("paragraphs").alias("n_paragraphs"), F.md5(F.array_join("paragraphs", "\n")).alias("digest"))


@query
def epub_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cover of every archive, and its bytes."""
    return epub.cover_images(archives(spark, sf_dir)).select(_id("book_id").alias("book_id"), "cover", F.col("content").cast("string").alias("bytes"))


@query
def epub_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some figures of the record that is written of every book."""
    record = F.from_json("json", "title string, char_count long, chapters array<struct<chapter_index: int, title: string>>")
    return epub.archive_json(_in_order(spark, sf_dir), _made).select(_id("book_id").alias("book_id"), record.alias("r")).select("book_id", F.col("r.title").alias("title"), F.coalesce("r.char_count", F.lit(0)).cast("long").alias("chars"), F.coalesce(F.size("r.chapters"), F.lit(0)).alias("chapters"))


@query
def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries of ``key = value # comment`` with repeated keys and lines that are none."""
    line = F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" = "), F.col("p_name"), F.lit(" = x # "), F.col("p_type"))
    texts = read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("string").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n# all\n\nnone\n = z\n").alias("value"))
    return files.key_value_texts(texts, lower_keys=True)


@query
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of ``path|text|...``, joined to its files by the names without folder and ending."""
    chunks = read(spark, sf_dir, "chunks")
    lines = chunks.select(F.when(F.col("text").isNull(), F.col("chunk_id").cast("string")).otherwise(F.concat(F.lit("wav/"), "chunk_id", F.lit(".wav| "), F.translate("text", "|\n\r", "/  "), F.lit(" |x"))).alias("value"))
    found = files.piped_lines(lines, "/data/")
    metadata = found.select(F.regexp_extract("path", "(\\d+)\\.wav$", 1).alias("stem"), "text")
    return files.corpus_by_stem(metadata, found.select("path"))


@query
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every attempt, each one array of rows, with one text that is none."""
    rows = read(spark, sf_dir, "checks").groupBy("attempt").agg(F.to_json(F.collect_list(F.struct(F.col("check_id").cast("string").alias("case"), F.col("transcript"), "cer", "ok", "reasons"))).alias("value"))
    texts = rows.select(F.concat(F.lit("out/gen_"), "attempt", F.lit(".json")).alias("name"), "value").unionByName(spark.createDataFrame([("out/gen_0.json", "not json")], "name string, value string"))
    found = files.report_rows(texts)
    return found.groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.count("transcript").alias("heard"), F.count_if("ok").alias("good"), F.round(F.sum("cer"), 4).alias("cer"), F.sum(F.size("reasons")).alias("reasons"))


@query
def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as audio files of 16 bits, read back."""

    @F.pandas_udf("binary")
    def encoded(audio: pd.Series) -> pd.Series:
        return audio.map(lambda x: files.encode_wav(np.asarray(x, float), 16))

    rows = read(spark, sf_dir, "embeddings").select(F.concat("vec_id", F.lit(".wav")).alias("path"), encoded("embedding").alias("content"))
    found = files.decoded_wavs(rows)
    return found.select(F.regexp_extract("path", "\\d+", 0).cast("long").alias("vec_id"), "sample_rate", "seconds", F.round(F.aggregate("audio", F.lit(0.0), lambda s, x: s + F.abs(x)), 2).alias("total"))


@query
def probe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters that a probe of a file names, or the whole of it."""
    seconds = lambda p: F.size(p) / 4
    chapters = read(spark, sf_dir, "chapters").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_id", seconds(F.coalesce("paragraphs", F.array().cast("array<string>"))).alias("s")))).alias("c"))
    spans = F.transform("c", lambda x: F.struct(F.lit("0.5").alias("start_time"), x["s"].cast("string").alias("end_time")))
    duration = F.struct((F.col("book_id") / 2).cast("string").alias("duration"))
    probes = chapters.select(F.col("book_id").alias("file"), F.to_json(F.struct(duration.alias("format"), F.when(F.col("book_id") % 2 == 0, spans).otherwise(F.slice(spans, 1, 0)).alias("chapters"))).alias("probe"))
    return files.probe_chapters(probes)


@query
def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two to six letters of a list, here all that stand between spaces in the chunks."""
    return files.listed_words(read(spark, sf_dir, "chunks").select(F.explode(F.split("text", " ")).alias("value"))).distinct()


@query
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report of every chunk: the error rate of each of its attempts, with the class of the cell."""
    rows = read(spark, sf_dir, "checks").select("chunk_id", F.col("attempt").cast("string").alias("attempt"), "ok", "cer", "check_id")
    return files.html_report(rows, "chunk_id", "attempt", ["1", "2", "3"], "check_id")


_CLEAN = "trim(regexp_replace(replace(regexp_replace(replace(nfc_normalize({0}), chr(173), ''), '\\[\\s*\\d{{1,3}}\\s*\\]', '', 'g'), chr(10), ' '), '[ \\t\\x{{a0}}\\x{{2009}}\\x{{202f}}]+', ' ', 'g'), ' ')"


def _clean(text: str) -> str:
    return _CLEAN.format(text)


_PAGES = f"(SELECT book_id, chapter_id, list_filter(list_transform(coalesce(paragraphs, []), lambda p: {_clean('coalesce(p, chr(32))')}), lambda p: length(p) > 0) AS p FROM chapters WHERE book_id IN (SELECT book_id FROM books))"
#: The heading of a page repeats the label of the entry, where there is a table of contents.
_MADE = f"""(SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_id) AS INTEGER) AS chapter_index, chapter_id,
        CASE WHEN book_id % 3 = 2 THEN list_concat(['Part ' || chapter_id], p) ELSE p END AS p FROM {_PAGES} WHERE book_id % 3 = 2 OR len(p) > 0)"""
_CELL = "'<td class=\"' || coalesce({1}, 'none') || '\">' || coalesce({0}, '-') || '</td>'"

ORACLE = {
    "epub_books": f"""
        SELECT b.book_id, {_clean("coalesce(title, '')")} AS title, {_clean("coalesce(author, '')")} AS author, lower({_clean("coalesce(language, '')")}) AS language,
            CAST(n + 1 + CASE WHEN b.book_id % 3 = 2 THEN 0 ELSE 1 END AS INTEGER) AS n_manifest, CAST(n AS INTEGER) AS n_spine, CAST(CASE WHEN b.book_id % 3 = 2 THEN 0 ELSE n END AS INTEGER) AS n_toc, CAST(m AS INTEGER) AS n_paragraphs, 0 AS n_warnings
        FROM books b JOIN (SELECT book_id, count(*) AS n, sum(len(p) + 1) AS m FROM {_PAGES} GROUP BY book_id) c ON c.book_id = b.book_id""",
    "epub_chapters": f"""
        SELECT book_id, chapter_index, CASE WHEN book_id % 3 = 2 THEN 'c' || chapter_id ELSE 'Part ' || chapter_id END AS title, 'b/text/c' || chapter_id || '.xhtml' || CASE WHEN book_id % 3 = 0 THEN '#h' ELSE '' END AS src,
            CAST(len(p) AS INTEGER) AS n_paragraphs, md5(array_to_string(p, chr(10))) AS digest FROM {_MADE}""",
    "epub_covers": "SELECT book_id, 'b/img/cover.png' AS cover, 'cover ' || book_id AS bytes FROM books WHERE book_id IN (SELECT book_id FROM chapters)",
    "epub_json": f"""
        SELECT b.book_id, {_clean("coalesce(title, '')")} AS title, CAST(coalesce(c, 0) AS BIGINT) AS chars, CAST(coalesce(n, 0) AS INTEGER) AS chapters
        FROM books b LEFT JOIN (SELECT book_id, sum(list_sum(list_transform(p, lambda x: length(x)))) AS c, count(*) AS n FROM {_MADE} GROUP BY book_id) m ON m.book_id = b.book_id WHERE b.book_id IN (SELECT book_id FROM chapters)""",
    "dictionary_lines": "SELECT lower(replace(p_brand, '#', '_')) AS key, arg_max(p_name || ' = x', (CAST(p_size AS VARCHAR), p_partkey)) AS value FROM part GROUP BY 1",
    "corpus_lines": "SELECT '/data/wav/' || chunk_id || '.wav' AS path, trim(translate(text, '|' || chr(10) || chr(13), '/  '), ' ') AS text FROM chunks WHERE text IS NOT NULL",
    "report_rows": """
        SELECT 'gen_' || attempt || '.json' AS report, count(*) AS n, count(transcript) AS heard, count(*) FILTER (WHERE ok) AS good, round(sum(cer), 4) AS cer, CAST(sum(len(reasons)) AS BIGINT) AS reasons FROM checks GROUP BY attempt""",
    "wav_samples": """
        SELECT vec_id, 16 AS sample_rate, len(embedding) / 16.0::DOUBLE AS seconds, round(list_sum(list_transform(embedding, lambda x: abs(round_even(greatest(-1, least(1, x::DOUBLE)) * 32767, 0) / 32768))), 2) AS total FROM embeddings""",
    "probe_spans": """
        SELECT book_id AS file, CAST(i AS INTEGER) AS chapter, 0.5::DOUBLE AS start, s AS "end" FROM (
            SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id) - 1 AS i, coalesce(len(paragraphs), 0) / 4.0::DOUBLE AS s FROM chapters) WHERE book_id % 2 = 0
        UNION ALL SELECT DISTINCT book_id, 0, 0.0::DOUBLE, book_id / 2.0::DOUBLE FROM chapters WHERE book_id % 2 = 1""",
    "listed_words": "SELECT DISTINCT lower(trim(w, ' ')) AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM chunks) WHERE length(lower(trim(w, ' '))) BETWEEN 2 AND 6",
    "report_html": f"""
        WITH f AS (SELECT chunk_id, attempt, arg_min({{'ok': coalesce(ok, false), 'cer': cer}}, check_id) AS s FROM checks GROUP BY chunk_id, attempt),
        c AS (SELECT chunk_id, attempt, coalesce(format('{{:.1f}}', floor(s.cer * 1000 + 0.5) / 10) || ' %', '?') AS text, CASE WHEN NOT s.ok THEN 'bad' WHEN s.cer > 0.10 THEN 'warn' ELSE 'good' END AS css FROM f)
        SELECT chunk_id, '<tr><td class="case">' || chunk_id || '</td>' || {" || ".join(_CELL.format(f"max(text) FILTER (WHERE attempt = {k})", f"max(css) FILTER (WHERE attempt = {k})") for k in (1, 2, 3))} || '</tr>' AS html FROM c GROUP BY chunk_id""",
}
