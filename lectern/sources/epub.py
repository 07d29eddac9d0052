"""EPUB files as tables.

Each archive is opened once, in an Arrow batch, and yields plain records: metadata, manifest, spine, entries of the
table of contents and paragraphs under their anchors. The paragraphs of an entry are looked up where the archive is
read, file by file; which entries are chapters, their titles and numbers are decided on tables by the functions below.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import structure

# Names of the formats, tags of blocks and of what is skipped.
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF, DC = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"
NCX, OPS = "{http://www.daisy.org/z3986/2005/ncx/}", "{http://www.idpf.org/2007/ops}"
NCX_TYPE = "application/x-dtbncx+xml"
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td"}
SKIPPED = {"script", "style", "head", "title", "svg", "img", "image", "figure"}

SCHEMA = (
    "path string, title string, author string, language string, publisher string, pub_date string, identifier string, "
    "manifest array<struct<id: string, href: string, type: string, props: array<string>>>, cover_id string, "
    "spine array<string>, toc array<struct<nav_path: array<string>, file: string, anchor: string>>, "
    "paragraphs array<struct<file: string, anchor: string, p_i: int, text: string>>, warnings array<string>"
)
META = ("title", "author", "language", "publisher", "pub_date", "identifier")
#: What the tasks find of a book: a row for each entry that has text and each file that no entry names (``loose``); or,
#: where asked for, one row of its metadata.
_FOUND = pa.schema(
    [("book_id", pa.string()), ("meta", pa.struct([*((c, pa.string()) for c in META), ("warnings", pa.list_(pa.string()))])), ("loose", pa.bool_()), ("position", pa.int32()), ("entry", pa.int32())]
    + [("nav_path", pa.list_(pa.string())), ("file", pa.string()), ("anchor", pa.string()), ("paragraphs", pa.list_(pa.string()))]
)
_FOUND_DDL = (
    f"book_id string, meta struct<{', '.join(f'{c}: string' for c in META)}, warnings: array<string>>, loose boolean, position int, entry int, "
    "nav_path array<string>, file string, anchor string, paragraphs array<string>"
)
Make = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Characters of text after which a batch of rows leaves the worker.
BATCH_CHARS = 1_000_000


def clean(text: str) -> str:
    """One line of text: composed, without soft hyphens, footnote marks and runs of spaces."""
    text = re.sub(r"\[\s*\d{1,3}\s*\]", "", unicodedata.normalize("NFC", text).replace("­", ""))
    return re.sub("[ \t   ]+", " ", text.replace("\n", " ")).strip()


def name_of(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def text_of(node: ET.Element | None) -> str:
    return clean("".join(node.itertext())) if node is not None else ""


def paragraphs_of(document: ET.Element, anchors: set[str]) -> tuple[list[tuple[str, str]], set[str]]:
    """``(anchor, text)`` of the innermost blocks in document order, each under the last wanted anchor before it; and
    the anchors that were found. Skipped tags skip themselves, not what is in them."""
    body = next((n for n in document.iter() if name_of(n) == "body"), document)
    out, found, current = [], set(), ""
    for node in body.iter():
        if name_of(node) in SKIPPED:
            continue
        if node.get("id") in anchors:
            current = node.get("id")
            found.add(current)
        if name_of(node) in BLOCKS and not any(name_of(c) in BLOCKS for c in node.iter() if c is not node):
            text = text_of(node)
            if text:
                out.append((current, text))
    return out, found


def html_paragraphs(markup: str) -> list[str]:
    """Paragraphs of one page that is well-formed XML; of others an empty list."""
    try:
        return [t for _, t in paragraphs_of(ET.fromstring(markup), set())[0]]
    except ET.ParseError:
        return []


class _Archive:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        root = self.xml("META-INF/container.xml").find(f".//{CONTAINER}rootfile")
        if root is None or not root.get("full-path"):
            raise ValueError("no rootfile in container.xml")
        self.opf_path = root.get("full-path")
        self.opf = self.xml(self.opf_path)

    def xml(self, path: str) -> ET.Element:
        return ET.fromstring(self.zip.read(path))

    def near(self, base: str, href: str) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(base), href))

    def target(self, base: str, href: str) -> tuple[str, str]:
        file, _, anchor = href.partition("#")
        return self.near(base, file), anchor


def _label(text: str) -> str:
    return text.strip(" .—-–\t")


def _ncx(archive: _Archive, path: str) -> list[tuple[list[str], str, str]]:
    out: list[tuple[list[str], str, str]] = []

    def walk(node: ET.Element, trail: list[str]) -> None:
        for point in node.findall(f"{NCX}navPoint"):
            name = _label(text_of(point.find(f"{NCX}navLabel/{NCX}text")))
            below = [*trail, name] if name else trail
            content = point.find(f"{NCX}content")
            if content is not None and content.get("src"):
                out.append((below, *archive.target(path, content.get("src"))))
            walk(point, below)

    start = archive.xml(path).find(f"{NCX}navMap")
    if start is not None:
        walk(start, [])
    return out


def _nav(archive: _Archive, path: str) -> list[tuple[list[str], str, str]]:
    out: list[tuple[list[str], str, str]] = []

    def walk(items: ET.Element, trail: list[str]) -> None:
        for item in items:
            if name_of(item) != "li":
                continue
            link = next((n for n in item.iter() if name_of(n) == "a"), None)
            name = _label(text_of(link))
            below = [*trail, name] if name else trail
            if link is not None and link.get("href"):
                out.append((below, *archive.target(path, link.get("href"))))
            for part in item:
                if name_of(part) == "ol":
                    walk(part, below)

    nav = next((n for n in archive.xml(path).iter() if name_of(n) == "nav" and n.get(f"{OPS}type") == "toc"), None)
    for part in nav if nav is not None else ():
        if name_of(part) == "ol":
            walk(part, [])
    return out


def _opened(path: str, data: bytes) -> tuple[dict, _Archive | None]:
    """The record of an archive without paragraphs, and the archive, or a warning and None."""
    empty = dict.fromkeys((*META, "cover_id"), "")
    record = {"path": path, **empty, "manifest": [], "spine": [], "toc": [], "paragraphs": [], "warnings": []}
    try:
        archive = _Archive(data)
    except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as error:
        return record | {"warnings": [f"not an EPUB: {error}"]}, None
    for column, tag in (("title", "title"), ("author", "creator"), ("language", "language"), ("publisher", "publisher"), ("pub_date", "date"), ("identifier", "identifier")):
        record[column] = text_of(archive.opf.find(f".//{DC}{tag}"))
    record["language"] = record["language"].lower()
    items = [i for i in archive.opf.findall(f".//{OPF}manifest/{OPF}item") if i.get("id")]
    record["manifest"] = [{"id": i.get("id"), "href": archive.near(archive.opf_path, i.get("href")) if i.get("href") else "", "type": i.get("media-type", ""), "props": i.get("properties", "").split()} for i in items]
    cover = archive.opf.find(f".//{OPF}metadata/{OPF}meta[@name='cover']")
    record["cover_id"] = cover.get("content", "") if cover is not None else ""
    record["spine"] = [r.get("idref", "") for r in archive.opf.findall(f".//{OPF}spine/{OPF}itemref")]
    toc: list[tuple[list[str], str, str]] = []
    try:
        ncx = next((m["href"] for m in record["manifest"] if m["type"] == NCX_TYPE), None)
        nav = next((m["href"] for m in record["manifest"] if "nav" in m["props"]), None)
        toc = (_ncx(archive, ncx) if ncx else []) or (_nav(archive, nav) if nav else [])
    except (KeyError, ET.ParseError) as error:
        record["warnings"].append(f"unreadable table of contents: {error}")
    record["toc"] = [{"nav_path": trail, "file": file, "anchor": anchor} for trail, file, anchor in toc]
    return record, archive


def _pages(record: dict, archive: _Archive) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each file of the table of contents and the spine with its ``(anchor, text)``; warnings go to the record."""
    files = {m["id"]: m["href"] for m in record["manifest"]}
    anchors: dict[str, set[str]] = {}
    for entry in record["toc"]:
        anchors.setdefault(entry["file"], set()).update({entry["anchor"]} - {""})
    for file in dict.fromkeys([*anchors, *(files[i] for i in record["spine"] if files.get(i))]):
        wanted = anchors.get(file, set())
        try:
            found, seen = paragraphs_of(archive.xml(file), wanted)
        except (KeyError, ET.ParseError) as error:
            record["warnings"].append(f"could not parse {file}: {error}")
            continue
        if wanted - seen:
            record["warnings"].append(f"{file}: anchors not found: {sorted(wanted - seen)}")
        yield file, found


def parse(path: str, data: bytes) -> dict:
    """The record of one archive, with the columns of ``SCHEMA``; what cannot be read is a warning."""
    record, archive = _opened(path, data)
    for file, found in _pages(record, archive) if archive else ():
        record["paragraphs"] += [{"file": file, "anchor": anchor, "p_i": k, "text": text} for k, (anchor, text) in enumerate(found)]
    return record


def parse_epubs(files: DataFrame) -> DataFrame:
    """One row for each archive of ``path, content``, with the columns of ``SCHEMA``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([parse(p, bytes(c)) for p, c in zip(frame["path"], frame["content"])])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def archives(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """``path, content`` of the archives below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_epubs(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """One row for each archive below a path, with the columns of ``SCHEMA``."""
    return parse_epubs(archives(spark, path, pattern))


def spine_of(books: DataFrame) -> DataFrame:
    """``book_id, file, position``: items of the spine that the manifest names, in reading order."""
    refs = books.select(F.col("path").alias("book_id"), F.posexplode("spine").alias("position", "id"))
    items = books.select(F.col("path").alias("book_id"), F.explode("manifest").alias("m")).select("book_id", F.col("m.id").alias("id"), F.col("m.href").alias("file"))
    found = refs.join(items, ["book_id", "id"]).filter(F.length("file") > 0)
    return found.groupBy("book_id", "file").agg(F.min("position").alias("position"))


def cover_of(books: DataFrame) -> DataFrame:
    """``book_id, cover``: the item marked as cover, the one the metadata names, or an image with cover in its name."""
    first = lambda test: F.try_element_at(F.filter("manifest", test), F.lit(1))["href"]
    named = first(lambda m: F.array_contains(m["props"], "cover-image"))
    old = first(lambda m: (m["id"] == F.col("cover_id")) & (F.col("cover_id") != ""))
    image = first(lambda m: m["type"].startswith("image/") & F.lower(m["href"]).contains("cover"))
    return books.select(F.col("path").alias("book_id"), F.coalesce(named, old, image, F.lit("")).alias("cover"))


def cover_images(files: DataFrame) -> DataFrame:
    """``book_id, cover, content``: the bytes of the cover of each archive of ``path, content``; null where the archive
    does not hold it. Archives without a cover have no row."""
    covers = cover_of(parse_epubs(files)).filter("cover <> ''")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = []
            for name, data in zip(frame["cover"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
                    images.append(archive.read(name) if name in archive.namelist() else None)
            yield frame.assign(content=images)

    found = files.select(F.col("path").alias("book_id"), "content").join(covers, "book_id").select("book_id", "cover", "content")
    return found.mapInPandas(run, "book_id string, cover string, content binary")


def book_json(books: DataFrame, made: DataFrame) -> DataFrame:
    """``book_id, json``: each book with its chapters and the counts that follow from them."""
    meta = books.select(F.col("path").alias("book_id"), *META, "warnings")
    return meta.join(_gathered(made), "book_id", "left").select("book_id", _json(META, "warnings").alias("json"))


def archive_json(files: DataFrame, make: Make | None = None) -> DataFrame:
    """:func:`book_json` of archives ``path, content``: each is read once, and its metadata travel with its chapters.
    With ``make``, as in :func:`archive_chapters`."""
    made = _numbered(_found_in(files, make, meta=True), meta=True)
    return _gathered(made, F.first("meta", ignorenulls=True).alias("meta")).select("book_id", _json([f"meta.{c}" for c in META], "meta.warnings").alias("json"))


def _gathered(made: DataFrame, *more: F.Column) -> DataFrame:
    """``book_id, chapters, char_count`` of chapters; both null where a book has none."""
    chars = F.aggregate("paragraphs", F.lit(0), lambda s, p: s + F.length(p))
    chapter = F.struct("chapter_index", "title", "nav_path", "src", "paragraphs", "char_count")
    chapters_in_order = F.array_sort(F.collect_list(F.when(F.col("chapter_index").isNotNull(), chapter)))
    rows = made.withColumn("char_count", chars).groupBy("book_id").agg(chapters_in_order.alias("chapters"), F.sum("char_count").alias("char_count"), *more)
    return rows.withColumn("chapters", F.when(F.size("chapters") > 0, F.col("chapters")))


def _json(meta: Sequence[str], warnings: str) -> F.Column:
    return F.to_json(F.struct(*meta, warnings, "char_count", "chapters"))


class _Places:
    """Where the files of a book stand: positions in the spine, and the entries of each file.

    A book without a table of contents has an entry for each file of its spine, with the place of the file as number and
    without a label.
    """

    def __init__(self, book: str, manifest: list[dict], spine: list[str], toc: list[dict]) -> None:
        self.book, self.positions, hrefs = book, {}, {}
        for item in manifest:
            if item["href"]:
                hrefs.setdefault(item["id"], []).append(item["href"])
        for position, item in enumerate(spine):
            for file in hrefs.get(item, ()):
                self.positions.setdefault(file, position)
        self.entries: dict[str, list[tuple[int, list[str] | None, str]]] = {} if toc else {f: [(p, None, "")] for f, p in self.positions.items()}
        for k, entry in enumerate(toc):
            self.entries.setdefault(entry["file"], []).append((k, entry["nav_path"], entry["anchor"]))

    def rows(self, file: str, page: list[tuple[str, str]]) -> Iterator[dict]:
        """The rows of one file with its ``(anchor, text)``."""
        place = {"book_id": self.book, "meta": None, "position": self.positions.get(file, structure.UNKNOWN_POSITION), "file": file}
        if file in self.entries:
            texts: dict[str, list[str]] = {}
            for anchor, text in page:
                if text:
                    texts.setdefault(anchor, []).append(text)
            for entry, nav_path, anchor in self.entries[file]:
                if anchor in texts:
                    yield place | {"loose": False, "entry": entry, "nav_path": nav_path, "anchor": anchor, "paragraphs": texts[anchor]}
        elif file in self.positions and sum(len(text) for _, text in page) > structure.UNLISTED_LEAST:
            yield place | {"loose": True, "entry": 0, "nav_path": [], "anchor": "", "paragraphs": [text for _, text in page]}


def _batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Batches of some text each, so that a book of any length leaves the worker as it is read."""
    kept, chars = [], 0
    for row in rows:
        kept.append(row)
        chars += 100 + sum(map(len, row["paragraphs"] or ()))
        if chars > BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(kept, _FOUND)
            kept, chars = [], 0
    yield pa.RecordBatch.from_pylist(kept, _FOUND)


def _found_in(files: DataFrame, make: Make | None = None, meta: bool = False) -> DataFrame:
    """The rows of ``_FOUND`` of archives ``path, content``, each opened once and read file by file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in make(batches) if make else batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                record, archive = _opened(path.as_py(), content.as_py())
                places = _Places(record["path"], record["manifest"], record["spine"], record["toc"])
                for file, page in _pages(record, archive) if archive else ():
                    yield from places.rows(file, page)
                if meta:
                    yield dict.fromkeys(_FOUND.names) | {"book_id": record["path"], "meta": {c: record[c] for c in (*META, "warnings")}}

    return (files if make else files.select("path", "content")).mapInArrow(lambda batches: _batched(read(batches)), _FOUND_DDL)


def _numbered(found: DataFrame, meta: bool = False) -> DataFrame:
    """Chapters of the rows of ``_FOUND``: entries that name no content or have no text are dropped, as is a first
    paragraph that repeats the label. Entries follow the spine, unknown files last, then files that no entry names.
    With ``meta``, a row of metadata is kept, in a column of its own and without number."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")
    label, none = F.try_element_at("nav_path", F.lit(-1)), F.array().cast("array<string>")
    named = found.withColumn("nav_path", F.coalesce("nav_path", F.array(stem)))
    repeats = ~F.col("loose") & F.coalesce(F.lower(F.try_element_at("paragraphs", F.lit(1))) == F.lower(label), F.lit(False))
    bare = named.withColumn("paragraphs", F.when(repeats, F.slice("paragraphs", 2, F.size("paragraphs"))).otherwise(F.col("paragraphs")))
    kept = bare.filter(F.col("meta").isNotNull() | F.col("loose") | (~T.is_non_content(label, F.col("nav_path")) & (F.size("paragraphs") > 0)))
    number = F.row_number().over(structure.W.partitionBy("book_id").orderBy(F.col("meta").isNull(), "loose", "position", "entry", "file"))
    return kept.select(
        "book_id", (F.when(F.col("meta").isNull(), number - 1) if meta else number).alias("chapter_index"), F.when(F.col("loose"), stem).otherwise(T.flatten_title(F.col("nav_path"))).alias("title"),
        "nav_path", F.concat_ws("#", "file", F.nullif("anchor", F.lit(""))).alias("src"), "paragraphs",
        F.when(F.col("loose"), F.array(F.concat(F.lit("not in the table of contents: "), "file"))).otherwise(none).alias("warnings"), *(["meta"] if meta else []),
    )


def archive_chapters(files: DataFrame, make: Make | None = None) -> DataFrame:
    """:func:`chapters` of archives ``path, content``: each is read once, and no row holds the text of a whole book.

    With ``make``, ``files`` are other rows, of whose batches it makes ``path, content`` in the worker that reads them,
    so that archives do not cross to Spark and back.
    """
    return _numbered(_found_in(files, make))


def chapters(books: DataFrame) -> DataFrame:
    """``book_id, chapter_index, title, nav_path, src, paragraphs, warnings``: the chapters of all books.

    A book without a table of contents has an entry for each file of its spine. Files that no entry names are appended
    where they hold more text than a title page, with a warning.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                book = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                places = _Places(book["path"], book["manifest"], book["spine"], book["toc"])
                pages: dict[str, list[tuple[int, str, str]]] = {}
                for p in book["paragraphs"]:
                    pages.setdefault(p["file"], []).append((p["p_i"], p["text"], p["anchor"]))
                for file, page in pages.items():
                    yield from places.rows(file, [(anchor, text) for _, text, anchor in sorted(page)])

    return _numbered(books.select("path", "manifest", "spine", "toc", "paragraphs").mapInArrow(lambda batches: _batched(look_up(batches)), _FOUND_DDL))
