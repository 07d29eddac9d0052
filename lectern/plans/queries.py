"""The registered queries of the core: every operator over whole tables of the corpus."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import arrays as A
from lectern.functions import compare as C
from lectern.functions import narration as N
from lectern.functions import stress as S
from lectern.functions import text as T
from lectern.functions import unicode as U
from lectern.operators import contracts
from lectern.operators import reports as R
from lectern.operators import structure as G
from lectern.operators import verify as V
from lectern.plans import literals, sources
from lectern.session import spread
from lectern.sources import files
from lectern.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chapters").select("chapter_id", "book_id", F.posexplode("paragraphs").alias("p_i", "text"))


def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").withColumn("chapter", F.concat_ws("/", "book_id", "chapter_index"))


def heard(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Each check once, with the text of its chunk; a check that came twice keeps its later row."""
    latest = F.max_by(F.struct("chunk_id", "attempt", "ok", "cer", "transcript"), "loaded_at").alias("c")
    checks = read(spark, sf_dir, "checks").groupBy("check_id").agg(latest).select("check_id", "c.*")
    chunks = read(spark, sf_dir, "chunks").select("chunk_id", "text", *columns)
    return checks.join(chunks, "chunk_id").withColumnRenamed("transcript", "heard")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`heard` with the language whose rules apply."""
    return heard(spark, sf_dir).withColumn("lang", F.when(F.col("text").rlike("[а-я]"), "ru").otherwise("en"))


def vectors(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("audio"))
    if not bad:
        return rows
    wrong = lambda x, k: F.when((F.col("vec_id") + k) % 17 == 0, F.lit(float("nan"))).when((F.col("vec_id") + k) % 29 == 0, F.lit(float("inf"))).otherwise(x)
    return rows.withColumn("audio", F.transform("audio", wrong))


# Cleaning, titles, scripts.


@query
def inspect_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.inspect_by(read(spark, sf_dir, "documents"), ["lang"])


@query
def inspect_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs(spark, sf_dir).groupBy("book_id").agg(F.count_distinct("chapter_id").alias("chapters"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))
    return found.withColumn("hours", F.round(F.col("chars") / G.CHARS_PER_HOUR, 6))


@query
def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("chapter_id", "p_i", T.clean_inline(U.normalized(F.col("text"), "NFC")).alias("clean"))


@query
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, path = F.col("title"), F.col("nav_path")
    return read(spark, sf_dir, "chapters").select("chapter_id", T.clean_title(title).alias("clean"), T.flatten_title(path).alias("flat"), T.is_non_content(title, path).alias("non_content"))


@query
def unlisted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents none of whose texts belongs to a book; a document without a book is listed nowhere."""
    documents = read(spark, sf_dir, "documents").withColumn("file", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), "kind"))
    return G.unlisted_text(documents, documents.filter("book_id is not null and kind <> 'verse'"), "file")


@query
def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = read(spark, sf_dir, "chapters")
    toc = chapters.select("book_id", F.col("chapter_id").alias("entry"), "nav_path", F.col("src").alias("file"), F.lit("").alias("anchor"))
    spine = chapters.groupBy("book_id", F.col("src").alias("file")).agg(F.min("chapter_index").alias("position"))
    first = chapters.groupBy("book_id", F.col("src").alias("file")).agg(F.min_by("paragraphs", "chapter_id").alias("p"))
    texts = first.select("book_id", "file", F.lit("").alias("anchor"), F.posexplode("p").alias("p_i", "text"))
    return G.chapters_of(toc, spine, texts).select("book_id", "chapter_index", "title", "src", F.size("paragraphs").alias("n_paragraphs"))


@query
def chapter_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat_ws(",", F.col("book_id") % 3 + 1, F.concat_ws("-", F.col("book_id") % 5 + 1, F.col("book_id") % 5 + 3))
    return read(spark, sf_dir, "books").select("book_id", F.array_join(T.chapter_numbers(spec, F.lit(6)), ",").alias("chapters"))


@query
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(U.normalized(F.concat_ws(" / ", "p_name", "p_type"), "NFKD")).alias("slug"))


@query
def latin_share_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = read(spark, sf_dir, "chunks").filter("text is not null").select(T.latin_share(F.col("text")).alias("share"))
    rows = shares.select(F.floor(F.col("share") * 10).cast("long").alias("band"), (F.col("share") >= T.ENGLISH_SHARE).alias("english"))
    return rows.groupBy("band", "english").agg(F.count(F.lit(1)).alias("n"))


@query
def romanized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").select("chunk_id", T.romanize(F.col("text")).alias("latin"))


@query
def matched_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "books").select("book_id", T.match_case(F.col("title"), F.lower("author")).alias("author"))


@query
def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions import latin

    @F.pandas_udf("text string, pairs array<struct<src:string,dst:string>>")
    def convert(texts: pd.Series) -> pd.DataFrame:
        found = [latin.transliterate(t or "") for t in texts]
        return pd.DataFrame({"text": [t for t, _ in found], "pairs": [[{"src": a, "dst": b} for a, b in p] for _, p in found]})

    mixed = read(spark, sf_dir, "chunks").filter(F.col("text").rlike("[A-Za-z]") & F.col("text").rlike("[А-Яа-я]"))
    return mixed.select("chunk_id", convert("text").alias("c")).select("chunk_id", F.col("c.text").alias("text"), F.size("c.pairs").alias("n"))


# Numbers and words.


@query
def plural_ru(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").groupBy(number.alias("n"), T.plural_ru(number, "год", "года", "лет").alias("form")).agg(F.count(F.lit(1)).alias("rows"))


@query
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 3999 + 1
    digits = {1000: " M MM MMM", 100: " C CC CCC CD D DC DCC DCCC CM", 10: " X XX XXX XL L LX LXX LXXX XC", 1: " I II III IV V VI VII VIII IX"}
    parts = [F.element_at(F.array(*map(F.lit, names.split(" "))), (F.floor(n / unit) % 10 + 1).cast("int")) for unit, names in digits.items()]
    return read(spark, sf_dir, "orders").select("o_orderkey", T.roman_to_int(F.concat(*parts)).cast("long").alias("value"))


@query
def spelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.spell_letters(F.col("s_name"), "en").alias("spelled"))


@query
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, text = F.lower("lang"), F.col("text")
    rows = read(spark, sf_dir, "documents").filter(lang.isin("en", "ru") & text.isNotNull())
    full = F.when(lang == "ru", T.expand_abbreviations(text, N.ABBREVIATIONS["ru"], True)).otherwise(T.expand_abbreviations(text, N.ABBREVIATIONS["en"], False))
    return rows.select("doc_id", lang.alias("lang"), full.alias("text"))


@query
def expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.expansion_counts(spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "doc_id").groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


# Segmentation.


@query
def sentences_crude(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.sentences_crude(T.clean_inline(F.col("text")))
    rows = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", parts.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunk_documents(spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "doc_id")


@query
def edit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.batches(chapter_chunks(spark, sf_dir), "chapter", "chunk_id")
    return rows.groupBy("chapter", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))


@query
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.passage(chapter_chunks(spark, sf_dir).filter("text is not null"), "chapter", "chunk_id", 30.0).select("chapter", "chunk_id")


@query
def budget_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = N.byte_budget("Проба голоса для записи.", 5.0)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: N.split_to_budget(t, budget))

    return read(spark, sf_dir, "chunks").filter("text <> ''").filter(F.octet_length("text") > budget).select("chunk_id", F.posexplode(pieces("text")).alias("piece_i", "piece"))


# Stress marks.


@query
def acute_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.regexp_replace("text", "([аеёиоуыэюя])", r"+$1")
    acute = T.to_acute(marked)
    return read(spark, sf_dir, "chunks").filter("text is not null").select("chunk_id", acute.alias("acute"), T.acute_to_plus(acute).alias("plus"))


@query
def sparse_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    consonants = "бвгджзйклмнпрстфхцчшщъь"
    # A mark before the first vowel of a word, as a tagger would set one.
    marked = F.regexp_replace("text", f"(^|[^\\p{{L}}\\p{{N}}_])([{consonants}{consonants.upper()}]*)([аеиоуыэюя])", "$1$2+$3")
    return read(spark, sf_dir, "chunks").filter("text is not null").select("chunk_id", T.to_acute_sparse(marked).alias("text"), T.dash_to_ellipsis(F.col("text")).alias("paused"), F.size(F.map_keys(S.positions(marked))).alias("words"))


@query
def repaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: S.tidy(S.override_phrases(S.override_words(t))))

    russian = read(spark, sf_dir, "chunks").filter(F.col("text").rlike("[а-я]"))
    marked = F.regexp_replace("text", "([аеёиоуыэюя])", r"+$1")
    return russian.select("chunk_id", repaired(marked).alias("text"))


# Comparison and verification.


@query
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "chunks").select(F.explode(F.split(C.canon_simple(F.col("text")), " ")).alias("word")).filter("word <> ''")
    return words.groupBy(C.stem_column(F.col("word")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("forms"))


@query
def close_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that follow each other in a chunk, of any script, and whether they are close."""
    rows = read(spark, sf_dir, "chunks").select(F.filter(F.split(C.canon_simple(F.col("text")), " "), lambda w: w != "").alias("w"))
    pairs = rows.select(F.explode(F.zip_with("w", F.slice("w", 2, 1 << 20), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("p.*").filter("a is not null and b is not null").distinct()
    return pairs.select("a", "b", C.close_column(F.col("a"), F.col("b")).alias("close"))


@query
def cer_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cer_simple(heard(spark, sf_dir).drop("cer")).select("check_id", F.round("cer", 6).alias("cer"))


@query
def missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.missing_words(heard(spark, sf_dir)).select("check_id", F.array_join("missing", " ").alias("missing"))


@query
def cer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cer(spoken(spark, sf_dir).drop("cer")).select("check_id", F.round("cer", 6).alias("cer"))


@query
def missing_words_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lost_words(spoken(spark, sf_dir)).select("check_id", F.array_join("numbers", " ").alias("numbers"), F.array_join("words", " ").alias("words"))


@query
def word_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.size(F.filter(F.split(C.canon_simple(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))
    rows = heard(spark, sf_dir).select("check_id", count(F.col("text")).alias("written"), count(F.col("heard")).alias("said"), "cer")
    return rows.select("check_id", "written", "said", F.coalesce(C.word_deficit(F.col("written"), F.col("said"), F.col("cer")), F.lit(False)).alias("deficit"))


@query
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verdicts(spoken(spark, sf_dir).select("check_id", "text", "heard", "lang")).select("check_id", "ok", F.round("cer", 6).alias("cer"), F.size("reasons").alias("n_reasons"))


@query
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.classify_attempts(heard(spark, sf_dir))


@query
def kept_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kept_attempt(heard(spark, sf_dir))


@query
def rate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapter_chunks(spark, sf_dir).filter("text is not null").select("chapter", "chunk_id", F.length("text").alias("chars"), ((F.col("chunk_id") % 97 + 40) / 16.0).alias("seconds"))
    return V.rate_calibration(rows, "chapter", ["chunk_id"]).select("chunk_id", F.round("rate", 6).alias("rate"))


# Arrays.


@query
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = F.col("audio")
    return vectors(spark, sf_dir).select("vec_id", F.round(A.peak(audio), 6).alias("peak"), F.round(A.rms(audio), 6).alias("rms"), F.round(A.rms_dbfs(audio), 4).alias("dbfs"), F.round(A.level_gain(audio), 4).alias("gain"))


@query
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors(spark, sf_dir).select("vec_id", A.normalised(F.col("audio")).alias("n"))
    figures = [F.round(F.col(f"n.{c}"), 4).alias(c) for c in ("rms_before", "gain", "rms_after", "peak_after", "noise_floor")]
    return found.select("vec_id", *figures, F.round(A.peak(F.col("n.audio")), 6).alias("peak"))


@query
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors joined into arrays of ten, each with a pause of its own."""
    pieces = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).cast("long").alias("part"), "vec_id", F.when(F.col("vec_id") % 7 != 3, F.col("audio")).alias("audio"), (F.col("vec_id") % 5 * 10).cast("int").alias("pause_ms"))
    found = contracts.assemble(pieces, "part", "vec_id", 1000)
    return found.select("part", F.round("seconds", 6).alias("seconds"), "clamped", F.round("rms_after", 4).alias("rms_after"), F.round("gain", 4).alias("gain"))


@query
def phoneme_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").filter("text is not null").select("chunk_id", F.array_join(contracts.phoneme_tokens("text"), " ").alias("tokens"))


@query
def usable_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = (F.col("vec_id") % 30 + 1).cast("int")
    return vectors(spark, sf_dir, True).select("vec_id", A.usable(F.col("audio"), rate).alias("usable"), A.usable(A.sanitise(F.col("audio"))["audio"], rate).alias("clean"))


@query
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = A.sanitise(F.col("audio"))
    return vectors(spark, sf_dir, True).select("vec_id", clean["bad"].cast("long").alias("bad"), F.round(A.peak(clean["audio"]), 6).alias("peak"))


@query
def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = F.transform("audio", lambda x: x * 4)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    return vectors(spark, sf_dir).select("vec_id", total(A.soft_limit(loud)).alias("soft"), total(A.headroom(loud)).alias("scaled"), F.size(A.silence(F.lit(40), F.lit(1000))).cast("long").alias("silence"))


@query
def signal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.repeat(F.lit("слово "), (F.col("vec_id") % 20 + 1).cast("int"))
    return vectors(spark, sf_dir).select("vec_id", F.size(A.signal_reasons(F.transform("audio", lambda x: x * (F.col("vec_id") % 5)), F.lit(16), text)).cast("long").alias("n"))


@query
def duration_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("chunk_id") % 40) / 4
    rows = read(spark, sf_dir, "chunks").filter("text is not null")
    return rows.select("chunk_id", A.duration_fits(F.col("text"), seconds).alias("fits"), F.round(A.rtf(seconds, F.lit(0.5)), 6).alias("rtf"))


@query
def array_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("loop boolean, gap double, quiet double, tone double, kept int, clamped int, resampled int")
    def scan(audio: pd.Series) -> pd.DataFrame:
        rows = []
        for x in audio:
            x = np.array(x)
            long = np.tile(x, 8)
            rows.append((A.tail_loop(long, 64), A.longest_gap(x, 100), A.silence_fraction(x, 100), A.tonality(long, 64), len(A.trim_silence(x, 1000)), A.clamp_silence(x, 100, 20)[1], len(A.resample(x, 16, 12))))
        return pd.DataFrame(rows, columns=["loop", "gap", "quiet", "tone", "kept", "clamped", "resampled"])

    return vectors(spark, sf_dir).select("vec_id", scan("audio").alias("s")).select("vec_id", "s.*")


@query
def longest_quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.longest_runs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50)


# Edits, tags, keys.


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up edit of every chunk, of one of four kinds."""
    kinds = F.when(F.col("chunk_id") % 4 == 0, F.replace("text", F.lit("."), F.lit(" !"))).when(F.col("chunk_id") % 4 == 1, F.concat("text", F.lit(" x"))).when(F.col("chunk_id") % 4 == 2, F.lit("")).otherwise(F.col("text"))
    pause = F.when(F.col("chunk_id") % 3 == 0, "long").when(F.col("chunk_id") % 3 == 1, "short")
    return read(spark, sf_dir, "chunks").select("chunk_id", F.col("chunk_id").alias("edit_i"), kinds.alias("text"), pause.alias("pause"))


@query
def applied_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.apply_edits(read(spark, sf_dir, "chunks").select("chunk_id", "text", "pause_ms"), edits(spark, sf_dir), ["chunk_id"])


@query
def judged_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.judge_edits(read(spark, sf_dir, "chunks"), edits(spark, sf_dir), ["chunk_id"]).select("chunk_id", "outcome")


@query
def delivery_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "chunks").filter("text is not null").select("chunk_id", T.delivery_tags(F.col("text")).alias("tags"))
    return tags.groupBy("tags").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))


@query
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ordered_digest(chapter_chunks(spark, sf_dir), "chapter", "chunk_id")


@query
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").filter("text is not null").select("chunk_id", T.chunk_key(F.lit("voice=a"), F.col("text")).alias("key"))


@query
def default_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "books").select("book_id", T.default_backend(F.col("language")).alias("backend"))


# Reports.


def bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heard(spark, sf_dir, ("lang",))
    return rows.select("check_id", "attempt", "ok", "cer", T.default_backend(F.col("lang")).alias("backend"), ((F.col("check_id") % 8) / 16).alias("rtf"), ((F.col("check_id") % 5 + 7) / 8).alias("peak"))


@query
def backend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.backend_summary(bakeoff(spark, sf_dir), 10.0)


@query
def backend_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bakeoff(spark, sf_dir).withColumn("status", R.cell_status(F.coalesce("ok", F.lit(False)), F.col("cer")))
    return R.pivot_first(rows, "attempt", "backend", ["silero", "kokoro", "chatterbox"], "status", "check_id")


@query
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_appearance(read(spark, sf_dir, "documents"), "source", "doc_id")


@query
def strided_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(seconds).alias("begin"), F.max(seconds).alias("end"))
    return R.strided_windows(spans, "user_id", "begin", "end", 60, 86_400, 3600, 30)


@query
def band_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.band_filter(read(spark, sf_dir, "events"), {"value": (10.0, 90.0), "user_id": (2, None)})
    return R.top_rows(rows, [F.desc("value"), "event_id"], 25).select("event_id", "user_id", "value")


@query
def best_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = read(spark, sf_dir, "documents").filter(F.length(text) > 0).select("doc_id", (F.regexp_count(text, F.lit(",")) / F.length(text)).alias("quiet"), F.size(F.split(text, " ")).alias("words"), R.complete_sentence(text).alias("complete"))
    return R.best_voices(rows, 20, ["quiet", "doc_id"], [F.desc("complete"), "quiet", F.desc("words"), "doc_id"])


@query
def nonfinite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = vectors(spark, sf_dir, True).select(F.col("vec_id").alias("file"), F.posexplode("audio").alias("position", "sample"))
    return R.nonfinite_scan(samples, 16)


@query
def bitrate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = paragraphs(spark, sf_dir).groupBy("book_id").agg(F.sum(F.length("text")).alias("chars"))
    books = read(spark, sf_dir, "books").join(hours, "book_id")
    cover = F.coalesce(F.length("cover_path") > 0, F.lit(False))
    return books.select("book_id", R.bitrate(F.lit(8.0), F.col("chars") / 16, cover).cast("long").alias("kbps"))


@query
def chapter_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.aggregate("paragraphs", F.lit(0), lambda s, p: s + F.coalesce(F.length(p), F.lit(0))) / 16
    rows = read(spark, sf_dir, "chapters").filter("paragraphs is not null").select("book_id", "chapter_id", seconds.alias("seconds"))
    return R.chapter_markers(rows, "book_id", "chapter_id").select("chapter_id", "start_ms", "end_ms")


@query
def chapter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.size("paragraphs") / 4
    rows = read(spark, sf_dir, "chapters").filter("paragraphs is not null").select("book_id", "chapter_id", "title", seconds.alias("seconds"))
    return files.chapter_metadata(R.chapter_markers(rows, "book_id", "chapter_id"), "book_id", "chapter_id")


@query
def missing_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a check that passed."""
    chunks, checks = read(spark, sf_dir, "chunks").select("chunk_id", "book_id"), read(spark, sf_dir, "checks").filter("ok")
    return R.missing_rows(chunks, checks, ["chunk_id"])


@query
def chapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the samples of a vector for each chunk that has the number of one."""
    audio = F.col("audio")
    levels = vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), F.size(audio).alias("samples"), F.aggregate(audio, F.lit(0.0), lambda s, x: s + x * x).alias("squares"), A.peak(audio).alias("peak"))
    found = R.chapter_report(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "checks"), levels)
    return found.withColumn("rms", F.round("rms", 5)).withColumn("peak", F.round("peak", 5))


@query
def container_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.col("book_id")
    probe = F.struct(
        F.when(book % 3 == 0, "2").alias("media_type"),
        F.col("title"),
        (book % 4).cast("int").alias("chapters"),
        F.when(book % 5 == 0, F.array().cast("array<string>")).when(book % 5 == 1, F.array(F.lit("mp3"))).otherwise(F.array(F.lit("aac"))).alias("audio_codecs"),
        (F.coalesce(F.length("cover_path"), F.lit(0)) > 0).alias("has_video"),
    )
    return read(spark, sf_dir, "books").select("book_id", F.array_join(R.container_problems(probe), "; ").alias("problems"))


@query
def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.train_val_split(read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang"), "doc_id", 100, 7)


@query
def corpus_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.length("text") / 16
    keep = seconds.between(1, 20)
    found = read(spark, sf_dir, "chunks").filter("text is not null").groupBy("book_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"), F.round(F.sum(F.when(keep, seconds)) / 3600, 6).alias("hours"))
    return found


@query
def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return files.kept_ordinals(lines, "line").select("file", F.col("ordinal").cast("long").alias("ordinal"), F.length("text").cast("long").alias("chars"))


@query
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windowed_counts(read(spark, sf_dir, "events"))


# Sources, and rules over literal texts.

QUERIES |= sources.QUERIES | literals.QUERIES
