"""Text cut off by field limits (problem 8).

Lengths of every text are computed again under other encodings: characters, UTF-8 and UTF-16 units, entity escaping,
JSON escaping, newlines of two characters, with and without a mark of omission at the end. Grouped by source and
encoding they show the hidden limits: lengths at which far more texts stop than around them, most of them unfinished.
Then the endings are inspected: a word, sentence, quotation, entity or tag that stops in the middle. Texts without
final stops (lists, verse, scripts without stops) are judged by their last words: at a limit by whether these stand
elsewhere at the end of a line or sentence; anywhere by whether they are the beginning of known words, or stand in the
corpus often but hardly ever at an end. Everything is built from built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed
from lectern.llm.sentences import ENDING, FUNCTION_WORDS, NUMBERED, SCRIPTS, TITLES

#: A limit: at least so many texts of a source stop at the length, so many times the mean of the lengths around it,
#: and at least this share of those whose end can be judged is unfinished.
LEAST_AT_LIMIT, TIMES_AROUND, AROUND, UNFINISHED_SHARE = 4, 6.0, 25, 0.5
#: A byte limit may cut up to this many bytes early, not to divide a character.
BYTE_SLACK = 3
#: A mark of omission may follow a cut from which up to this many spaces were stripped.
OMISSION_SLACK = 3
#: How often words must stand at the end of other lines or sentences to be an ending, unless they hardly ever do.
LEAST_ENDINGS = 2

#: A last word hardly ever ends anything: it stands elsewhere at least so often, and at most this share of that at ends.
#: Words of lists stand in prose too, far from ends; for them the share is less.
LEAST_STANDING, HARDLY, HARDLY_LISTED = 40, 0.01, 0.001
#: A last word is the beginning of others: so many occurrences at least, and at most ``HARDLY_LISTED`` of that by itself.
LEAST_LONGER = 5

STOP = "[.!?…。！？।॥؟．｡]"
_CLOSERS = "\"'”’»)\\]」』）“"
_PICTURES = "\\p{So}\\p{Sk}\\x{fe0f}\\x{200d}\\x{2665}"
_SPACELESS = "[\\x{0e00}-\\x{0eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}]"
_LETTER = "\\p{L}\\p{M}\\p{N}"
_UNSPACED = "[\\x{0e00}-\\x{0eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]"
#: A sentence that ends within a line: a letter, stop and closing marks, then another letter.
_WITHIN = f"[\\p{{L}}\\p{{M}}]{STOP}[{_CLOSERS}]*(?=[^{_LETTER}\\n]{{0,4}}(<[^<>\\n]*>[^{_LETTER}\\n]{{0,4}})*\\p{{L}})"

# Endings are read from the end of the text, reversed, so that patterns are anchored at the beginning. The end is as
# much as any of them can read, whatever its length: the last words and all signs around them.
_END_WORDS = 4
_END = f"^(?:[^{_LETTER}]*+[{_LETTER}]*+){{{_END_WORDS}}}[^{_LETTER}]*+"
_ENDS = f"[{_CLOSERS}]*+\\s?{STOP}"
_OMISSION = "^(\\]?(\\.\\.\\.|…)\\[|\\.\\.\\.|…)\\s*+"
_BRACKETED = "^\\](\\.\\.\\.|…)\\["
#: A character that was divided, or an entity without its end.
_BROKEN = "^\\x{fffd}|^[A-Za-z0-9]{0,31}#?&"
#: A line that ends with a stop, closing marks and tags.
_LINE_ENDS = f"{STOP}\\s?[{_CLOSERS}]*+(?:\\s*+</?[A-Za-z][^<>]*>)*+\\s*+$"
_OPENS = "(?=$|[\\s(«“„\"])"


def _reversed_words(words: list[str]) -> str:
    return "|".join("\\s?\\.".join(part[::-1] for part in reversed(w.split("."))) for w in sorted(words))


def _abbreviated(text: Column, backward: Column) -> Column:
    """Whether the last word is an abbreviation, written as it is listed, of a language whose frequent words stand in
    the text at least a third as often as those of any other language of its script."""
    points = {code: F.regexp_count(F.lower(text), F.lit(f"(?U)\\b({'|'.join(words.split())})\\b")) for code, words in FUNCTION_WORDS.items()}
    out = backward.rlike(f"^\\.\\p{{L}}(?=$|[\\s(«“„\".])") & ~backward.rlike(f"(?iu)^\\.({_reversed_words(list(ENDING))})(?=$|\\s)")
    for code, script in SCRIPTS.items():
        listed = [w for table in (TITLES, NUMBERED) for w in table.get(code, "").split() if len(w) > 1]
        forms = [f"(?i:{_reversed_words([w for w in listed if w == w.lower()])})", *([_reversed_words([w for w in listed if w != w.lower()])] if any(w != w.lower() for w in listed) else [])]
        rivals = [points[other] for other, name in SCRIPTS.items() if name == script and other in points]
        spoken = 3 * points[code] >= F.greatest(*rivals) if code in points and len(rivals) > 1 else F.lit(True)
        # The words of the text are counted only where an abbreviation of the language stands at its end.
        out = out | F.when(backward.rlike(f"(?u)^\\.({'|'.join(forms)}){_OPENS}"), spoken).otherwise(False)
    return out


def quotation_open(text: Column) -> Column:
    """Whether the last quotation mark of a kind in the last paragraph opens a quotation that nothing closes.

    „…“ are paired before “…”, as “ closes the one and opens the other. A quotation that goes on in another paragraph
    has its mark there again, so earlier paragraphs open nothing. But for „ these are searches for bytes.
    """
    last = F.substring_index(F.rtrim(text, F.lit(" \t\r\n")), "\n\n", -1)
    open_ = lambda opening, closing: F.contains(F.substring_index(last, closing, -1), F.lit(opening))
    marks = F.regexp_replace(F.regexp_replace(last, "[^“”„]++", ""), "„[^“”„]*+[“”]", "")
    low = F.when(F.contains(last, F.lit("„")), marks.rlike("[“„]$")).otherwise(open_("“", "”"))
    return open_("«", "»") | open_("「", "」") | open_("『", "』") | low


def tag_open(text: Column) -> Column:
    """Whether the last ``<`` of a text begins a tag that has no end."""
    after = F.substring_index(text, "<", -1)
    return F.when(F.contains(text, F.lit("<")), ~F.contains(after, F.lit(">")) & after.rlike("^(/?[A-Za-z]|/?$)")).otherwise(False)


def unfinished(text: Column, backward: Column | None = None, opened: Column | None = None) -> Column:
    """Whether a text without outer space stops inside a word, sentence or quotation. ``backward`` is its reverse."""
    backward = F.reverse(text) if backward is None else backward
    opened = quotation_open(text) if opened is None else opened
    ended = backward.rlike(f"^{_ENDS}")
    return (~ended & ~backward.rlike(f"^[{_PICTURES}]")) | opened | F.when(ended & backward.startswith("."), _abbreviated(text, backward)).otherwise(False)


#: The encodings, in the order of the lengths.
ENCODINGS = ("chars", "utf8", "utf8_undamaged", "utf16", "html", "html_text", "html_utf8", "json", "json_ascii", "crlf", "crlf_utf8")


def _count(text: Column, char: str) -> Column:
    """How often a character of one byte stands in the text; the search is for bytes, much faster than a pattern."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def lengths(text: Column) -> Column:
    """The length of a text under each of the ``ENCODINGS``."""
    chars, octets = F.length(text), F.octet_length(text)
    breaks = _count(text, "\n") - F.octet_length(text) + F.octet_length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    amp, angle, quote, single = _count(text, "&"), _count(text, "<") + _count(text, ">"), _count(text, '"'), _count(text, "'")
    utf16 = F.octet_length(F.encode(text, "UTF-16LE")) / 2
    escaped = chars + quote + _count(text, "\\") + _count(text, "\n") + _count(text, "\r") + _count(text, "\t")
    wide = F.when(octets == chars, 0).otherwise(chars - F.length(F.regexp_replace(text, "[^\\x00-\\x7f]++", "")))
    damaged = F.when(F.endswith(text, F.lit("\ufffd")), 3 * F.length(F.regexp_extract(F.reverse(text), "^\\x{fffd}*+", 0))).otherwise(0)
    parts = (chars, octets, octets - damaged, utf16, chars + 4 * amp + 3 * angle + 5 * quote + 4 * single, chars + 4 * amp + 3 * angle, octets + 4 * amp + 3 * angle + 5 * quote + 4 * single, escaped, escaped + 5 * wide + 6 * (utf16 - chars), chars + breaks, octets + breaks)
    return F.array(*(p.cast("int") for p in parts))


def _tail(segment: Column) -> Column:
    """The last word of a line, or its last characters in scripts without spaces."""
    last = F.element_at(F.split(F.rtrim(segment), "\\s+"), -1)
    return F.when(last.rlike(_UNSPACED), F.substring(last, -5, 5)).otherwise(last)


def _unit(backward: Column) -> Column:
    """The last word in lower case without what follows it, or its last characters in scripts without spaces; of a
    reversed text."""
    last = F.lower(F.reverse(F.regexp_extract(backward, f"^[^{_LETTER}]*+([{_LETTER}]++)", 1)))
    return F.when(last.rlike(f"{_UNSPACED}$"), F.substring(last, -5, 5)).otherwise(last)


def inspected(documents: DataFrame) -> DataFrame:
    """``doc_id, source`` and what the whole text tells by itself; null and empty texts are left out. No text is kept."""
    text = F.col("text")
    base = documents.filter(F.length(text) > 0).select("doc_id", "source", text, F.reverse(text).alias("whole"))
    base = base.select("*", F.regexp_extract("whole", _END, 0).alias("end"), quotation_open(text).alias("opened"))
    base = base.withColumn("trimmed", F.regexp_replace("end", "^\\s++", "")).withColumn("core", F.regexp_replace("trimmed", _OMISSION, ""))
    base = base.withColumn("lines", F.when(F.contains(text, F.lit("\n")), F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)))
    lines = F.col("lines")
    inner = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    few = (F.size(lines) >= 3) & (F.size(F.filter(inner, lambda x: x.rlike(_LINE_ENDS))) * 5 <= F.size(inner))
    # Prose with hard line breaks has its sentences end within the lines.
    listed = F.when(few, F.regexp_count(text, F.lit(_WITHIN)) * 5 <= F.size(lines)).otherwise(False)
    spaceless = F.col("core").rlike(f"^{_SPACELESS}")
    segments = F.when(spaceless, F.filter(F.split(text, "\\s+"), lambda x: F.length(x) > 0))
    whole = unfinished(text, F.col("trimmed"), F.col("opened"))
    return base.select(
        "doc_id",
        "source",
        lengths(text).alias("lengths"),
        listed.alias("listed"),
        spaceless.alias("spaceless"),
        (F.col("trimmed") != F.col("core")).alias("omission"),
        F.col("trimmed").rlike(_BRACKETED).alias("bracketed"),
        (F.col("end").rlike(_BROKEN) | tag_open(text)).alias("broken"),
        whole.alias("open"),
        F.when(F.col("trimmed") == F.col("core"), whole).otherwise(unfinished(text, F.col("core"), F.col("opened"))).alias("open_core"),
        _tail(F.reverse(F.regexp_extract("core", "^(\\S*+)", 1))).alias("tail"),
        _unit(F.col("core")).alias("unit"),
        F.col("core").rlike(f"^[{_LETTER}]").alias("lettered"),
        F.when(listed, F.transform(inner, _tail)).when(spaceless, F.transform(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), _tail)).alias("endings"),
    )


def limits(features: DataFrame) -> DataFrame:
    """``source, encoding, length, n_at, n_unfinished, marked``: the hidden limits of each source.

    ``marked``: whether most texts at the limit end with a mark of omission.
    """
    judged = ~F.col("listed") & ~F.col("spaceless")
    stop = F.when(judged & (F.col("open") | F.col("broken") | (F.col("omission") & F.col("open_core"))), 1).otherwise(0)
    each = features.select("source", F.when(judged, 1).otherwise(0).alias("judged"), stop.alias("stop"), F.col("omission").cast("int").alias("omission"), F.posexplode("lengths").alias("encoding", "length"))
    counts = each.groupBy("source", "encoding", "length").agg(F.count(F.lit(1)).alias("n_at"), F.sum("judged").alias("n_judged"), F.sum("stop").alias("n_unfinished"), F.sum("omission").alias("n_omitted"))
    near = W.partitionBy("source", "encoding").orderBy("length").rangeBetween(-AROUND, AROUND)
    around = (F.sum("n_at").over(near) - F.col("n_at")) / (2 * AROUND)
    found = counts.withColumn("around", around).filter((F.col("n_at") >= LEAST_AT_LIMIT) & (F.col("n_at") >= TIMES_AROUND * F.col("around")) & (F.col("n_judged") > 0) & (F.col("n_unfinished") >= UNFINISHED_SHARE * F.col("n_judged")) & (F.col("n_unfinished") >= LEAST_AT_LIMIT - 1))
    return found.select("source", "encoding", "length", "n_at", "n_unfinished", (F.col("n_omitted") * 2 >= F.col("n_at")).alias("marked"))


def standing(documents: DataFrame, features: DataFrame) -> DataFrame:
    """``unit, at_end, inside, longer``: where the last words of the unjudged texts stand in all documents.

    ``longer`` counts the words that begin with the unit. Words are counted first; only what differs is taken apart.
    """
    finals = features.filter((F.col("listed") | F.col("spaceless")) & (F.col("unit") != "")).groupBy("unit").agg(F.count(F.lit(1)).alias("finals"))
    tokens = documents.filter(F.length("text") > 0).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{_LETTER}]++{STOP}?"), F.lit(0))).alias("token")).groupBy("token").count()
    word, size = F.col("word"), F.length("word")
    words = tokens.select(F.regexp_replace("token", f"{STOP}$", "").alias("word"), F.col("token").rlike(f"{STOP}$").alias("stopped"), F.col("count").alias("n"))
    none = F.lit(0).cast("long")

    def place(unit: Column, at_end: Column, longer: Column) -> Column:
        return F.struct(unit.alias("unit"), F.when(at_end, F.col("n")).otherwise(none).alias("at_end"), F.when(~at_end & ~longer, F.col("n")).otherwise(none).alias("inside"), F.when(longer, F.col("n")).otherwise(none).alias("longer"))

    ended = F.col("stopped") | word.rlike(f"{_SPACELESS}$")
    whole = F.array(place(word, ended, F.lit(False)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - 4, F.lit(1))), lambda k: place(F.substring(word, k, F.lit(5)), ended & (k >= size - 4), F.lit(False)))
    begins = F.transform(F.sequence(F.lit(2), F.greatest(F.least(size - 1, F.lit(40)), F.lit(2))), lambda k: place(F.substring(word, F.lit(1), k), F.lit(False), F.lit(True)))
    places = words.select(F.explode(F.when(word.rlike(f"{_UNSPACED}$"), grams).when(size > 2, F.concat(whole, begins)).otherwise(whole)).alias("p")).select("p.*")
    line_ends = features.filter(~F.col("spaceless")).select(F.explode("endings").alias("tail")).select(_unit(F.reverse("tail")).alias("unit"), F.lit(1).cast("long").alias("at_end"), none.alias("inside"), none.alias("longer"))
    sums = [F.sum(c).alias(c) for c in ("at_end", "inside", "longer")]
    found = places.unionByName(line_ends).join(finals.select("unit"), "unit", "left_semi").groupBy("unit").agg(*sums)
    # The last words of the texts themselves are no evidence for themselves.
    return found.join(finals, "unit").select("unit", F.when(F.col("unit").rlike(f"{_SPACELESS}$"), F.greatest(F.col("at_end") - F.col("finals"), none)).otherwise(F.col("at_end")).alias("at_end"), (F.col("inside") - F.col("finals")).alias("inside"), "longer")


def truncated_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, source, at_limit, step, cut``: for every document with a text, whether it was cut and what showed it.

    ``step`` is ``limit`` where the length is a hidden limit of the source and the ending confirms it, ``ending`` where
    the text stops elsewhere in the middle, as a broken transfer leaves it, and null where it is whole. A null source is a source of its own; it has limits like others. A text cut exactly where a sentence, line or, in
    a script without stops, a known last word ends counts as whole. Off limits, a list or a text without stops is
    cut where its last word is the beginning of others or hardly ever ends anything. An empty table gives no rows.
    """
    features = checkpointed(inspected(documents).withColumn("source_key", F.coalesce("source", F.lit("\0"))))
    found = limits(features.withColumn("source", F.col("source_key"))).select(F.col("source").alias("source_key"), F.struct("encoding", "length", "marked").alias("l"))
    # A few limits for each source.
    per_source = found.groupBy("source_key").agg(F.collect_set("l").alias("limits"))
    endings = features.select(F.explode("endings").alias("tail")).groupBy("tail").count().filter(F.col("count") >= LEAST_ENDINGS).select("tail", F.lit(True).alias("known"))
    octets = [k for k, name in enumerate(ENCODINGS) if "utf8" in name]

    def near(limit: Column) -> Column:
        early = F.when(limit["encoding"].isin(octets), BYTE_SLACK).otherwise(0) + F.when(limit["marked"] & F.col("omission"), OMISSION_SLACK).otherwise(0)
        return F.get("lengths", limit["encoding"]).between(limit["length"] - early, limit["length"])

    stands = standing(documents, features).withColumn("rare", F.coalesce((F.col("inside") >= LEAST_STANDING) & (F.col("at_end") <= F.when(F.col("unit").rlike(f"{_SPACELESS}$"), HARDLY).otherwise(HARDLY_LISTED) * F.col("inside")), F.lit(False)))
    begun = (F.col("longer") >= LEAST_LONGER) & (F.greatest(F.col("inside"), F.lit(0)) + F.col("at_end") <= HARDLY_LISTED * F.col("longer")) & ~F.col("unit").rlike(f"{_UNSPACED}$")
    stands = stands.select("unit", "rare", begun.alias("begun"))
    joined = features.drop("endings").join(per_source, "source_key", "left").join(endings, "tail", "left").join(stands, "unit", "left")
    joined = joined.withColumn("at_limit", F.coalesce(F.exists("limits", near), F.lit(False))).withColumn("at_mark", F.coalesce(F.exists("limits", lambda l: near(l) & l["marked"]), F.lit(False)))
    unknown, unjudged = F.col("known").isNull() | F.coalesce("rare", F.lit(False)), F.col("listed") | F.col("spaceless")
    # First the texts at a limit of their source, confirmed by their ending: one that can be judged, or a last word.
    divided = F.col("broken") | F.col("bracketed")
    marked = F.col("at_mark") & F.col("omission") & F.when(unjudged, unknown).otherwise(F.col("open_core"))
    at_limit = F.col("at_limit") & (divided | marked | F.when(unjudged, unknown).otherwise(F.col("open")))
    # Then the texts cut in transfer, at no length that others share: only the ending tells.
    stopped = F.when(unjudged, F.col("lettered") & F.coalesce(F.col("rare") | F.col("begun"), F.lit(False))).otherwise(F.col("open"))
    step = F.when(at_limit, "limit").when(divided | stopped, "ending")
    return joined.select("doc_id", "source", "at_limit", step.alias("step"), step.isNotNull().alias("cut"))


def truncation_by_source(found: DataFrame) -> DataFrame:
    """``source, n_docs, n_cut, n_at_limit, share``: how often each source truncates, and how often at a limit of its own."""
    counts = found.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("step") == "limit").alias("n_at_limit"))
    return counts.withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))
