"""Text functions as columns: cleaning, titles, scripts, stress marks, tags and keys.

All are compositions of built-in expressions, so they stay in generated code. Null in gives null out unless a
docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACUTE = "\u0301"

# Titles of parts that are not narrated.
NON_CONTENT_TITLES = (
    "содержание", "оглавление", "contents", "table of contents", "toc", "cover", "обложка", "colophon",
    "выходные данные", "об авторе", "about the author", "copyright", "авторские права", "annotation", "аннотация",
)
UNTITLED = "Без названия"

# Cyrillic letters in Latin.
ROMANIZE = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# Names of letters as they are spelled out.
LETTER_NAMES_RU = {
    "а": "а", "б": "бэ", "в": "вэ", "г": "гэ", "д": "дэ", "е": "е", "ж": "жэ", "з": "зэ", "и": "и", "к": "ка",
    "л": "эль", "м": "эм", "н": "эн", "о": "о", "п": "пэ", "р": "эр", "с": "эс", "т": "тэ", "у": "у", "ф": "эф",
    "х": "ха", "ц": "цэ", "ч": "че", "ш": "ша", "щ": "ща", "э": "э", "ю": "ю", "я": "я",
}

# Words without a stress of their own.
CLITICS = (
    "а и но да же ли бы б не ни то на за по до от из у о об во со ко как что чем уж ведь вот хоть лишь аж "
    "их его ее её мне мной нас вас им ей ему"
).split()

# Delivery tags by what stands in a sentence; the first that fits is taken.
BASELINE_TAG = "<|prosody:expressive_high|>"
TAG_RULES = (
    (r"[!?]{2,}", "<|emotion:anger|>"),
    (r"(?m)^\s*[—–-].*!", "<|emotion:enthusiasm|>"),
    (r"!", "<|emotion:determination|>"),
    (r"\?.*\?", "<|emotion:amusement|>"),
    (r"\?", "<|emotion:confusion|>"),
    (r"(?m)^\s*[—–-]\s", "<|emotion:amusement|>"),
    (r'[«»"]', "<|emotion:contemplation|>"),
)

# Voices by language.
BACKENDS = {"ru": "silero", "uk": "silero", "be": "silero"} | dict.fromkeys(("en", "es", "fr", "it", "pt", "hi", "ja", "zh"), "kokoro")
DEFAULT_BACKEND = "chatterbox"


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def clean_inline(text: Column) -> Column:
    """One line without soft hyphens, footnote marks and runs of spaces; the text is taken to be NFC already."""
    bare = F.regexp_replace(F.regexp_replace(text, "­", ""), r"\[\s*\d{1,3}\s*\]", "")
    return F.trim(F.regexp_replace(F.translate(bare, "\n", " "), "[ \t   ]+", " "))


def clean_title(text: Column) -> Column:
    """A cleaned line without dots, dashes and spaces at its ends."""
    return F.regexp_replace(clean_inline(text), "^[ .—\\-–\t]+|[ .—\\-–\t]+$", "")


def is_non_content(title: Column, nav_path: Column) -> Column:
    """Whether a title or the last label of the way to it names a part that is not narrated; null counts as no name."""
    last = F.try_element_at(nav_path, F.lit(-1))
    return F.coalesce(F.lower(clean_title(title)).isin(*NON_CONTENT_TITLES), F.lit(False)) | F.coalesce(F.lower(last).isin(*NON_CONTENT_TITLES), F.lit(False))


def flatten_title(nav_path: Column) -> Column:
    """One title for a way of labels: a bare number keeps all its parents, a deep name the first of them."""
    parts = F.filter(F.coalesce(nav_path, F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    leaf, first = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(1))
    numeral = leaf.rlike(r"(?i)^[0-9IVXLCDM]+[.)]?$")
    return F.when(F.size(parts) == 0, F.lit(UNTITLED)).when(F.size(parts) == 1, leaf).when(numeral, F.array_join(parts, " — ")).when(F.size(parts) > 2, F.concat(first, F.lit(" — "), leaf)).otherwise(leaf)


def latin_share(text: Column) -> Column:
    """Latin letters among Latin and Cyrillic ones; 0 where there are none of either."""
    # What is left without the letters tells how many there were; no list of matches is made.
    without = lambda letters: F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]++", ""))
    latin, cyrillic = without("A-Za-z"), without("А-Яа-яЁё")
    return F.when(text.isNotNull(), F.coalesce(F.try_divide(latin, latin + cyrillic), F.lit(0.0)))


ENGLISH_SHARE = 0.9


def is_english(text: Column) -> Column:
    """Whether at least nine tenths of the letters are Latin."""
    return latin_share(text) >= ENGLISH_SHARE


def romanize(text: Column) -> Column:
    """Cyrillic letters in Latin; a capital that becomes several letters keeps the first as a capital."""
    one = {c: r for c, r in ROMANIZE.items() if len(r) == 1}
    none = "".join(c for c, r in ROMANIZE.items() if not r)
    out = text
    for c, r in ROMANIZE.items():
        if len(r) > 1:
            out = F.replace(F.replace(out, F.lit(c), F.lit(r)), F.lit(c.upper()), F.lit(r.capitalize()))
    low, high = "".join(one), "".join(one.values())
    return F.translate(out, low + low.upper() + none + none.upper(), high + high.upper())


def match_case(source: Column, out: Column) -> Column:
    """``out`` in the case of ``source``: all capitals, a first capital, or as it is."""
    first = F.substring(source, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    shouted = (source == F.upper(source)) & (source != F.lower(source)) & (F.length(source) > 1)
    return F.when(F.length(out) == 0, out).when(shouted, F.upper(out)).when(capital, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20))).otherwise(out)


def plural_ru(number: Column, one: str, few: str, many: str) -> Column:
    """The form of a Russian noun after a whole number."""
    hundred, ten = F.abs(number) % 100, F.abs(number) % 10
    return F.when(number.isNull(), None).when(hundred.between(11, 14), many).when(ten == 1, one).when(ten.between(2, 4), few).otherwise(many)


def roman_to_int(text: Column) -> Column:
    """The value of a Roman numeral by subtraction; null for an empty text or one with other letters."""
    value = literal_map({"I": "1", "V": "5", "X": "10", "L": "50", "C": "100", "D": "500", "M": "1000"})
    digits = F.transform(F.reverse(F.split(F.upper(text), "")), lambda c: F.try_element_at(value, c).cast("int"))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    added = F.aggregate(digits, start, lambda s, v: F.struct((s["total"] + F.when(v < s["most"], -v).otherwise(v)).alias("total"), F.greatest(s["most"], v).alias("most")), lambda s: s["total"])
    return F.when(text.rlike("^(?i)[IVXLCDM]+$"), F.nullif(added, F.lit(0)))


def spell_letters(text: Column, lang: str) -> Column:
    """Every character by its name, with spaces between; characters without a name stand for themselves."""
    chars = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
    if lang != "ru":
        names = F.transform(chars, lambda c: F.when(c.rlike("^[A-Za-z]$"), F.lower(c)).otherwise(c))
    else:
        table = literal_map(LETTER_NAMES_RU)
        names = F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, F.lower(c)), c))
    return F.array_join(names, " ")


def to_acute(text: Column) -> Column:
    """``+`` before a stressed vowel becomes an acute after it; ё takes none and a last ``+`` stays."""
    return F.regexp_replace(F.regexp_replace(text, r"\+([ёЁ])", "$1"), r"(?s)\+(.)", f"$1{ACUTE}")


def acute_to_plus(text: Column) -> Column:
    """The inverse: an acute after a letter becomes ``+`` before it."""
    return F.regexp_replace(text, f"(?s)(.){ACUTE}", r"+$1")


def one_acute_per_compound(word: Column) -> Column:
    """In a hyphenated word only the last acute stays."""
    return F.when(word.contains("-"), F.regexp_replace(word, f"{ACUTE}(?=.*{ACUTE})", "")).otherwise(word)


def to_acute_sparse(text: Column) -> Column:
    """Acutes only where they tell something: not on words with ё, with fewer than two vowels, or without stress."""

    def word(token: Column) -> Column:
        bare = F.replace(token, F.lit("+"), F.lit(""))
        core = F.regexp_replace(F.lower(bare), "^[.,!?;:—\\-«»\"'()\\[\\]…]+|[.,!?;:—\\-«»\"'()\\[\\]…]+$", "")
        plain = core.contains("ё") | (F.regexp_count(core, F.lit("[аеёиоуыэюя]")) < 2) | core.isin(*CLITICS)
        return F.when(plain, bare).otherwise(one_acute_per_compound(to_acute(token)))

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def dash_to_ellipsis(text: Column) -> Column:
    """A dash in the middle of a sentence becomes a pause."""
    return F.regexp_replace(text, r"(?U)(?<=[\w,»)]) [–—] ", "... ")


def letters_only(text: Column) -> Column:
    """What an edit must leave as it is: letters and digits, without case, stress marks and the dots of ё.

    Lower case is taken for case folding, so ß stays itself; combining marks but the acute are taken as composed.
    """
    return F.regexp_replace(F.translate(F.lower(F.translate(text, ACUTE, "")), "ё", "е"), r"[^\p{L}\p{N}]+", "")


def sentences_crude(text: Column) -> Column:
    """The parts of a text between a stop and the space after it; empty parts are left out."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?…])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def delivery_tags(text: Column) -> Column:
    """The baseline tag and after it the tag of the first rule that fits, if one does."""
    tag = F.lit("")
    for pattern, found in reversed(TAG_RULES):
        tag = F.when(text.rlike(pattern), found).otherwise(tag)
    return F.when(text.isNotNull(), F.concat(F.lit(BASELINE_TAG), tag))


def default_backend(lang: Column) -> Column:
    """The voice of a language code with or without region; another one, also for null."""
    code = F.substring_index(F.lower(F.coalesce(lang, F.lit(""))), "-", 1)
    return F.coalesce(F.try_element_at(literal_map(BACKENDS), code), F.lit(DEFAULT_BACKEND))


def scale_pause(pause_ms: Column, pause: Column) -> Column:
    """A long pause is 600 ms longer, a short one half as long but at least 150 ms."""
    return F.when(pause == "long", pause_ms + 600).when(pause == "short", F.greatest(F.lit(150), F.floor(pause_ms / 2).cast("int"))).otherwise(pause_ms)


def chunk_key(settings: Column, text: Column) -> Column:
    """Key of a rendered chunk: 12 hex digits over settings and text."""
    return F.substring(F.sha1(F.concat(settings, F.lit("\0"), text)), 1, 12)


def digest(texts: Column) -> Column:
    """Digest of texts in order: 16 hex digits."""
    return F.substring(F.sha1(F.array_join(texts, "\n")), 1, 16)


def chapter_numbers(spec: Column, count: Column) -> Column:
    """``1,3,7-9`` as sorted distinct numbers from 1 to ``count``; parts that are no number or range are left out."""
    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p).rlike(r"^\d+(\s*-\s*\d+)?$"))

    def numbers(part: Column) -> Column:
        low = F.greatest(F.lit(1), F.trim(F.substring_index(part, "-", 1)).cast("int"))
        high = F.least(count, F.trim(F.substring_index(part, "-", -1)).cast("int"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def slug(text: Column, default: str = "book") -> Column:
    """A name for files: words joined by hyphens, at most 60 characters. The text is taken to be decomposed already."""
    kept = F.regexp_replace(text, r"(?U)[^\w\s.\-]", "")
    joined = F.regexp_replace(F.regexp_replace(F.trim(kept), r"(?U)[\s_]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, 60), F.lit("")), F.lit(default))


def escape_metadata(text: Column) -> Column:
    """The characters that mean something in chapter metadata, escaped; a new line becomes a space."""
    return F.translate(F.regexp_replace(text, "([=;#\\\\])", "\\\\$1"), "\n", " ")


def expand_abbreviations(text: Column, table: dict[str, str], ignore_case: bool) -> Column:
    """Abbreviations in full, the longest first, where no letter stands before them."""
    guard, flags = (r"(?<!\p{L})", "(?iu)") if ignore_case else ("(?<![A-Za-z])", "")
    for short in sorted(table, key=len, reverse=True):
        text = F.regexp_replace(text, f"{flags}{guard}\\Q{short}\\E", table[short])
    return text
