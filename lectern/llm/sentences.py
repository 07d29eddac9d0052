"""Sentence boundaries across languages and scripts (problem 4).

The sentence-break rules of the Unicode text segmentation standard, over its Sentence_Break character property. Every
character of a text becomes the letter of its class (see ``CLASSES``), so the rules are patterns over class strings
and hold for the terminators, letters, closing marks and spaces of all scripts alike. Where the standard leaves the
choice to tailoring, the rules are tailored, which ``break_classes`` and ``sentence_starts`` say one by one:
abbreviations are suppressed by the language of the text, and quotations are paired, so that stops inside a quotation
that goes on end nothing.
"""

from __future__ import annotations

import re
import sys
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.normalform import blocks_of

# Abbreviations without their last stop. One that is written with a capital is known with it only.
# TITLES go on whatever follows, MAY_END unless a word follows that mostly opens sentences, NUMBERED before digits.
TITLES = {
    "en": "Mr Mrs Ms Dr St Prof Capt Col Gen Lt Sgt Rev Hon Gov Sen Rep Mt Ft Messrs",
    "de": "Dr Prof Hr Hrn Fr Frl St bzw ca vgl sog ggf evtl inkl geb",
    "fr": "M MM Mme Mmes Mlle Mlles Me Dr Pr St Ste Mgr av bd env",
    "es": "sr sra srta sres dr dra lic ing gral Cap av avda dña prof",
    "ru": "проф гор ул пр просп пер пл бул д-р тов акад ред св см напр ср тж",
    "uk": "проф вул просп пл бул д-р тов акад ред св див напр",
    "hi": "डॉ श्री पं प्रो सुश्री कु",
}
MAY_END = {"es": "ud uds", "ru": "г гр им т ст дер обл", "uk": "р м г гр ім ст обл"}
NUMBERED = {
    "en": "no nos vol fig ch p pp ed sec art approx ca cf vs",
    "de": "nr bd s abb kap art str",
    "fr": "no n vol fig chap p pp art h",
    "es": "no núm n vol fig cap pág p pp art",
    "ru": "стр с рис гл т тт кн д кв корп п пп ст табл",
    "uk": "стор с рис гл т кн буд кв п ст табл",
    "hi": "सं क्र पृ",
}
#: Abbreviations of several parts that always go on.
CONTINUED = ("i.e", "e.g", "d.h", "z.b", "u.a", "z.t", "i.d.r", "p.ej", "p.ex", "c.-à-d", "c.à.d", "т.е", "т.к", "т.н", "т.зв", "т.з")
#: Abbreviations of several parts that may end a sentence, though their last part looks like an initial.
ENDING = ("т.д", "т.п", "т.ін", "a.m", "p.m", "a.d", "b.c", "н.э", "н.е", "д.р")
GERMAN_MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jan feb apr jun jul aug sep okt nov dez"
BEFORE_ORDINAL = "am vom zum der den dem des im bis seit ab und"
# Words that open sentences and stand in no name.
OPENERS = {
    "en": "He She It They We You The This That These Those There Then But And So Now When If What Why How Where Nobody Everyone",
    "de": "Er Sie Es Wir Ihr Das Dies Dann Aber Und Doch Nun Als Wenn Was Warum Wie Wo Niemand Alle",
    "fr": "Il Elle Ils Elles Nous Vous Ce Cela Puis Mais Et Alors Quand Si Que Pourquoi Comment Personne",
    "es": "Él Ella Ellos Ellas Esto Eso Luego Pero Entonces Cuando Si Qué Por Cómo Nadie Después",
    "ru": "Он Она Оно Они Мы Вы Ты Это Потом Затем Тогда Теперь Но Да Нет Так Там Тут Здесь Когда Если Что Как Где Кто Все Всё В На Не",
    "uk": "Він Вона Воно Вони Ми Ви Ти Це Потім Тоді Тепер Але Так Там Тут Коли Якщо Що Як Де Хто Усі Все В У На Не",
}
# Frequent words that tell languages of one script apart, and letters that do.
FUNCTION_WORDS = {
    "en": "the of and to in is was he she it his her that with for on at not they said",
    "de": "der die das und ist nicht ein eine er sie mit den dem zu von war ich wo",
    "fr": "le la les des et est un une il elle dans que pas pour sur au vit vint",
    "es": "el los las y es una que en con no por su se del lo está",
    "ru": "и в не на он она что с как по это было был",
    "uk": "і в не на він вона що з як це було був та",
}
OWN_LETTERS = {"ru": "ыэъё", "uk": "іїєґ", "de": "ßäöü", "es": "ñ¿¡", "fr": "êèçœà"}
SCRIPTS = {"en": "Latin", "de": "Latin", "fr": "Latin", "es": "Latin", "ru": "Cyrillic", "uk": "Cyrillic", "hi": "Devanagari"}

#: The letters of the classes: those of the property, and ``Q`` for opening marks and ``H`` for scripts without spaces.
CLASSES = {"ATerm": "A", "STerm": "T", "Close": "C", "SContinue": "K", "Sp": "P", "Sep": "S", "CR": "R", "LF": "F", "Extend": "E", "Format": "M", "Numeric": "N", "Upper": "U", "Lower": "L", "OLetter": "O"}
OTHER = "X"
OPEN_TO_CLOSE = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "《": "》", "‹": "›", "(": ")", "（": "）", "[": "]", "【": "】"}
_BRACKETS = ")]）】"


@lru_cache(maxsize=1)
def break_classes() -> np.ndarray:
    """The class of every code point, from the character property, with these tailorings.

    An ellipsis is a terminator. Opening marks (categories Ps and Pi) are no closing marks: they belong to the sentence
    that they open. Dashes do not continue a sentence, as they open speech. Letters and signs of the scripts that are
    written without spaces between words (Line_Break SA) have a class of their own, for such a script without stops.
    """
    out = np.full(sys.maxunicode + 1, ord(OTHER), np.uint8)
    every = "".join(chr(c) for c in range(0x323B0) if not 0xD800 <= c < 0xE000) + "".join(map(chr, range(0xE0000, 0xE0200)))

    def spans(pattern: str) -> Iterator[np.ndarray]:
        for match in regex.finditer(f"{pattern}+", every):
            yield np.frombuffer(match[0].encode("utf-32-le"), np.uint32)

    for name, letter in CLASSES.items():
        for codes in spans(rf"\p{{Sentence_Break={name}}}"):
            out[codes] = ord(letter)
    for codes in spans(r"\p{Line_Break=SA}"):
        out[codes] = ord("H")
    for codes in spans(r"[\p{Ps}\p{Pi}]"):
        out[codes] = np.where(out[codes] == ord("C"), ord("Q"), out[codes])
    for codes in spans(r"\p{Pd}"):
        out[codes] = ord(OTHER)
    out[ord("…")] = out[ord("‥")] = ord("T")
    return out


# The rules, over class strings. Extend and Format are ignored behind what they follow (rule SB5 of the standard).
_TERMINATORS = rb"[AT](?:[EM]*[AT])*[EM]*"
_RULE = re.compile(rb"(" + _TERMINATORS + rb")|[SRF]")
#: The same, and a space behind a letter of a script without spaces.
_RULE_OR_SPACE = re.compile(_RULE.pattern + rb"|(?<=H)(?P<space>[EM]*P[PEM]*)(?=[^PSRFEM])")
_CLOSE = re.compile(rb"[CEM]*")
_SPACES = re.compile(rb"[PEM]*")
_BREAKS = re.compile(rb"[SRFPEM]*")
_LETTER = re.compile(rb"[ULONH]")
_SEPARATOR = re.compile(rb"[SRF]")
_NOTHING_MORE = re.compile(rb"[PCEM]*")
#: What the rules can act on: a terminator that something follows, a separator, a space of a script without spaces.
_ANY_RULE = re.compile(rb"[ATSRF]|HP")

#: Behind these, listed abbreviations and their parts stand; none is longer than this.
LONGEST = 24
_TOKEN = re.compile("[^\\s.!?…。，,;:«»“”„\"()\\[\\]—]+$")
_COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,4}(?:[.][ \-]?[^\W\d_]{1,3}){1,2}$")
_QUOTES = re.compile("[" + re.escape("".join(OPEN_TO_CLOSE) + "".join(OPEN_TO_CLOSE.values()) + '"') + "]")
_WORD = re.compile(r"[^\W\d_]+")
_IGNORED = re.compile("[\u00ad\u180e\u200b-\u200f\u2060\ufeff]")
_CONTINUED, _ENDING = frozenset(CONTINUED), frozenset(ENDING)
_MONTHS, _ORDINAL = frozenset(GERMAN_MONTHS.split()), frozenset(BEFORE_ORDINAL.split())


@lru_cache(maxsize=1)
def _own_stops() -> re.Pattern:
    """Terminators of the scripts without spaces that have any: where one stands, spaces end nothing."""
    blocks = (*range(0x1000, 0x10A0), *range(0x1780, 0x1800), *range(0x1950, 0x1AB0))
    return re.compile("[" + "".join(chr(c) for c in blocks if regex.match(r"\p{Sentence_Break=STerm}", chr(c))) + "]")


class _Rules:
    """The abbreviations of some languages together."""

    def __init__(self, languages: frozenset[str]) -> None:
        def union(table: dict[str, str]) -> frozenset[str]:
            return frozenset(w for code in languages for w in table.get(code, "").split())

        self.titles, self.may_end, self.numbered = union(TITLES), union(MAY_END), union(NUMBERED)
        self.openers = union(OPENERS)
        self.german = "de" in languages


_rules = lru_cache(maxsize=None)(_Rules)


@lru_cache(maxsize=1)
def _any_language() -> _Rules:
    """All abbreviations, and no word that opens sentences: what it does not suppress, no language does."""
    out = _Rules(frozenset({*TITLES, *MAY_END, *NUMBERED}))
    out.openers = frozenset()
    return out


def languages_of(text: str) -> frozenset[str]:
    """The languages whose abbreviations count in a text: those whose frequent words and own letters stand in it, at
    least a third as often as those of the most frequent language of their script; without any, all of the script's."""
    low = text.lower()
    words: dict[str, int] = {}
    for word in _WORD.findall(low):
        words[word] = words.get(word, 0) + 1
    points = {code: sum(words.get(w, 0) for w in frequent.split()) + sum(low.count(c) for c in OWN_LETTERS.get(code, "")) for code, frequent in FUNCTION_WORDS.items()}
    out = {"hi"}
    for script in ("Latin", "Cyrillic"):
        own = {code: points.get(code, 0) for code, name in SCRIPTS.items() if name == script}
        most = max(own.values())
        out |= {code for code, n in own.items() if 3 * n >= most}
    return frozenset(out)


def _known(word: str, listed: frozenset[str]) -> bool:
    """Whether a word is listed: as it is written, or in lower case, or, all in capitals, with a capital."""
    return word in listed or word.lower() in listed or (word.isupper() and len(word) > 1 and word.capitalize() in listed)


def _suppressed(text: str, stop: int, start: int, following: str, rules: _Rules) -> bool:
    """Whether the full stop at ``stop`` belongs to an abbreviation, initial or number that goes on at ``start``."""
    before = text[max(0, stop - LONGEST) : stop]
    if not before.isascii():
        before = U.normalize("NFKC", _IGNORED.sub("", before))
    token = _TOKEN.search(before)
    if not token:
        return False
    word = token[0]
    nxt = _WORD.match(text, start)
    if word.isdigit():
        if following.isdigit() or not rules.german or len(word) > 2 or not nxt:
            return False
        earlier = before[: token.start()].split()
        return nxt[0].lower() in _MONTHS or bool(earlier and earlier[-1].lower() in _ORDINAL)
    compound = _COMPOUND.search(before.lower())
    if compound:
        parts = compound[0].replace(" ", "")
        if parts in _CONTINUED:
            return True
        if parts in _ENDING:
            return False
    if _known(word, rules.titles):
        return True
    if following.isdigit() and _known(word, rules.numbered):
        return True
    if (len(word) == 1 and word.isupper()) or _known(word, rules.may_end):
        # A name may follow, but no word that opens sentences, unless it is an initial itself.
        return not (nxt and nxt[0] in rules.openers and text[nxt.end() : nxt.end() + 1] != ".")
    return False


def _quotations(text: str) -> list[tuple[int, int]]:
    """Pairs (opening, closing) of quotation marks and brackets, outermost only; an unpaired mark opens nothing."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for match in _QUOTES.finditer(text):
        char, at = match[0], match.start()
        hit = next((k for k in range(len(stack) - 1, -1, -1) if char in stack[k][0]), None)
        if hit is not None:
            opened = stack[hit][1]
            del stack[hit:]
            while out and out[-1][0] > opened:
                out.pop()
            out.append((opened, at))
        elif char == '"':
            stack.append(('"', at))
        elif char in OPEN_TO_CLOSE:
            stack.append((OPEN_TO_CLOSE[char], at))
    return out


def class_strings(texts: list[str]) -> list[bytes]:
    """The class of every character of every text."""
    joined = "".join(texts)
    classes = break_classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes()
    out, at = [], 0
    for text in texts:
        out.append(classes[at : at + len(text)])
        at += len(text)
    return out


def sentence_starts(stored: str | None, classes: bytes | None = None) -> list[int]:
    """Offsets of the first characters of all sentences but the first. Null, empty and blank texts have none.

    Rules SB3 to SB11 of the standard with these tailorings: lower case continues after every terminator, not only
    after a full stop (SB8), a digit opens a sentence; upper case continues behind upper case and a full stop only
    (SB7); stops inside a quotation that goes on, and those of abbreviations, end nothing; words that attribute a
    quotation belong to it; a space ends a sentence of a script without spaces and stops.
    """
    if not stored:
        return []
    c = classes if classes is not None else class_strings([stored])[0]
    if not _ANY_RULE.search(c):
        return []
    text, size = stored, len(stored)
    quotes = _quotations(text) if _QUOTES.search(text) else []
    spaces = b"HP" in c and not _own_stops().search(text)
    languages: frozenset[str] | None = None
    out: list[int] = []
    first = _SPACES.match(c).end()
    at, k = 0, 0
    rule = _RULE_OR_SPACE if spaces else _RULE
    while match := rule.search(c, at):
        begin, at = match.span()
        end = at
        run = match[1]
        while k < len(quotes) and quotes[k][1] < begin:
            k += 1
        inside = k < len(quotes) and quotes[k][0] < begin
        if run is None:
            if c[begin] in b"SRF":  # SB4: a separator ends a sentence
                at = _BREAKS.match(c, at).end()
                if at < size and begin > first:
                    out.append(at)
            elif not inside and begin > first and (c[end] in b"UOH" or text[end] in OPEN_TO_CLOSE):
                out.append(end)
            continue
        quoted = False
        if inside:
            close = quotes[k][1]
            if not _NOTHING_MORE.fullmatch(c, end, close):
                continue  # the quotation goes on
            end, quoted = close + 1, text[close] not in _BRACKETS
        end = _CLOSE.match(c, end).end()  # SB9
        start = _SPACES.match(c, end).end()  # SB10
        at = max(at, end)
        if start >= size:
            break
        following = c[start]
        if following in b"KAT":  # SB8a
            continue
        letter = _LETTER.search(c, start)
        if not letter or _SEPARATOR.search(c, start, letter.start()):
            continue  # nothing follows, or the separator ends it (SB4)
        kind, touching = letter[0], letter.start() == start
        spaced = b"P" in c[end:start]
        plain = run.rstrip(b"EM") == b"A"
        if plain and not spaced and touching:
            before = c[:begin].rstrip(b"EM")[-1:]
            if kind == b"N" and before == b"N":  # SB6
                continue
            if kind == b"U" and before == b"U":  # SB7
                continue
            if not quoted and (kind == b"N" or before not in b"ULOH" or not before):
                continue
        if kind == b"L":  # SB8
            continue
        if plain and not quoted:
            # The language is looked for only where the stop may belong to an abbreviation of any.
            following = text[letter.start()]
            if _suppressed(text, begin, start, following, _any_language()):
                languages = languages_of(text) if languages is None else languages
                if _suppressed(text, begin, start, following, _rules(languages)):
                    continue
        if quoted and touching and kind in b"OH":
            continue  # words that attribute the quotation
        if not spaced and not plain and kind == b"N" and text[match.end() - 1] == ".":
            continue
        out.append(start)  # SB11
    return out


def sentences(stored: str | None) -> list[tuple[int, str]]:
    """``(offset, sentence)`` of a whole text; the sentences keep their closing marks but no outer space."""
    if not stored:
        return []
    cuts = [0, *sentence_starts(stored), len(stored)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        piece = stored[a:b]
        trimmed = piece.lstrip()
        if trimmed:
            out.append((a + len(piece) - len(trimmed), trimmed.rstrip()))
    return out


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, starts = [], []
        for places, block in blocks_of(batch.column("text").to_pylist()):
            for k, text, classes in zip(places, block, class_strings(block)):
                found = sentence_starts(text, classes)
                if found:
                    starts.extend(found)
                    rows.extend([k] * len(found))
        if starts:
            kept = batch.select(["item_kind", "item_id", "p_i"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(starts, pa.int32())], names=["item_kind", "item_id", "p_i", "sent_start"])


def sentence_boundaries(items: DataFrame) -> DataFrame:
    """``item_kind, item_id, p_i, sent_start``: the offset of each sentence but the first, for every item."""
    return items.select("item_kind", "item_id", "p_i", "text").filter("text <> ''").mapInArrow(_starts, "item_kind string, item_id long, p_i int, sent_start int")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, number, starts, texts = [], [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            for n, (start, sentence) in enumerate(sentences(text)):
                rows.append(k)
                number.append(n)
                starts.append(start)
                texts.append(sentence)
        kept = batch.select(["item_kind", "item_id", "p_i"]).take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], names=["item_kind", "item_id", "p_i", "sent_i", "sent_start", "sentence"])


def sentence_units(items: DataFrame) -> DataFrame:
    """``item_kind, item_id, p_i, sent_i, sent_start, sentence``: the sentences of every item, in order.

    Null, empty and blank texts have no sentence. Offsets count characters of the stored text.
    """
    return items.select("item_kind", "item_id", "p_i", "text").mapInArrow(_units, "item_kind string, item_id long, p_i int, sent_i int, sent_start int, sentence string")
