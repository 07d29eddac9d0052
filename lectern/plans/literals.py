"""Queries over literal texts, for rules that SQL cannot express over tables: the SQL gives the results that are known.

The inputs and results are the documented cases of each rule. A query has a row for each case: the name of the rule,
what went in, and what came out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import arrays as A
from lectern.functions import compare as C
from lectern.functions import latin as L
from lectern.functions import narration as N
from lectern.functions import numbers
from lectern.functions import stress as S
from lectern.functions.text import ACUTE

#: Sounds of the words of the cases, as pronouncing dictionaries have them.
LEXICON = {
    word: sounds.split()
    for word, sounds in {
        "camel": "K AE1 M AH0 L", "casino": "K AH0 S IY1 N OW0", "tough": "T AH1 F", "jeep": "JH IY1 P", "way": "W EY1", "residence": "R EH1 Z AH0 D AH0 N S",
        "document": "D AA1 K Y AH0 M AH0 N T", "president": "P R EH1 Z AH0 D EH2 N T", "parking": "P AA1 R K IH0 NG", "drink": "D R IH1 NG K", "consensus": "K AH0 N S EH1 N S AH0 S",
        "it": "IH1 T", "coca": "K OW1 K AH0", "cola": "K OW1 L AH0", "marlboro": "M AA1 R L B ER0 OW2", "pepsi": "P EH1 P S IY0", "cosmopolitan": "K AA2 Z M AH0 P AA1 L AH0 T AH0 N",
        "cherokee": "CH EH1 R AH0 K IY2", "cash": "K AE1 SH", "racket": "R AE1 K AH0 T",
    }.items()
}


def _two(rule: Callable[[str, str], str]) -> Callable[[str], str]:
    """A rule of a language and a text, from ``language|text``."""
    return lambda given: rule(*given.split("|", 1))


def _three(rule: Callable[[str, str, str], str]) -> Callable[[str], str]:
    return lambda given: rule(*given.split("|", 2))


def _plain(text: str) -> str:
    return text.replace(ACUTE, "")


def _bool(value: bool) -> str:
    return "yes" if value else "no"


def _samples(given: str) -> np.ndarray:
    """Runs of samples, written ``value*count``."""
    return np.concatenate([np.full(int(n), float(v)) for v, n in (part.split("*") for part in given.split())])


def _chunks(lang: str, mode: str, text: str) -> str:
    made = N.chunk_paragraphs(text.split("\n"), lang, 160, latin=mode)
    return " / ".join(f"{c.lang}:{c.text}{'.' if c.is_paragraph_end else ''}:{c.pause_ms}" for c in made.chunks)


RULES: dict[str, Callable[[str], str]] = {
    "cardinal": _two(lambda lang, n: numbers.cardinal(int(n), lang)),
    "ordinal": _two(lambda lang, n: numbers.ordinal(int(n), lang)),
    "decimal": _two(lambda lang, n: numbers.decimal(n, lang)),
    "clock": lambda t: numbers.clock(*map(int, t.split("|")[0].split(":")), t.split("|")[1]),
    "military": numbers.military,
    "expand_numbers": _two(lambda lang, t: N.expand_numbers(t, lang)[0]),
    "expand_english": lambda t: N.expand_english(t)[0],
    "respell": lambda t: N.respell(t, {"Иоган": "йоган", "отсек": "отс+ек"})[0],
    "unquote": lambda t: N.unquote_titles(t)[0],
    "acronym": lambda t: N.say_acronym(t) or "",
    "normalise": _two(lambda lang, t: N.normalise(t, lang)[0]),
    "phones": lambda w: " ".join(L.phones(w, LEXICON) or []),
    "word": lambda w: _plain(L.transliterate_word(w, LEXICON)),
    "stressed_word": lambda w: L.transliterate_word(w, LEXICON),
    "spelling": L.from_spelling,
    "roman_ordinal": _two(lambda case, n: L.roman_ordinal(n, case) or ""),
    "transliterate": lambda t: _plain(L.transliterate(t, LEXICON)[0]),
    "romanize": L.romanize,
    "is_english": lambda t: _bool(L.is_english(t)),
    "sentences": _two(lambda lang, t: " | ".join(N.split_sentences(t, lang))),
    "hard_split": _two(lambda limit, t: " | ".join(N.hard_split(t, int(limit)))),
    "bare_numeral": _two(lambda lang, t: _bool(N.is_bare_numeral(t, lang))),
    "chunks": _three(_chunks),
    "budget": _two(lambda seconds, t: str(N.byte_budget(t, float(seconds)))),
    "to_budget": _two(lambda budget, t: " | ".join(N.split_to_budget(t, int(budget)))),
    "tidy": S.tidy,
    "override_words": S.override_words,
    "override_phrases": S.override_phrases,
    "lower_starts": lambda t: S.lower_starts(t)[0],
    "splice_starts": _two(S.splice_starts),
    "fill_gaps": lambda t: S.fill_gaps(t, lambda w: w.replace("а", "+а", 1)),
    "marked": lambda t: S.marked(t, lambda x: x.replace("орога", "ор+ога").replace("осле", "осл+е"), lambda w: w.replace("о", "+о", 1)),
    "hand_marks": lambda t: S.keep_hand_marks(t, lambda x: x.replace("а", "+а", 1)),
    "canon": _two(lambda lang, t: C.canon(t, lang)),
    "collapse_acronyms": C.collapse_acronyms,
    "digits_to_words": _two(lambda lang, t: C.digits_to_words(t, lang)),
    "worst_sentence": _three(lambda lang, a, b: f"{C.worst_sentence(a, b, lang)[0]:.3f} {C.worst_sentence(a, b, lang)[1]}"),
    "missing": _three(lambda lang, a, b: " ".join(sum(C.missing_words(a, b, lang), []))),
    "passes": _three(lambda lang, a, b: _bool(C.verdict(a, b, lang).ok)),
    "trim_silence": lambda s: str(len(A.trim_silence(_samples(s), 1000))),
    "clamp_silence": lambda s: "{} {}".format(*(len(x) if isinstance(x, np.ndarray) else x for x in A.clamp_silence(_samples(s), 1000))),
    "silence_fraction": lambda s: f"{A.silence_fraction(_samples(s), 1000):.3f}",
    "longest_gap": lambda s: f"{A.longest_gap(_samples(s), 1000):.3f}",
    "resample": lambda s: " ".join(f"{x:g}" for x in A.resample(_samples(s), 2, 1)),
    "tail_loop": lambda s: _bool(A.tail_loop(np.tile(np.random.default_rng(0).normal(size=int(s.split()[0])), int(s.split()[1])), 8000)),
    "assemble": lambda s: "{} {}".format(*(len(x) if isinstance(x, np.ndarray) else x for x in A.assemble([(_samples(p), 100) for p in s.split(" / ")], 1000))),
}

# The documented cases of each rule, and what comes out.
CASES: dict[str, list[tuple[str, str, str]]] = {
    "number_literals": [
        ("cardinal", "en|0", "zero"), ("cardinal", "en|75", "seventy-five"), ("cardinal", "en|342", "three hundred and forty-two"), ("cardinal", "en|1005", "one thousand and five"),
        ("cardinal", "ru|21", "двадцать один"), ("cardinal", "ru|2000", "две тысячи"), ("cardinal", "ru|-3", "минус три"), ("cardinal", "ru|92", "девяносто два"), ("cardinal", "ru|5000000", "пять миллионов"),
        ("ordinal", "en|1", "first"), ("ordinal", "en|12", "twelfth"), ("ordinal", "en|20", "twentieth"), ("ordinal", "en|75", "seventy-fifth"), ("ordinal", "ru|3", "третий"), ("ordinal", "ru|21", "двадцать первый"),
        ("ordinal", "ru|40", "сороковой"), ("ordinal", "ru|90", "девяностый"), ("ordinal", "ru|200", "двухсотый"), ("ordinal", "ru|2000", "двухтысячный"), ("decimal", "ru|2.8", "две целых восемь десятых"),
        ("decimal", "ru|21.1", "двадцать одна целая одна десятая"), ("decimal", "en|0.05", "zero point zero five"), ("decimal", "en|2.5", "two point five"), ("clock", "8:30|a.m.", "eight thirty in the morning"),
        ("clock", "7:00|", "seven o'clock"), ("clock", "9:05|pm", "nine oh five in the evening"), ("clock", "1:15|pm", "one fifteen in the afternoon"), ("military", "0600", "oh six hundred"), ("military", "0615", "oh six fifteen"),
        ("expand_numbers", "ru|Отсек 20Б-40, 2,8 и 3/4.", "Отсек двадцать бэ тире сорок, две целых восемь десятых и три четверти."), ("expand_numbers", "en|room 64A, 2.5 or 3/4, 7 men", "room sixty-four a, two point five or three over four, seven men"),
    ],
    "rewriting_literals": [
        ("expand_english", "At 8:30 A.M. we left.", "At eight thirty in the morning we left."), ("expand_english", "at 0600 sharp", "at oh six hundred sharp"), ("expand_english", "0900 meters", "0900 meters"), ("expand_english", "3 MPs of the CDF", "3 em-pees of the see-dee-eff"),
        ("expand_english", "THE END OF IT", "THE END OF IT"), ("acronym", "OK", "okay"), ("acronym", "NASA", "NASA"), ("acronym", "US", "you-ess"), ("acronym", "XIV", "fourteen"), ("acronym", "WAR", ""),
        ("respell", "Иоган, иоган и Иоганна", "Йоган, йоган и Иоганна"), ("respell", "Отсек пуст", "Отс+ек пуст"), ("unquote", "Корабль «Йоган Кеплер» ушёл.", "Корабль Йоган Кеплер ушёл."), ("unquote", "Он сказал: «Стой! Куда?»", "Он сказал: «Стой! Куда?»"), ("unquote", "the “Red Fox” inn", "the Red Fox inn"),
        ("normalise", "en|Dr. Kim saw Mr. Fox, e.g. here.", "Doctor Kim saw Mister Fox, for example here."), ("normalise", "ru|см. стр. 5", "смотри страница пять"), ("normalise", "en|OK? 2 of us.", "okay? two of us."),
    ],
    "latin_literals": [
        ("word", "Coca", "Кока"), ("word", "Cola", "Кола"), ("word", "Marlboro", "Марлборо"), ("word", "Camel", "Кэмел"), ("word", "Pepsi", "Пепси"), ("word", "Cosmopolitan", "Козмополитан"), ("word", "tough", "таф"), ("word", "Cherokee", "Чероки"),
        ("word", "jeeps", "джипс"), ("word", "way", "вей"), ("word", "residence", "резиденс"), ("word", "documents", "докюментс"), ("word", "president", "президент"), ("word", "parkings", "паркингз"), ("word", "drinked", "дринкт"), ("word", "consensus'a", "консенсуса"),
        ("word", "it's", "итс"), ("word", "VIP", "ви-ай-пи"), ("word", "TV", "ти-ви"), ("word", "Barbiedoll", "Барбиедолл"), ("stressed_word", "Camel", f"Кэ{ACUTE}мел"), ("stressed_word", "casino", f"каси{ACUTE}но"), ("stressed_word", "cash", "кэш"),
        ("phones", "jeeps", "JH IY1 P S"), ("phones", "drinked", "D R IH1 NG K T"), ("phones", "parking", "P AA1 R K IH0 NG"), ("phones", "unknown", ""), ("spelling", "shock", "шок"), ("spelling", "lake", "лак"), ("spelling", "city", "сити"),
        ("roman_ordinal", "nom|XX", "двадцатый"), ("roman_ordinal", "gen|XIX", "девятнадцатого"), ("roman_ordinal", "gen|III", "третьего"), ("roman_ordinal", "nom|ABC", ""), ("transliterate", "в XX веке", "в двадцатом веке"), ("transliterate", "конец XIX века", "конец девятнадцатого века"),
        ("transliterate", "Пётр I", "Пётр первый"), ("transliterate", "XXI век", "двадцать первый век"), ("transliterate", "III", "третий"), ("transliterate", "Ковбои из «Marlboro» прискакали на все фасады.", "Ковбои из «Марлборо» прискакали на все фасады."),
        ("romanize", "But he drinked водка too much.", "But he drinked vodka too much."), ("is_english", "Gunmen shot on the streets!", "yes"), ("is_english", "А президент drinked in residence.", "no"), ("is_english", "Простым people to жрать was nothing!", "no"), ("is_english", "Только кириллица.", "no"),
    ],
    "segment_literals": [
        ("sentences", "ru|А. С. Пушкин жил. «Стой!» — крикнул он. Да!", "А. С. Пушкин жил. | «Стой!» — крикнул он. | Да!"), ("sentences", "en|Mr. Smith left... and came. Why?! Yes.", "Mr. Smith left... and came. | Why?! | Yes."), ("sentences", "en|  ", ""),
        ("hard_split", "60|Он вошёл в комнату и долго стоял у окна, — не зная, что сказать теперь.", "Он вошёл в комнату и долго стоял у окна, — | не зная, что сказать теперь."), ("hard_split", "50|short", "short"), ("hard_split", f"41|{'x' * 45}", f"{'x' * 41} | {'x' * 4}"),
        ("bare_numeral", "ru|четыре.", "yes"), ("bare_numeral", "en|five.", "yes"), ("bare_numeral", "ru|– Жрет много?", "no"), ("bare_numeral", "ru|четыре часа спустя", "no"),
        ("chunks", "ru|route|четыре.\nОн вошел в комнату.", ":четыре. Он вошел в комнату..:700"), ("chunks", "ru|route|Он стоял. Gunmen shot on the streets! Gangster power takes victory! Да.", ":Он стоял.:350 / en:Gunmen shot on the streets! Gangster power takes victory!:350 / :Да..:700"),
        ("chunks", "ru|keep|Gunmen shot on the streets! Да.", ":Gunmen shot on the streets! Да..:700"), ("budget", "5.0|Проба голоса для записи.", "134"), ("budget", "21|abc", "120"), ("to_budget", "40|Раз два. Три четыре пять.", "Раз два. | Три четыре пять."), ("to_budget", "99|Раз два.", "Раз два."),
    ],
    "mark_literals": [
        ("tidy", "п+осл+е", "п+осле"), ("tidy", "+он н+а н+оги", "+он на н+оги"), ("tidy", "ст+ол+", "ст+ол"), ("tidy", "+кот", "кот"), ("override_words", "Посл+е дождя", "П+осле дождя"), ("override_words", "посл+е", "п+осле"),
        ("override_phrases", "встал на ног+и", "встал на н+оги"), ("override_phrases", "в отс+ёк", "в отс+ек"), ("override_phrases", "Цвет+а кр+ови", "Цв+ета кр+ови"), ("override_phrases", "красного цвет+а", "красного цв+ета"), ("lower_starts", "Дорога шла. Потом дождь", "дорога шла. потом дождь"), ("lower_starts", "В Москве. Да", "В Москве. да"),
        ("splice_starts", "Дор+ога шл+а|д+орога шла", "Д+орога шл+а"), ("splice_starts", "раз|раз два", "раз"), ("fill_gaps", "Дорога на мост +он зелёная", "Дорог+а на мост +он зелёная"), ("marked", "Дорога после дождя", "Дор+ога п+осле д+ождя"), ("hand_marks", f"ла{ACUTE}мпа ла мпа", "л+ампа ла мпа"),
    ],
    "comparison_literals": [
        ("canon", "ru|Ёлка — две, №5!", "елка два пять"), ("canon", "en|The grey cat, u.s.a.", "the gray cat usa"), ("collapse_acronyms", "the see dee eff", "the cdf"), ("collapse_acronyms", "u.s.a. now", "usa now"), ("collapse_acronyms", "c d f now", "cdf now"),
        ("digits_to_words", "en|2,000 people at 8.30am", "two thousand people at eight thirty in the morning"), ("digits_to_words", "en|0615 and the 2nd, 3.5", "oh six fifteen and the second, three point five"), ("digits_to_words", "ru|30-го дня, 92", "тридцать дня, девяносто два"),
        ("worst_sentence", "en|One two three. Four five six.|One two three. Four six.", "0.385 Four five six."), ("worst_sentence", "en|One. Two.|One Two.", "0.000 "), ("missing", "ru|прошло две минуты|прошло минуты", "два"), ("missing", "en|in thirty minutes|in minutes", "thirty"),
        ("passes", "ru|обретали две тысячи дней веселья и вкусной еды тогда|обретали 2 тысячи дней веселья и вкусной еды тогда", "yes"), ("passes", "ru|одна из них обернулась ко мне и тихо улыбнулась мне|1 из них обернулась ко мне и тихо улыбнулась мне", "yes"),
        ("passes", "ru|— Да, — подтвердила Мара.|— Да, подтвердила Мара.", "yes"), ("passes", "ru|внешняя армированная обшивка смогла лишь немного смягчить его|внешне армированная обшивка смогла лишь немного смягчить его", "yes"),
        ("passes", "ru|После тридцатого дня полета все пассажиры ублажали себя так|После 30-го дня полета все пассажиры ублажали себя так", "yes"), ("passes", "ru|Он знал, что кто-то придет за ним очень скоро совсем|Он знал, что кто то придет за ним очень скоро совсем", "yes"),
        ("passes", "en|a fat, brat-and-beer-filled Chicago cop stood right there|a fat, brat and beer filled Chicago cop stood right there", "yes"), ("passes", "en|But I lived in a town of two thousand people and everyone knew me|But I lived in a town of 2,000 people and everyone knew me", "yes"),
        ("passes", "en|eating donuts at the Greenville Community Center that day|eating doughnuts at the Greenville Community Centre that day", "yes"), ("passes", "en|It departs at eight thirty in the morning we suggest you arrive|It departs at 8.30am. We suggest you arrive", "yes"),
        ("passes", "ru|Он ушел домой рано утром. Она осталась в комнате одна. Потом стало совсем тихо.|Он ушёл домой рано утром. Она осталась в комнате одна. Потом стало совсем тихо.", "yes"),
        ("passes", "ru|Армянское радио спрашивают: можно ли доехать на осле от Ташкента до Москвы?|Армянское радио спрашивают: можно ли доехать на от Ташкента до Москвы?", "no"), ("passes", "ru|поблизости оказавшиеся шестнадцать пассажиров тоже погибли и была часть|поблизости оказавшиеся шить пассажиров тоже погибли и была часть", "no"),
        ("passes", "ru|Пассажиры поднимались на борт ракетного омнибуса Йоган Кеплер и обретали девяносто два дня.|Пассажиры поднимались на бракетного омнибуса Йоганн Кеплер и обретали 92 дня.", "no"), ("passes", "ru|прошло две минуты и всё стихло вокруг них совсем тогда|прошло минуты и всё стихло вокруг них совсем тогда", "no"),
        ("passes", "ru|Пассажиры поднимались на борт ракетного омнибуса Йоган Кеплер и обретали девяносто два дня.|Пассажиры поднимались на Йоганн Кеплер и обретали 92 дня.", "no"), ("passes", "en|Your shuttle leaves in thirty minutes from right in front of this office|Your shuttle leaves in minutes from right in front of this office", "no"),
    ],
    "array_literals": [
        ("trim_silence", "0*100 0.5*50 0*100", "130"), ("trim_silence", "0*100", "0"), ("trim_silence", "0.5*30", "30"), ("clamp_silence", "0.5*100 0*1000 0.5*100", "650 1"), ("clamp_silence", "0.5*100 0*300 0.5*100", "500 0"), ("silence_fraction", "0.5*100 0*300", "0.750"),
        ("longest_gap", "0*100 0.5*100 0*200", "0.200"), ("resample", "1*1 2*1 3*1 4*1", "1 4"), ("tail_loop", "2666 13", "yes"), ("tail_loop", "32000 1", "no"), ("tail_loop", "100 1", "no"), ("assemble", "0.5*500 / 0*300 / 0.5*500", "2800 0"),
    ],
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("string")
        def applied(rules: pd.Series, inputs: pd.Series) -> pd.Series:
            return pd.Series([RULES[rule](given) for rule, given in zip(rules, inputs)], dtype=object)

        return spark.createDataFrame([c[:2] for c in CASES[name]], "rule string, given string").withColumn("result", applied("rule", "given"))

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in CASES}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = {name: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, case)) + ')' for case in cases)}) AS t(rule, given, result)" for name, cases in CASES.items()}
