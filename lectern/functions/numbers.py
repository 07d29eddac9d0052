"""Numbers in words, English and Russian: cardinals, ordinals and decimals.

Plain Python, used inside Arrow UDFs. Numbers beyond the named powers come out as digits.
"""

from __future__ import annotations

# Number words.
EN_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_POWERS = ["", "thousand", "million", "billion", "trillion", "quadrillion"]
EN_ORDINAL = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
RU_SMALL = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "_ _ двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "_ сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
RU_POWERS = [("", "", ""), ("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов"), ("триллион", "триллиона", "триллионов"), ("квадриллион", "квадриллиона", "квадриллионов")]
RU_FEMININE = {"один": "одна", "два": "две"}
RU_PLACES = ("десят", "сот", "тысячн", "десятитысячн", "стотысячн", "миллионн")
RU_ORDINAL = {
    "ноль": "нулевой", "один": "первый", "два": "второй", "три": "третий", "четыре": "четвёртый", "пять": "пятый", "шесть": "шестой",
    "семь": "седьмой", "восемь": "восьмой", "девять": "девятый", "сорок": "сороковой", "сто": "сотый",
}
RU_GENITIVE = {"один": "одно", "два": "двух", "три": "трёх", "четыре": "четырёх", "сорок": "сорока", "девяносто": "девяноста", "сто": "сто"}


def plural(n: int, forms: tuple[str, str, str]) -> str:
    """The Russian form for one, a few, or many."""
    tail = abs(n) % 100
    if 10 < tail < 15:
        return forms[2]
    return forms[0] if tail % 10 == 1 else forms[1] if 1 < tail % 10 < 5 else forms[2]


def _groups(n: int) -> list[tuple[int, int]]:
    """``(power of a thousand, value)`` from the highest, without empty groups."""
    out, power = [], 0
    while n:
        n, value = divmod(n, 1000)
        if value:
            out.append((power, value))
        power += 1
    return out[::-1]


def _en_hundreds(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    words = [f"{EN_SMALL[hundreds]} hundred"] if hundreds else []
    if rest >= 20:
        words.append(EN_TENS[rest // 10] + (f"-{EN_SMALL[rest % 10]}" if rest % 10 else ""))
    elif rest:
        words.append(EN_SMALL[rest])
    return " and ".join(words)


def _ru_hundreds(n: int, feminine: bool = False) -> list[str]:
    words = []
    if n >= 100:
        words.append(RU_HUNDREDS[n // 100])
    rest = n % 100
    if rest >= 20:
        words.append(RU_TENS[rest // 10])
        rest %= 10
    if rest:
        word = RU_SMALL[rest]
        words.append(RU_FEMININE.get(word, word) if feminine else word)
    return words


def cardinal(n: int, lang: str, feminine: bool = False) -> str:
    """A whole number in words; ``feminine`` is for Russian only."""
    groups = _groups(abs(n))
    if groups and groups[0][0] >= len(EN_POWERS):
        return str(n)
    if lang == "ru":
        words = ["минус"] if n < 0 else []
        for power, value in groups:
            words += _ru_hundreds(value, feminine if not power else power == 1)
            if power:
                words.append(plural(value, RU_POWERS[power]))
        return " ".join(words) if groups else RU_SMALL[0]
    parts = []
    for power, value in groups:
        parts.append(_en_hundreds(value) + (f" {EN_POWERS[power]}" if power else ""))
    if not groups:
        return EN_SMALL[0]
    last = groups[-1]
    joined = ", ".join(parts)
    if len(parts) > 1 and last[0] == 0 and last[1] < 100:
        joined = ", ".join(parts[:-1]) + " and " + parts[-1]
    return f"minus {joined}" if n < 0 else joined


def decimal(text: str, lang: str) -> str:
    """A decimal number, written with a point, in words; zeros at its end are not said."""
    whole, _, part = text.partition(".")
    part = part.rstrip("0")
    if lang != "ru":
        return f"{cardinal(int(whole), 'en')} point {' '.join(EN_SMALL[int(d)] for d in part or '0')}"
    if len(part) > len(RU_PLACES):
        return text
    part = part or "0"
    place, number = RU_PLACES[len(part) - 1], int(part)
    ending = lambda k, stem: stem + ("ая" if k % 10 == 1 and k % 100 != 11 else "ых")
    return f"{cardinal(int(whole), 'ru', True)} {ending(int(whole), 'цел')} {cardinal(number, 'ru', True)} {ending(number, place)}"


def ordinal(n: int, lang: str) -> str:
    """An ordinal in words: English, or Russian nominative masculine."""
    words = cardinal(n, lang)
    if lang != "ru":
        head, dash, last = words.rpartition("-") if "-" in words.split(" ")[-1] else (words.rpartition(" ")[0], " " if " " in words else "", words.split(" ")[-1])
        last = EN_ORDINAL.get(last) or (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")
        return f"{head}{dash}{last}"
    parts = words.split(" ")
    last = parts[-1]
    if last in RU_ORDINAL:
        parts[-1] = RU_ORDINAL[last]
    elif last in RU_HUNDREDS[2:]:
        stem = {"двести": "двух", "триста": "трёх", "четыреста": "четырёх"}.get(last) or last[: -len("сот")].removesuffix("ь") + "и"
        parts[-1] = f"{stem}сотый"
    elif any(last in forms for forms in RU_POWERS[1:]):
        # A round power is one word with its count in the genitive: двадцатитысячный.
        power = next(k for k, forms in enumerate(RU_POWERS) if last in forms)
        count = n // 1000**power % 1000
        stems = [RU_GENITIVE.get(w) or (w if w.endswith("сот") else w.removesuffix("ь") + "и" if w.endswith("ь") else w) for w in _ru_hundreds(count)]
        name = {1: "тысячный"}.get(power) or f"{RU_POWERS[power][0]}ный"
        higher = n - n % 1000 ** (power + 1)
        return f"{cardinal(higher, 'ru')} {''.join(stems)}{name}".strip() if higher else ("" if count == 1 else "".join(stems)) + name
    else:
        parts[-1] = {"двадцать": "двадцатый", "тридцать": "тридцатый"}.get(last) or (last.replace("десят", "десят") if not last.endswith("ь") else last[:-1] + "ый")
        if last in RU_TENS[5:9]:
            parts[-1] = last.replace("ьдесят", "идесятый")
        elif last == RU_TENS[9]:
            parts[-1] = "девяностый"
    return " ".join(parts)


def clock(hour: int, minute: int, meridiem: str = "") -> str:
    """A time of day in English words."""
    half = meridiem[:1].lower()
    words = [cardinal(hour, "en")]
    words.append("o'clock" if minute == 0 else ("oh " if minute < 10 else "") + cardinal(minute, "en"))
    if half == "a":
        words.append("in the morning")
    elif half == "p":
        words.append("in the evening" if hour >= 6 else "in the afternoon")
    return " ".join(words)


def military(digits: str) -> str:
    """Four digits as a military time in English words."""
    hour, minute = int(digits[:2]), int(digits[2:])
    said = ("oh " if hour < 10 else "") + cardinal(hour, "en")
    return f"{said} {cardinal(minute, 'en') if minute else 'hundred'}"
