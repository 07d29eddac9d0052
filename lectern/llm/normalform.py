"""Visually identical text with different characters (problem 3).

One form for all spellings of a text that a reader cannot tell apart. The work is split by a quick check:

1. A table indexed by code point maps, for a whole Arrow batch at once, every character whose form is one character or
   none: wide and narrow forms, look-alike letters, radicals, spaces of any width, invisible characters. (The same map
   as ``translate`` in generated code takes several times as long, which was measured.)
2. The same look-up tells which texts hold a character that may combine with its neighbours or expands to several
   characters (the "unstable" ones by the normalization quick check). In those texts alone, the unstable runs with the
   character before them, the boundary context, are normalized and spliced into the unchanged rest.

The comparison form writes look-alike letters of Cyrillic and Greek with their Latin twins. ``readable`` turns a
comparison form back into text in the script of each word; being computed from the comparison form alone, it is
the same for all copies.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed

# Letters of two scripts with one shape, in natural order.
CYRILLIC_TWINS = ("АВЕЅІЈКМНОРСТУХҮԚԜЀабвгдеѕіјкмнорстухѵѡԁһӏԛԝ", "ABESIJKMHOPCTYXYQWÈaбвгдesijкмнopcтyxvѡdhlqw")
GREEK_TWINS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc")
ARMENIAN_TWINS = ("ՏՕՍԼսոհզցօ", "SOULunhqgo")
CHEROKEE_TWINS = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4RWVSLCPKB")
#: Compatibility forms that a reader does not see. Superscripts, circles, fractions and the like are visible.
INVISIBLE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>")
#: Ranges of characters that show nothing (Default_Ignorable_Code_Point).
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))

_TWINS = {ord(a): b for twins in (CYRILLIC_TWINS, GREEK_TWINS, ARMENIAN_TWINS, CHEROKEE_TWINS) for a, b in zip(*twins) if a != b}
#: Planes 4 to 13 hold no characters, and of those above only the invisible ones count.
_PLANES = (range(0x34000), range(0xE0000, 0xE1000))


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, str], frozenset[int]]:
    """The one-to-one map and the set of unstable characters, built from the character properties."""

    def expand(char: str) -> str:
        parts = U.decomposition(char).split()
        if not parts or (parts[0][0] == "<" and parts[0] not in INVISIBLE_TAGS):
            return char
        return "".join(expand(chr(int(p, 16))) for p in parts if p[0] != "<")

    ignorable = {c for a, b in IGNORABLE for c in range(a, b + 1)}
    single: dict[int, str] = {c: "" for c in ignorable}
    unstable: set[int] = set()
    seconds: set[int] = set()
    for code in (c for plane in _PLANES for c in plane):
        if 0xD800 <= code < 0xE000 or code in ignorable or 0xAC00 <= code < 0xD7A4:
            continue
        if code >= 0x20000 and not U.decomposition(chr(code)):
            continue  # ideographs, which are their own form
        char = chr(code)
        category = U.category(char)
        if category in ("Cn", "Co"):
            continue
        if category == "Zs" or char == "\t":
            if char != " ":
                single[code] = " "
            continue
        if char in "\r\x0b\x0c\x85\u2028\u2029":
            single[code] = "\n"
            continue
        parts = U.decomposition(char).split()
        if len(parts) == 2 and parts[0][0] != "<" and U.normalize("NFC", char) == char:
            seconds.add(int(parts[1], 16))
        if U.combining(char):
            unstable.add(code)
            continue
        form = U.normalize("NFC", "".join(_TWINS.get(ord(c), c) for c in expand(char)))
        if form == char:
            continue
        if len(form) == 1 and not U.combining(form):
            single[code] = form
        else:
            unstable.add(code)
    unstable |= seconds | set(range(0x1161, 0x1200)) | {0xFF9E, 0xFF9F}
    return {c: f for c, f in single.items() if c not in unstable}, frozenset(unstable)


def _ranges(codes: frozenset[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return [(a, b) for a, b in out]


@lru_cache(maxsize=1)
def _unstable_runs() -> re.Pattern:
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(tables()[1])) + "]+")


#: Code points from here on share one entry of the tables below: no character is mapped there but the invisible ones.
LAST = 0xE1000
DROPPED = 0xFFFFFFFF


@lru_cache(maxsize=1)
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """The form of each code point, ``DROPPED`` where it has none, and which code points are unstable."""
    single, unstable = tables()
    form = np.arange(LAST + 1, dtype=np.uint32)
    form[np.array(list(single), np.int64)] = [ord(f) if f else DROPPED for f in single.values()]
    form[0xE0000:LAST] = DROPPED
    flags = np.zeros(LAST + 1, bool)
    flags[np.array(sorted(unstable), np.int64)] = True
    return form, flags


def codes_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and where each text begins, with the end of the last."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _spliced(text: str) -> str:
    """The text with its unstable runs, each with the character before it, in their form."""
    single = tables()[0]
    out, last = [], 0
    for match in _unstable_runs().finditer(text):
        begin = max(last, match.start() - 1)
        expanded = U.normalize("NFD", _expanded(text[begin : match.end()])).translate(single)
        out += [text[last:begin], U.normalize("NFC", expanded).translate(single)]
        last = match.end()
    return "".join([*out, text[last:]])


def _expanded(text: str) -> str:
    out = []
    for char in text:
        parts = U.decomposition(char).split()
        if parts and parts[0] in INVISIBLE_TAGS:
            out.append(_expanded("".join(chr(int(p, 16)) for p in parts[1:])))
        else:
            out.append(char)
    return "".join(out)


_SPACES = re.compile(r"[ ]*\n[ ]*|[ ]{2,}")


def _squeezed(text: str) -> str:
    return _SPACES.sub(lambda m: "\n" if "\n" in m[0] else " ", text).strip(" \n")


def comparison_form(text: str | None) -> str | None:
    """The comparison form of one text; null stays null and an empty text stays empty."""
    if text is None:
        return None
    return _squeezed(_spliced(text.translate(tables()[0])))


def comparison_forms(texts: Sequence[str]) -> list[str]:
    """:func:`comparison_form` of many texts at once."""
    # The one frequent character that expands needs no context.
    raw, at = codes_of([t.replace("…", "...") if "…" in t else t for t in texts])
    form, flags = code_tables()
    raw = np.minimum(raw, LAST)
    unstable = np.concatenate([[0], np.cumsum(flags[raw])])[at]
    mapped = form[raw]
    kept = mapped != DROPPED
    place = np.concatenate([[0], np.cumsum(kept)])[at].tolist()
    joined = mapped[kept].tobytes().decode("utf-32-le", "surrogatepass")
    out = []
    for k, (a, b) in enumerate(zip(place, place[1:])):
        text = joined[a:b]
        if unstable[k] != unstable[k + 1]:
            text = _spliced(text)
        if "  " in text or "\n" in text or text[:1] == " " or text[-1:] == " ":
            text = _squeezed(text)
        out.append(text)
    return out


@lru_cache(maxsize=1)
def _back() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    pairs = [(a, b) for a, b in zip(*CYRILLIC_TWINS) if a != b]
    both = dict((b, a) for a, b in pairs)
    both["ë"], both["Ë"], both["ï"], both["Ï"] = "ё", "Ё", "ї", "Ї"
    twin = "".join(both)
    return {ord(b): a for b, a in both.items()}, re.compile(f"(?![{twin}])[Ѐ-ԯ]"), re.compile(f"(?![{twin}])[A-Za-zÀ-ɏ]")


def readable(form: str | None) -> str | None:
    """Text for readers from a comparison form: words with letters that only Cyrillic has, and words of twins alone
    in a text with more such Cyrillic than Latin letters, are written in Cyrillic again."""
    if form is None:
        return None
    back, cyrillic, latin = _back()
    mostly = len(cyrillic.findall(form)) > len(latin.findall(form))

    def word(match: re.Match) -> str:
        w = match[0]
        c, l = len(cyrillic.findall(w)), len(latin.findall(w))
        return w.translate(back) if c > l or (c == l == 0 and mostly) else w

    return re.sub(r"[^\W\d_]+", word, form)


def blocks_of(texts: Sequence[str | None], most: int = 1 << 19) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in blocks of about ``most`` characters, with their places; a longer text is a block. Nulls are left out."""
    places, block, size = [], [], 0
    for k, text in enumerate(texts):
        if text is None:
            continue
        if block and size + len(text) > most:
            yield places, block
            places, block, size = [], [], 0
        places.append(k)
        block.append(text)
        size += len(text)
    if block:
        yield places, block


def _with_forms(text: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(batch.schema.get_field_index(text)).to_pylist()
            forms: list[str | None] = [None] * len(stored)
            for places, block in blocks_of(stored):
                for k, form in zip(places, comparison_forms(block)):
                    forms[k] = form
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "form"])

    return run


def with_form(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``form``, the comparison form of column ``text``. Other columns pass through unchanged.

    Null text gives a null form, empty text an empty one. A column ``form`` in the input is replaced.
    """
    plain = df.drop("form")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(_with_forms(text), f"{schema}, form string")


_KEYED = "item_kind string, item_id long, p_i int, key long, rest long, spelling long"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of the hash of kind and form, as two numbers, and 64 of that of the stored text."""
    for batch in batches:
        kinds = [(k or "").encode() for k in batch.column("item_kind").to_pylist()]
        for places, block in blocks_of(batch.column("text").to_pylist()):
            forms = [f.encode("utf-8", "surrogatepass") for f in comparison_forms(block)]
            seen = [k for k, f in enumerate(forms) if f]
            kept = batch.select(["item_kind", "item_id", "p_i"]).take(pa.array([places[k] for k in seen], pa.int32()))
            exact = np.frombuffer(b"".join(xxhash.xxh3_128_digest(kinds[places[k]] + b"\0" + forms[k]) for k in seen), ">i8").astype(np.int64).reshape(-1, 2)
            spelling = np.array([xxhash.xxh3_64_intdigest(block[k].encode("utf-8", "surrogatepass")) for k in seen], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(exact[:, 0]), pa.array(exact[:, 1]), pa.array(spelling)], names=[c.split()[0] for c in _KEYED.split(", ")])


def canonical_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``form`` and ``canonical``: one readable text for all visually identical spellings."""
    out = with_form(df, text)

    @F.pandas_udf("string")
    def back(forms):  # noqa: ANN001, ANN202
        return forms.map(readable)

    # Texts without letters that have twins need no script decision.
    plain = ~F.col("form").rlike("[Ѐ-ԯ]")
    return out.withColumn("canonical", F.when(F.coalesce(plain, F.lit(True)), F.col("form")).otherwise(back(F.when(~plain, F.col("form")))))


def _keyed(items: DataFrame) -> DataFrame:
    keyed = items.select("item_kind", "item_id", "p_i", "text").filter("text <> ''")
    return keyed.mapInArrow(_keys, _KEYED)


def look_classes(items: DataFrame) -> DataFrame:
    """``item_kind, item_id, p_i, class_id, spelling``: one row for each item that has a visible character.

    Items of one kind look the same exactly when they have one ``class_id`` (128 bits of the hash of kind and comparison
    form, as hex), and hold the same characters when they have one ``spelling`` too. Linear in the items: no pair is
    made. Null and empty texts are no items.
    """
    wide = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return _keyed(items).select("item_kind", "item_id", "p_i", F.concat(wide("key"), wide("rest")).alias("class_id"), wide("spelling").alias("spelling"))


def _salted(rows: DataFrame, by: list[str], count: str, most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with one of the blocks of its group, and with all of them: a join of both on ``by`` and ``block`` has
    every pair of rows of a group once. ``count`` is the number of rows of the group; a block holds about ``most``."""
    blocks = F.ceil(F.col(count) / most).cast("int")
    one = rows.withColumn("block", F.pmod(F.xxhash64(*(c for c in rows.columns if c not in by)), blocks).cast("int"))
    return one, rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))


def same_looking_pairs(items: DataFrame, most_per_task: int = 2000) -> DataFrame:
    """``item_kind, a_id, a_p_i, b_id, b_p_i``: items of one kind with different characters but one look.

    ``items`` holds ``item_kind, item_id, p_i, text``. Null and empty texts and texts without a visible character
    are no items. First the few spellings of each class are paired; the members of both spellings of a pair are
    joined afterwards, so that nothing is made that is not in the result: copies with the very same characters never
    meet. Groups of more than ``most_per_task`` spellings or members are spread over as many tasks as they have such
    blocks, and it is the smaller group of a pair that is repeated for the blocks of the larger. Members of one spelling
    that fill a partition are split by the skew join of adaptive execution.
    """
    keyed = checkpointed(_keyed(items))
    look = ["key", "rest"]  # they hold the kind too
    spellings = keyed.groupBy(*look, "spelling").agg(F.count(F.lit(1)).alias("n"))
    classes = spellings.groupBy(*look).agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    # Few items have a second spelling; only these go on.
    several = checkpointed(spellings.join(classes, look))
    one, every = _salted(several, look, "spellings", most_per_task)
    other = every.select(*look, "block", F.col("spelling").alias("few"), F.col("n").alias("n_few"))
    pairs = one.withColumnRenamed("spelling", "many").withColumnRenamed("n", "n_many").join(other, [*look, "block"])
    # Each pair of spellings once, the one with more members first.
    pairs = pairs.filter("n_many > n_few or (n_many = n_few and many > few)").select(*look, "many", "few", F.ceil(F.col("n_many") / most_per_task).cast("int").alias("blocks"))
    members = keyed.join(several.select(*look, "spelling"), [*look, "spelling"], "left_semi")
    many = pairs.join(members.withColumnRenamed("spelling", "many"), [*look, "many"]).select(*look, "many", "few", F.pmod(F.xxhash64("item_id", "p_i"), F.col("blocks")).cast("int").alias("block"), "item_kind", F.struct("item_id", "p_i").alias("x"))
    few = pairs.join(members.withColumnRenamed("spelling", "few"), [*look, "few"]).select(*look, "many", "few", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct("item_id", "p_i").alias("y"))
    found = many.join(few, [*look, "many", "few", "block"])
    a, b = F.least("x", "y"), F.greatest("x", "y")
    return found.select("item_kind", a["item_id"].alias("a_id"), a["p_i"].alias("a_p_i"), b["item_id"].alias("b_id"), b["p_i"].alias("b_p_i"))
