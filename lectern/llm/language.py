"""Missing or wrong language labels (problem 5).

Nearest-centroid classification. Character grams, hashed, are weighed by TF-IDF and normalised; every
language has several centroids, found by clustering its labelled segments, and those languages that are also written
with Latin letters have centroids of their romanised text. A segment takes the language of the centroid with the
highest cosine, unless the cosine is lower than nearly all of that language's own segments have: then it is rejected.

The centroids are fitted on at most ``SAMPLE_ROWS`` rows of the labelled documents; all chunks are classified.
"""

from __future__ import annotations

import unicodedata as U
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LANGUAGES
from lectern.llm.normalform import tables

#: Bounds of the labelled sample, in rows and characters of each, and of the segments of each language taken from it.
SAMPLE_ROWS, SAMPLE_CHARS, SEGMENTS_PER_LANGUAGE = 4000, 20_000, 900
CLUSTERS = 2
BUCKETS = 1 << 16
#: A segment counts as running text from this weight on: a letter weighs one, a syllable or word sign three.
LEAST_WEIGHT = 24
#: Share of a language's own segments that may be rejected, and the highest least cosine.
REJECTED, MOST_LEAST = 0.002, 0.045
#: A text is given another language than its label only when the cosine is higher by this much; a short one by more.
MARGIN, SHORT_MARGIN = 0.03, 0.06
#: Most books that are sent to the tasks as a hash table; with more, the join is shuffled.
BROADCAST_BOOKS = 100_000

# Spellings of language labels, in lower case and without region.
LABELS = {
    "ru": "ru rus russian русский",
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "uk": "uk ukr ukrainian українська",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語",
    "ja": "ja jpn japanese 日本語",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "th": "th tha thai ไทย ภาษาไทย",
}
# Ways to write Cyrillic with Latin letters; what is missing is taken from the first.
ROMAN = (
    dict(zip("абвгґдеёєжзиіїйклмнопрстуфхцчшщъыьэюя", "a b v g g d e yo ye zh z i i yi y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".split())),
    dict(zip("гёежйхцчщьэюяії", "h e e zh j h c ch sch ' e ju ja i ji".split())),
    dict(zip("жйхцчшщыюя", "ž j ch c č š šč y iu ia".split())),
)
ROMANISED = ("ru", "uk")

_STOPS = ".!?…。！？।॥．｡\n"


@lru_cache(maxsize=1)
def _maps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its folded letter (32 outside words, 0 to drop), its weight, and its part in cutting."""
    single, _ = tables()
    size = 0x34000
    fold = np.full(size, 32, np.uint32)
    weight = np.zeros(size, np.int32)
    part = np.zeros(size, np.int8)
    for code in range(size):
        if 0xD800 <= code < 0xE000:
            continue
        char = single.get(code, chr(code))
        if char == "":
            fold[code] = 0
            continue
        lower = char.lower()
        char = lower if len(lower) == 1 else char
        kind = U.category(char)[0]
        if kind == "L":
            fold[code] = ord(char)
            weight[code] = 3 if ord(char) >= 0x3040 else 1
        elif kind == "M":
            fold[code] = ord(char) if code >= 0x900 else 0
        if 0xE00 <= code < 0xF00 or 0x1000 <= code < 0x10A0 or 0x1780 <= code < 0x1800:
            part[code] = 2
        elif U.category(chr(code)) == "Zs":
            part[code] = 3
    for char in _STOPS:
        part[ord(char)] = 1
    return fold, weight, part


@dataclass
class Segments:
    """The segments of a batch: text, begin and end of each (in stored characters), and its grams with counts."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    of: np.ndarray
    gram: np.ndarray
    times: np.ndarray


def segments(texts: Sequence[str]) -> Segments:
    """Cuts texts after stops, joins what is too short to be judged, and counts hashed grams."""
    fold, weigh, part = _maps()
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    raw = np.minimum(raw, len(fold) - 1)
    total = len(raw)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    kind = part[raw]
    begins = np.zeros(total + 1, bool)
    begins[offset[:-1][sizes > 0]] = True
    if total:
        begins[1:total] |= (kind[:-1] == 1) & (kind[1:] != 1)
        begins[2:total] |= (kind[1:-1] == 3) & (kind[:-2] == 2) & (kind[2:] != 3)
    starts = np.flatnonzero(begins[:total])
    heavy = np.add.reduceat(weigh[raw], starts) if len(starts) else np.zeros(0, np.int64)
    kept, held, last = [], 0, -1
    for k, (w, t) in enumerate(zip(heavy.tolist(), owner[starts].tolist() if len(starts) else [])):
        if t != last:
            kept.append(k)
            held, last = w, t
        elif w >= LEAST_WEIGHT and held >= LEAST_WEIGHT:
            kept.append(k)
            held = w
        else:
            held += w
    first = starts[kept] if kept else np.zeros(0, np.int64)
    weight = np.add.reduceat(heavy, kept) if kept else np.zeros(0, np.int64)
    number = np.zeros(total, np.int64)
    number[first[1:]] = 1
    number = np.cumsum(number)
    letters = fold[raw]
    keep = letters != 0
    letters, number = letters[keep], number[keep]
    # A space at both ends of a segment, and one for every run of other signs.
    if len(letters):
        change = np.flatnonzero(number[1:] != number[:-1]) + 1
        at = np.concatenate([[0], change, change, [len(letters)]])
        who = np.concatenate([[number[0]], number[change - 1], number[change], [number[-1]]])
        order = np.argsort(at, kind="stable")
        letters, number = np.insert(letters, at[order], 32), np.insert(number, at[order], who[order])
        single = np.ones(len(letters), bool)
        single[1:] = ~((letters[1:] == 32) & (letters[:-1] == 32) & (number[1:] == number[:-1]))
        letters, number = letters[single].astype(np.uint64), number[single]
    half, keys = np.uint64(BUCKETS // 2 - 1), []
    if len(letters) > 3:
        # Bigrams of syllable and word signs and trigrams share one half of the buckets, 4-grams have the other.
        sign = letters >= np.uint64(0x3040)
        two = letters[:-1] * np.uint64(0x9E3779B1) + letters[1:] * np.uint64(0x85EBCA77C2B2AE63)
        three = two[:-1] + letters[2:] * np.uint64(0x27D4EB2F165667C5)
        four = three[:-1] * np.uint64(0x9FB21C651E98DF25) + letters[3:]
        for value, used, high in (
            (two, (number[:-1] == number[1:]) & sign[:-1] & sign[1:], 0),
            (three, number[:-2] == number[2:], 0),
            (four, (number[:-3] == number[3:]) & ~sign[:-3] & ~sign[3:], BUCKETS // 2),
        ):
            value = value[used]
            mixed = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(37) & half
            keys.append(number[: len(used)][used] * BUCKETS + high + mixed.astype(np.int64))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([edge, [len(key)]])).astype(np.float32)
    key = key[edge]
    base = offset[owner[first]] if len(first) else first
    end = np.concatenate([first[1:], [total]]) if len(first) else first
    return Segments(owner[first] if len(first) else first, first - base, end - base, weight, key // BUCKETS, key % BUCKETS, times)


@dataclass
class Model:
    """Centroids (centroids x BUCKETS, weighed by idf), their languages, idf and the least cosine of each language."""

    centroids: np.ndarray
    language: list[str]
    idf: np.ndarray
    least: dict[str, float]

    def cosines(self, found: Segments, count: int) -> np.ndarray:
        """Cosine of each of ``count`` segments with the nearest centroid of each language."""
        width = self.centroids.shape[0]
        sums, norm = np.zeros((count, width), np.float32), np.zeros(count, np.float32)
        used = np.flatnonzero(np.concatenate([[True], found.of[1:] != found.of[:-1]])) if len(found.of) else np.zeros(0, np.int64)
        rows = found.of[used]
        if len(rows):
            norm[rows] = np.add.reduceat((found.times * self.idf[found.gram]) ** 2, used)
            for k in range(width):
                sums[rows, k] = np.add.reduceat(self.centroids[k][found.gram] * found.times, used)
        sums /= np.maximum(np.sqrt(norm), 1e-9)[:, None]
        return np.stack([sums[:, [k for k, x in enumerate(self.language) if x == code]].max(1) for code in LANGUAGES], 1)


def romanised(text: str, way: int) -> str:
    table = ROMAN[0] | ROMAN[way]
    return "".join(table.get(c, c) for c in text.lower()).replace("_", "")


def _clustered(found: Segments, members: np.ndarray, idf: np.ndarray, clusters: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of the segments ``members``; the rows are unit centroids."""
    slot = np.full(int(found.of.max(initial=-1)) + 1, -1)
    slot[members] = np.arange(len(members))
    mine = np.flatnonzero(slot[found.of] >= 0)
    of, gram = slot[found.of[mine]], found.gram[mine]
    value = found.times[mine] * idf[gram]
    norm = np.sqrt(np.bincount(of, value**2, len(members)))
    value = value / np.maximum(norm, 1e-9)[of]
    clusters = max(1, min(clusters, len(members) // 8))
    belongs = np.arange(len(members)) * clusters // max(1, len(members))
    for _ in range(rounds):
        centroid = np.bincount(belongs[of] * BUCKETS + gram, value, clusters * BUCKETS).reshape(clusters, BUCKETS)
        centroid /= np.maximum(np.linalg.norm(centroid, axis=1, keepdims=True), 1e-9)
        near = np.stack([np.bincount(of, value * centroid[c][gram], len(members)) for c in range(clusters)], 1)
        belongs = near.argmax(1)
    return centroid[np.linalg.norm(centroid, axis=1) > 0.5]


def _gathered(texts: Sequence[str], most: int) -> Segments:
    """Segments of running text from texts in a fixed mixed order, block by block until there are ``most``."""
    parts: list[Segments] = []
    count = 0
    texts = sorted(texts, key=lambda t: (zlib.crc32(t.encode("utf-8", "replace")), t))
    for a in range(0, len(texts), 20):
        if count >= most:
            break
        found = segments(texts[a : a + 20])
        fair = found.weight >= LEAST_WEIGHT
        number = np.where(fair, count + np.cumsum(fair) - 1, -1)
        used = fair[found.of]
        parts.append(Segments(found.text[fair], found.begin[fair], found.end[fair], found.weight[fair], number[found.of[used]], found.gram[used].astype(np.int32), found.times[used]))
        count += int(fair.sum())
    joined = [np.concatenate([getattr(p, f.name) for p in parts]) if parts else np.zeros(0, np.int64) for f in fields(Segments)]
    return Segments(*joined)


def fit(rows: Sequence[tuple[str, str]]) -> Model:
    """``rows``: (language, text). Languages without a row have no centroid and are never found."""
    groups: dict[str, list[str]] = {}
    for code, text in rows:
        if code in LANGUAGES and text:
            groups.setdefault(code, []).append(text)
    for code in ROMANISED:
        for way in range(len(ROMAN)):
            own = groups.get(code, [])[way :: len(ROMAN)]
            if own:
                groups[f"{code}-{way}"] = [romanised(text, way) for text in own]
    gathered, group, base = [], [], 0
    for name in sorted(groups):
        part = _gathered(groups[name], SEGMENTS_PER_LANGUAGE)
        part.of = part.of + base
        base += len(part.text)
        group += [name] * len(part.text)
        gathered.append(part)
    found = Segments(*(np.concatenate([getattr(p, f.name) for p in gathered]) if gathered else np.zeros(0, np.int64) for f in fields(Segments)))
    group, count = np.array(group, dtype=object), base
    frequency = np.bincount(found.gram, minlength=BUCKETS)
    idf = np.log((1 + count) / (1 + frequency)).astype(np.float32)
    names = sorted(set(group.tolist()))
    members = {g: np.flatnonzero(group == g)[:SEGMENTS_PER_LANGUAGE] for g in names}
    for attempt in range(2):
        centroids, language = [], []
        for g in names:
            if len(members[g]):
                part = _clustered(found, members[g], idf, CLUSTERS)
                centroids.append(part)
                language += [g.split("-")[0]] * part.shape[0]
        if not centroids:
            return Model(np.zeros((len(LANGUAGES), BUCKETS), np.float32), list(LANGUAGES), idf, dict.fromkeys(LANGUAGES, 2.0))
        for code in LANGUAGES:
            if code not in language:
                centroids.append(np.zeros((1, BUCKETS)))
                language.append(code)
        model = Model((np.concatenate(centroids) * idf).astype(np.float32), language, idf, {})
        near = model.cosines(found, count)
        best = near.argmax(1)
        # Segments of a labelled document that are in another language are left out of the second fit.
        members = {g: m[[LANGUAGES[b] == g.split("-")[0] for b in best[m]]] for g, m in members.items()}
    for k, code in enumerate(LANGUAGES):
        own = np.concatenate([near[members[g], k] for g in names if g.split("-")[0] == code] or [np.zeros(0)])
        model.least[code] = min(MOST_LEAST, 0.8 * float(np.quantile(own, REJECTED))) if len(own) else 2.0
    return model


def label_code(label: Column) -> Column:
    """The code of the language that a label names, in any spelling; null for fillers and unknown names."""
    bare = F.lower(F.regexp_extract(F.trim(label), "^[^-_]+", 0))
    spellings = F.create_map(*(F.lit(x) for code, words in LABELS.items() for w in words.split() for x in (w, code)))
    return F.try_element_at(spellings, bare)


def labelled_sample(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """The ``rows`` labelled documents of at most ``chars`` characters with the least hash of their id: at most
    ``rows * chars`` characters reach the driver, and the sample does not depend on files or their order."""
    code, hashed = label_code(F.col("lang")), F.xxhash64("doc_id")
    known = documents.filter(code.isNotNull())
    # Hashes up to here hold about twice the rows that are wanted, so that no more are sorted and sent.
    share = 2 * rows / max(1, known.count())
    most = (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)
    sample = known.filter((hashed <= most) & F.length("text").between(1, chars)).select(hashed.alias("h"), "doc_id", code.alias("code"), "text").orderBy("h", "doc_id", "text").limit(rows)
    return [(r["code"], r["text"]) for r in sample.select("code", "text").collect()]


def judge(model: Model, texts: Sequence[str]) -> tuple[Segments, list[str | None], np.ndarray, np.ndarray]:
    """The segments, the language of each (null where rejected), its confidence, and all cosines."""
    found = segments(texts)
    count = len(found.text)
    near = model.cosines(found, count)
    order = np.argsort(-near, 1)
    rows = np.arange(count)
    best, second = near[rows, order[:, 0]], near[rows, order[:, 1]]
    confidence = np.where(best > 0, best / np.maximum(best + second, 1e-9), 0.0)
    codes = [LANGUAGES[k] if b >= model.least[LANGUAGES[k]] and b > 0 else None for k, b in zip(order[:, 0].tolist(), best.tolist())]
    return found, codes, confidence, near


_SCHEMA = "chunk_id long, book_id long, label string, seg_i int, seg_start int, seg_end int, weight long, lang string, confidence double, cosine double, cosines array<float>"


def _judged(model: Model):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                found, codes, confidence, near = judge(model, batch.column("text").to_pylist())
                take = batch.select(["chunk_id", "book_id", "label"]).take(pa.array(found.text, pa.int64()))
                number = np.arange(len(found.text)) - np.searchsorted(found.text, found.text)
                cosines = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [*take.columns, pa.array(number, pa.int32()), pa.array(found.begin, pa.int32()), pa.array(found.end, pa.int32()), pa.array(found.weight, pa.int64()), pa.array(codes, pa.string()), pa.array(confidence, pa.float64()), pa.array(near.max(1) if len(near) else confidence, pa.float64()), cosines],
                    names=[x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return run


def segment_languages(chunks: DataFrame, model: Model) -> DataFrame:
    """``chunk_id, book_id, label, seg_i, seg_start, seg_end, weight, lang, confidence, cosine, cosines`` for every segment.

    ``label`` is the code that ``chunks.lang`` names, if any. ``lang`` is null where the segment is rejected. Null and
    empty texts have no segment. Offsets count characters of the stored text.
    """
    broadcast = chunks.sparkSession.sparkContext.broadcast(model)
    prepared = chunks.filter(F.length("text") > 0).select("chunk_id", "book_id", label_code(F.col("lang")).alias("label"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _judged(broadcast.value)(batches)

    return prepared.mapInArrow(run, _SCHEMA)


def chunk_languages(chunks: DataFrame, judged: DataFrame) -> DataFrame:
    """``chunk_id, lang, confidence``: one row for each chunk, from the cosines of its segments summed by weight.

    Rejected segments do not count. Chunks without text and those of which every segment is rejected have a null
    language and confidence 0.
    """
    weight = F.greatest(F.col("weight"), F.lit(1))
    sums = judged.filter("lang is not null").groupBy("chunk_id").agg(F.array(*(F.sum(weight * F.col("cosines")[k].cast("double")) for k in range(len(LANGUAGES)))).alias("sums"))
    best, second = F.array_max("sums"), F.sort_array("sums", asc=False)[1]
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position("sums", best).cast("int"))
    found = sums.select("chunk_id", lang.alias("lang"), (best / F.greatest(best + second, F.lit(1e-9))).alias("confidence"))
    return chunks.select("chunk_id").join(found, "chunk_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def with_book_label(judged: DataFrame, books: DataFrame) -> DataFrame:
    """Fills missing labels with the language of the book, where that names one."""
    of_books = books.select("book_id", label_code(F.col("language")).alias("book_label")).filter("book_label is not null").dropDuplicates(["book_id"])
    small = books.count() <= BROADCAST_BOOKS
    return judged.join(F.broadcast(of_books) if small else of_books, "book_id", "left").withColumn("label", F.coalesce("label", "book_label")).drop("book_label")


def mislabelled(judged: DataFrame) -> DataFrame:
    """``chunk_id, lang``: languages of running text in a chunk other than that of its label (see TESTDATA.md)."""
    position = F.create_map(*(F.lit(x) for k, code in enumerate(LANGUAGES) for x in (code, k)))
    labelled = F.when(F.col("label").isNotNull(), F.element_at("cosines", F.try_element_at(position, F.col("label")) + 1))
    short = F.col("weight") < LEAST_WEIGHT
    apart = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    sure = F.col("label").isNull() | (F.col("cosine") - labelled >= F.when(short, SHORT_MARGIN).otherwise(MARGIN))
    return judged.filter(F.col("lang").isNotNull() & apart & sure).select("chunk_id", "lang").distinct()
