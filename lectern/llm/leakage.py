"""Evaluation texts leaking into training text (problem 7).

A prefix-filtered set join. Texts are reduced to their letters, digits and vowel signs in the comparison form of
problem 3. Of every item, grams at a fixed stride are its shingles; the stride is such that every unbroken run of
``MIN_RUN`` characters holds one. Documents are matched at all positions against the shingles of a block of items of
bounded size. The shingles of an item are ordered by their rarity in the whole corpus; a document that covers enough
of the item holds at least t of its n shingles, so it holds one of the n - t + 1 rarest: only those are joined. The
number of shingles held (length bound) and the offset between both texts (positional bound) are applied next, and the
item-sized windows of the corpus at these offsets are compared character by character.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed
from lectern.llm.normalform import DROPPED, LAST, blocks_of, code_tables, codes_of, comparison_form

#: Characters of an unbroken run, and the share of the item that such runs must cover.
MIN_RUN, LEAST_COVER = 60, (2, 5)
GRAM = 40
STRIDE = MIN_RUN - GRAM + 1
#: Most items of one pass over the corpus, and most letters of them together unless one item has more. Both bound what
#: is sent to every task: the letters and their shingles.
ITEMS_PER_BLOCK, LETTERS_PER_BLOCK = 4000, 8_000_000
#: Candidates are sent to the documents as a hash table up to this many bytes; beyond, the documents are shuffled.
BROADCAST_BYTES = 32 << 20
#: A shingle of more items than this is shared: it is joined only where an item cannot be found without it.
SHARED_BY = 8
#: Characters hashed at a time.
BLOCK_CHARS = 1 << 20

# Letters whose capitals look alike though they themselves do not.
CAPITAL_TWINS = ("вкмнтηικμτυχ", "bkmhthikmtyx")
_MARKUP = re.compile("</?[A-Za-z][^<>]{0,200}>|&#?[A-Za-z0-9]{1,8};")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For each code point of a comparison form its letter without case, ``DROPPED`` for what does not count."""
    twins = dict(zip(*CAPITAL_TWINS))
    out = np.full(LAST + 1, DROPPED, np.uint32)
    for code in range(0x34000):
        char = chr(code)
        if U.category(char)[0] in "LNM":
            lower = char.lower()
            char = lower if len(lower) == 1 else char
            out[code] = ord(twins.get(char, char))
    return out


@lru_cache(maxsize=1)
def _direct_table() -> np.ndarray:
    form, _ = code_tables()
    return _letter_table()[np.minimum(form, LAST)]


def letter_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters, digits and vowel signs of all texts in their comparison form and without case, markup left out, and
    where each text begins, with the end of the last."""
    texts = [(_MARKUP.sub(" ", t) if "<" in t or "&" in t else t).replace("…", ".") for t in texts]
    raw, at = codes_of(texts)
    raw = np.minimum(raw, LAST)
    unstable = np.concatenate([[0], np.cumsum(code_tables()[1][raw])])[at]
    mapped = _direct_table()[raw]
    kept = mapped != DROPPED
    place = np.concatenate([[0], np.cumsum(kept)])[at]
    mapped = mapped[kept]
    slow = np.flatnonzero(unstable[1:] != unstable[:-1]).tolist()
    if slow:
        parts = [mapped[a:b] for a, b in zip(place.tolist(), place[1:].tolist())]
        for k in slow:
            found = _letter_table()[np.minimum(codes_of([comparison_form(texts[k])])[0], LAST)]
            parts[k] = found[found != DROPPED]
        mapped = np.concatenate(parts)
        place = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return mapped, place.astype(np.int64)


def _powers(size: int, base: np.uint64) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWER, _UNDO = _powers(BLOCK_CHARS + GRAM, _BASE), _powers(BLOCK_CHARS + GRAM, _INVERSE)


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """Hashes of all grams of at most ``BLOCK_CHARS + GRAM - 1`` characters; equal grams have equal hashes."""
    if len(chars) < GRAM:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _POWER[: len(chars)], out=sums[1:])
    return (sums[GRAM:] - sums[:-GRAM]) * _UNDO[: len(chars) - GRAM + 1]


def hashed(chars: np.ndarray) -> np.ndarray:
    """:func:`gram_hashes` of any number of characters."""
    return np.concatenate([gram_hashes(chars[a : a + BLOCK_CHARS + GRAM - 1]) for a in range(0, max(1, len(chars) - GRAM + 1), BLOCK_CHARS)])


def item_shingles(letters: np.ndarray) -> list[tuple[int, int]]:
    """``(position, hash)`` of the shingles of an item; an item shorter than a run has none and is never found."""
    if len(letters) < MIN_RUN:
        return []
    return list(zip(range(0, len(letters) - GRAM + 1, STRIDE), hashed(letters)[::STRIDE].view(np.int64).tolist()))


def needed(length: int) -> int:
    """Least number of shingles in a document that covers ``length`` characters of an item: a run with m of them is
    shorter than MIN_RUN + m * STRIDE."""
    return max(1, -(-length // (MIN_RUN - 1 + STRIDE)))


def least_cover(length: int) -> int:
    """Characters of an item of this length that must be covered."""
    up, down = LEAST_COVER
    return -(-length * up // down)


def prefix_room(length: int, positions: Sequence[int], shared: Sequence[bool]) -> tuple[int, bool]:
    """How many shingles of an item a document may lack, and whether only those not shared count.

    Shared shingles, those of a prompt that a whole suite opens with, say little and stand in many documents. Runs that
    hold no other shingle cover no more than the shared ones and a stride on both sides of them. Where that is less
    than must be covered, a document holds enough of the other shingles for the rest, and only they are joined.
    """
    must, marks = least_cover(length), np.zeros(length, bool)
    for p, s in zip(positions, shared):
        if s:
            marks[max(0, p - STRIDE + 1) : p + GRAM + STRIDE - 1] = True
    alone = int(marks.sum())
    own = sum(not s for s in shared)
    if alone < must and own < len(positions):
        return own - needed(must - alone), True
    return len(positions) - needed(must), False


def _hits(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        flags = np.zeros(1 << 20, bool)
        flags[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            every = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for places, block in blocks_of(batch.column("text").to_pylist()):
                letters, at = letter_codes(block)
                hashes = hashed(letters)
                where = np.flatnonzero(flags[(hashes >> np.uint64(44)).astype(np.int64)])
                found = hashes[where]
                same = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
                where, found = where[same], found[same]
                document = np.searchsorted(at, where, side="right") - 1
                inside = where + GRAM <= at[document + 1]  # grams that begin in one text and end in the next are none
                where, found, document = where[inside], found[inside], document[inside]
                if len(where):
                    yield pa.RecordBatch.from_arrays([pa.array(every[np.array(places)[document]], pa.int64()), pa.array(found.view(np.int64)), pa.array(where - at[document])], names=["doc_id", "gram", "d_pos"])

    return run


def covered(item: np.ndarray, document: np.ndarray, offsets: list[int]) -> int:
    """Characters of the item in runs of at least ``MIN_RUN`` that stand in the document at one of the offsets."""
    marks = np.zeros(len(item) + 1, np.int64)
    for offset in offsets:
        low, high = max(0, -offset), min(len(item), len(document) - offset)
        if high - low < MIN_RUN:
            continue
        same = np.zeros(high - low + 2, np.int8)
        same[1:-1] = item[low:high] == document[low + offset : high + offset]
        change = np.diff(same)
        begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        for a, b in zip(begins, ends):
            if b - a >= MIN_RUN:
                marks[low + a] += 1
                marks[low + b] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _verified(known):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = known.value
        up, down = LEAST_COVER
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc_id, text, candidates in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "candidates"))):
                document = letter_codes([text])[0]
                for candidate in candidates:
                    item = letters[candidate["item_id"]]
                    n = covered(item, document, candidate["offsets"])
                    if n * down >= len(item) * up:
                        out.append((doc_id, candidate["item_id"], n, len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=["doc_id", "item_id", "covered", "item_chars"])

    return run


def _shingle_rows(items: dict[int, np.ndarray]) -> list[tuple[int, int, int, bool, int, bool, int]]:
    """``item_id, a_pos, gram, shared, room, own_only, needed`` of the shingles of all items of a block."""
    of = {item_id: item_shingles(letters) for item_id, letters in items.items()}
    holders: dict[int, int] = {}
    for shingles in of.values():
        for gram in {h for _, h in shingles}:
            holders[gram] = holders.get(gram, 0) + 1
    rows = []
    for item_id, shingles in of.items():
        shared = [holders[h] > SHARED_BY for _, h in shingles]
        size = len(items[item_id])
        room, own_only = prefix_room(size, [p for p, _ in shingles], shared) if shingles else (0, False)
        rows += [(item_id, p, h, s, room, own_only, needed(least_cover(size))) for (p, h), s in zip(shingles, shared)]
    return rows


def _block(documents: DataFrame, items: dict[int, np.ndarray]) -> DataFrame | None:
    spark = documents.sparkSession
    shingles = _shingle_rows(items)
    if not shingles:
        return None
    known = spark.sparkContext.broadcast(np.unique(np.array([h for _, _, h, *_ in shingles], np.int64).view(np.uint64)))
    letters = spark.sparkContext.broadcast(items)
    # No larger than a block of items: at most a shingle for every STRIDE of its letters.
    of_items = F.broadcast(spark.createDataFrame(shingles, "item_id long, a_pos int, gram long, shared boolean, room int, own_only boolean, needed int"))
    hits = checkpointed(documents.mapInArrow(_hits(known), "doc_id long, gram long, d_pos long"))
    frequency = hits.groupBy("gram").count()
    by_rarity = W.partitionBy("item_id").orderBy(F.coalesce("count", F.lit(0)), "a_pos")
    candidates_of = of_items.filter("not (shared and own_only)").join(frequency, "gram", "left")
    prefix = candidates_of.withColumn("nth", F.row_number().over(by_rarity)).filter("nth <= room + 1").select("item_id", "gram")
    # The items of a prefix are sent to the documents, so a shingle that stands in many of them is not one task.
    paired = hits.select("doc_id", "gram").distinct().join(F.broadcast(prefix), "gram").select("doc_id", "item_id").distinct()
    # Only the pairs found meet all shingles of their item, by document and shingle.
    wanted = paired.join(of_items.select("item_id", "a_pos", "gram", "needed"), "item_id")
    placed = wanted.join(hits, ["doc_id", "gram"])
    offsets = placed.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("d_pos") - F.col("a_pos")).alias("offsets"), F.count_distinct("a_pos").alias("held"), F.max("needed").alias("needed"))
    candidates = checkpointed(offsets.filter("held >= needed").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "offsets")).alias("candidates")))
    each = F.aggregate("candidates", F.lit(64), lambda n, c: n + 32 + 8 * F.size(c["offsets"]))
    size = candidates.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    chosen = documents.join(F.broadcast(candidates) if size <= BROADCAST_BYTES else candidates, "doc_id")
    return chosen.select("doc_id", "text", "candidates").mapInArrow(_verified(letters), "doc_id long, item_id long, covered long, item_chars long")


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id, covered, item_chars``: the documents that hold enough of an item.

    ``documents``: ``doc_id, text``; ``eval_items``: ``item_id, text``. Null and empty texts match nothing, nor do
    items of fewer than ``MIN_RUN`` letters. A document that stands twice under different ids is found twice; a
    repeated id gives a row for each of its rows.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text").filter("text <> ''")
    items = eval_items.select("item_id", "text").filter("text <> ''")
    sizes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-sizes[0] // ITEMS_PER_BLOCK), -(-sizes[1] // LETTERS_PER_BLOCK))
    found = []
    for k in range(blocks):
        mine = (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)).collect()
        letters, at = letter_codes([r["text"] for r in mine])
        part = _block(documents, {r["item_id"]: letters[a:b] for r, a, b in zip(mine, at[:-1], at[1:])})
        if part is not None:
            found.append(part)
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, covered long, item_chars long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
