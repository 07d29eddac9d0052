"""Splitting oversized items at natural boundaries (problem 2).

The strength of a cut after each character is indexed with a sparse table of range maxima. From the start of a piece
the strongest cut within the permissible lengths is asked for, ties broken rightward, then the next piece starts back
by the overlap, moved forward to the start of a word where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.sentences import sentence_starts

#: Strengths of a cut: inside a grapheme, between any characters, after a word, clause, sentence, line, paragraph.
NONE, ANY, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
NAMES = ("inside", "character", "word", "clause", "sentence", "line", "paragraph")
#: Where the last piece ends that does not end a paragraph.
ITEM_END = "item"
#: A piece is at least this share of max_chars long, so that an early strong boundary makes no tiny piece.
LEAST_SHARE = 0.5

#: A character as readers see it, with its marks, joined signs and modifiers.
_GRAPHEME = regex.compile(r"\X")
_WORD_END = re.compile(r"\s+")
_CLAUSE_END = re.compile(r"[,;:，、；：—–](?:[\"'”’»)\]」』）]*)\s*")
_LINE_END = re.compile(r"[^\S\n]*\n\s*")


def boundary_strengths(text: str) -> np.ndarray:
    """``out[i]``: the strength of a cut between the characters i - 1 and i."""
    size = len(text)
    out = np.full(size + 1, NONE, np.int8)
    out[[match.start() for match in _GRAPHEME.finditer(text)]] = ANY
    for match in _WORD_END.finditer(text):
        out[match.end()] = WORD
    for match in _CLAUSE_END.finditer(text):
        if not (match.end() < size and match.end() - match.start() == 1 and text[match.end()].isdigit()):
            out[match.end()] = max(CLAUSE, out[match.end()])
    for start in sentence_starts(text):
        out[start] = SENTENCE
    for match in _LINE_END.finditer(text):
        out[match.end()] = PARAGRAPH if match[0].count("\n") > 1 else LINE
    out[size] = PARAGRAPH
    return out


class RangeMaximum:
    """Sparse table: the place of the rightmost maximum of any range in two look-ups."""

    def __init__(self, values: np.ndarray) -> None:
        size = len(values)
        self.size = size
        # A value and its place in one number, so that equal strengths prefer the place further right.
        level = values.astype(np.int64) * (size + 1) + np.arange(size)
        self.levels = [level]
        width = 1
        while 2 * width <= size:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def rightmost(self, low: int, high: int) -> int:
        """The place of the maximum in ``low..high``, both included."""
        k = (high - low + 1).bit_length() - 1
        return int(max(self.levels[k][low], self.levels[k][high - (1 << k) + 1]) % (self.size + 1))


def cut(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces: none longer than ``max_chars``, together the whole text, in order.

    Consecutive pieces share at most ``overlap_chars`` characters. A text within the limit is one piece, an empty
    one has none. Combining characters stay with their letter unless a letter alone exceeds the limit.
    """
    if max_chars < 1 or not 0 <= overlap_chars < max_chars:
        raise ValueError("max_chars must be positive and overlap_chars less than it")
    size = len(text)
    if size <= max_chars:
        return [(0, size)] if size else []
    strengths = boundary_strengths(text)
    index = RangeMaximum(strengths)
    out: list[tuple[int, int]] = []
    start = 0
    while True:
        if size - start <= max_chars:
            out.append((start, size))
            return out
        covered = out[-1][1] if out else 0
        low = max(start + max(1, int(max_chars * LEAST_SHARE)), covered + 1)
        end = index.rightmost(min(low, start + max_chars), start + max_chars)
        out.append((start, end))
        back = max(end - overlap_chars, start + 1)
        begin = back
        while begin < end and strengths[begin] < WORD:
            begin += 1
        if begin == end and overlap_chars and strengths[end] < WORD:
            # No word starts here, as in scripts without spaces: any character that begins a grapheme.
            begin = back
            while begin < end and strengths[begin] == NONE:
                begin += 1
        start = begin


def _pieces(max_chars: dict[str, int], overlap: dict[str, int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, starts, ends, texts, counts, names = [], [], [], [], [], [], []
            for k, (kind, text, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item_kind", "text", "ends_paragraph")))):
                found = cut(text, max_chars[kind], overlap[kind])
                strengths = boundary_strengths(text)
                names += [NAMES[strengths[b]] for _, b in found[:-1]] + [NAMES[PARAGRAPH] if whole else ITEM_END]
                for n, (a, b) in enumerate(found):
                    rows.append(k)
                    number.append(n)
                    starts.append(a)
                    ends.append(b)
                    texts.append(text[a:b])
                    counts.append(len(found))
            kept = batch.select(["item_kind", "item_id", "p_i"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *(pa.array(x, pa.int32()) for x in (number, starts, ends, counts)), pa.array(names, pa.string()), pa.array(texts, pa.string())],
                names=["item_kind", "item_id", "p_i", "piece_i", "start", "end", "n_pieces", "cut_at", "piece"],
            )

    return run


def split_items(items: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """``item_kind, item_id, p_i, piece_i, start, end, n_pieces, cut_at, piece`` for the items of the kinds in ``limits``.

    ``cut_at`` names the boundary at the end of the piece. The last piece ends a ``paragraph`` where the column
    ``ends_paragraph`` of its item is true (``is_paragraph_end`` of a chunk), else it ends only the ``item``; so do
    those of items without that column or with null in it. ``limits``: kind to (max_chars, overlap_chars). Items within their limit are one piece and never leave the JVM.
    Null and empty texts have no piece. Kinds without a limit are left out.
    """
    whole = F.coalesce("ends_paragraph", F.lit(False)) if "ends_paragraph" in items.columns else F.lit(False)
    known = items.select("item_kind", "item_id", "p_i", "text", whole.alias("ends_paragraph")).filter(F.col("text") != "").filter(F.col("item_kind").isin(*limits))
    most = F.lit(0)
    for kind, (limit, _) in limits.items():
        most = F.when(F.col("item_kind") == kind, limit).otherwise(most)
    size = F.length("text")
    short = known.filter(size <= most).select("item_kind", "item_id", "p_i", F.lit(0).alias("piece_i"), F.lit(0).alias("start"), size.alias("end"), F.lit(1).alias("n_pieces"), F.when(F.col("ends_paragraph"), NAMES[PARAGRAPH]).otherwise(ITEM_END).alias("cut_at"), F.col("text").alias("piece"))
    schema = "item_kind string, item_id long, p_i int, piece_i int, start int, end int, n_pieces int, cut_at string, piece string"
    long = known.filter(size > most).mapInArrow(_pieces({k: v[0] for k, v in limits.items()}, {k: v[1] for k, v in limits.items()}), schema)
    return short.unionByName(long)
