"""Repetition inside a single document (problem 1).

A text becomes a sequence of units: words, or characters in scripts written without spaces. A linear-chain
conditional random field labels each unit as content or as repeated boilerplate; Viterbi decoding finds the best
labelling of every text, and the share of letters labelled content decides whether the text is kept.

Of a unit the field observes whether it stood earlier by itself, whether its whole line did, and whether it begins a
line. Of the join between a unit and the one before it, it observes whether some wording (two words, or four
characters) across it stood earlier. Neither says what a unit is: the first of two repeated words has no join to what
comes before it, a common word stands everywhere, and a wording said again with one word changed is repeated on both
sides of that word. Labels follow from the joins on both sides through the transitions. The weights are fitted here
by gradient ascent on made-up texts in which passages were planted; the gold labels say where they were planted and
know nothing of the observations. They depend on no table and are the same everywhere.

Everything is computed for all texts of a batch at once.
"""

from __future__ import annotations

import random
import re
import unicodedata as U
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A wording weighs this much: a word counts two, a character of a script without spaces one.
LEAST_WEIGHT = 4
#: A text is repetitive when at least this share of its letters is labelled repeated.
REPEATED_SHARE = (1, 3)
TRAINING_TEXTS, TRAINING_STEPS = 300, 200
#: Texts that are labelled together.
ROWS_AT_ONCE = 4000

_SPACELESS = "฀-໿က-႟ក-៓々぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"


@lru_cache(maxsize=1)
def _units_pattern() -> re.Pattern:
    marks: list[list[int]] = []
    for code in range(0x300, 0xE00):
        if U.category(chr(code))[0] == "M":
            if marks and code == marks[-1][1] + 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
    inner = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in marks)
    return re.compile(f"[{_SPACELESS}]+|(?:[^\\W\\d_{_SPACELESS}][{inner}]*)+")


_DIGITS_OF_SPACELESS = re.compile("[ฯ฿ๆ๏-๛໐-໙၀-၏・぀゗-゜゠]")


def units_of(text: str) -> list[tuple[str, int]]:
    """``(unit, weight)`` of all letters of a text, in order. Case, digits, punctuation and breaks do not count."""
    out: list[tuple[str, int]] = []
    for run in _units_pattern().findall(text.lower()):
        if run[0] >= "฀" and _is_spaceless(run[0]):
            out.extend((char, 1) for char in _DIGITS_OF_SPACELESS.sub("", run))
        else:
            out.append((run, 2))
    return out


_IS_SPACELESS = re.compile(f"[{_SPACELESS}]")


def _is_spaceless(char: str) -> bool:
    return _IS_SPACELESS.match(char) is not None


@dataclass
class Sequences:
    """The units of many texts, one after the other: the text, line, letters and weight of each, and its number as a
    word, and what is observed of it (``seen``: bits of a unit) and of its join to the unit before it (``joined``)."""

    of: np.ndarray
    letters: np.ndarray
    seen: np.ndarray
    joined: np.ndarray


def _again(*keys: np.ndarray) -> np.ndarray:
    """Which rows of equal keys are not the first of them."""
    return pd.DataFrame(dict(enumerate(keys))).duplicated().to_numpy() if len(keys[0]) else np.zeros(0, bool)


def observe(texts: Sequence[Sequence[Sequence[tuple[str, int]]]]) -> Sequences:
    """``texts``: of each text its lines, of each line its units with their weights."""
    units = [u for text in texts for line in text for u in line]
    of = np.repeat(np.arange(len(texts)), [sum(map(len, text)) for text in texts]).astype(np.int64)
    sizes = [len(line) for text in texts for line in text]
    line = np.repeat(np.arange(len(sizes)), sizes)
    word = pd.factorize(np.array([u for u, _ in units], dtype=object))[0].astype(np.int64)
    weight = np.array([w for _, w in units], np.int64)
    letters = np.array([len(u) for u, _ in units], np.int64)
    return _observed(of, line, word, weight, letters)


def _observed(of: np.ndarray, line: np.ndarray, word: np.ndarray, weight: np.ndarray, letters: np.ndarray) -> Sequences:
    size = len(of)
    # A wording begins at each unit and goes on until it weighs enough; it is two to four units long.
    width = np.zeros(size, np.int64)
    total = weight.copy()
    at = np.arange(size)
    for n in range(1, LEAST_WEIGHT):
        nxt = np.minimum(at + n, max(size - 1, 0))
        width[(width == 0) & (total >= LEAST_WEIGHT)] = n
        total = total + weight[nxt]
    width[(width == 0) & (total >= LEAST_WEIGHT)] = LEAST_WEIGHT
    last = at + width - 1
    whole = (width > 1) & (last < size)
    whole[whole] = of[last[whole]] == of[whole]
    begin = np.flatnonzero(whole)
    parts = [np.where(width[begin] > n, word[np.minimum(begin + n, size - 1)], -1) for n in range(LEAST_WEIGHT)]
    known = begin[_again(of[begin], *parts)]
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, known + 1, 1)
    np.add.at(change, last[known] + 1, -1)
    joined = np.cumsum(change[:size]) > 0
    # Lines are equal when their units are; the sums of mixed numbers stand for them.
    alone = _again(of, word)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if size else at
    mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    place = at - np.repeat(first, np.diff(np.concatenate([first, [size]]))) if size else at
    mixed = (mixed ^ (mixed >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sums = np.add.reduceat(mixed, first) if size else mixed
    line_again = np.repeat(_again(of[first], sums, np.diff(np.concatenate([first, [size]]))), np.diff(np.concatenate([first, [size]]))) if size else alone
    begins = np.zeros(size, bool)
    begins[first] = True
    return Sequences(of, letters, alone + 2 * line_again + 4 * begins, joined.astype(np.int64))


_BITS = np.array([[1, k & 1, k >> 1 & 1, k >> 2 & 1] for k in range(8)], float)


@dataclass
class Crf:
    """A linear-chain field with two labels, 0 content and 1 repeated. ``state[label, bit]``; ``transition[join, from, to]``."""

    state: np.ndarray
    transition: np.ndarray

    def scores(self) -> np.ndarray:
        """Of each observation of a unit (8) and label (2)."""
        return _BITS @ self.state.T

    def decode(self, found: Sequences) -> np.ndarray:
        """Viterbi: the labels of all sequences with the highest score; content wins ties.

        All texts take a step together, the longest first in line, so that those which have ended drop off the end.
        """
        size = len(found.of)
        labels = np.zeros(size, np.int64)
        if not size:
            return labels
        begin = np.flatnonzero(np.concatenate([[True], found.of[1:] != found.of[:-1]]))
        long = np.diff(np.concatenate([begin, [size]]))
        order = np.argsort(-long, kind="stable")
        begin, long = begin[order], long[order]
        score, move = self.scores()[found.seen], self.transition
        back = np.zeros((size, 2), np.int8)
        best = score[begin].copy()
        active = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right")
        for t in range(1, long[0]):
            n = active[t]
            here = begin[:n] + t
            step = move[found.joined[here]]
            from_content, from_repeated = best[:n, :1] + step[:, 0], best[:n, 1:] + step[:, 1]
            back[here] = from_repeated > from_content
            best[:n] = np.maximum(from_content, from_repeated) + score[here]
        label = (best[:, 1] > best[:, 0]).astype(np.int64)
        for t in range(long[0] - 1, -1, -1):
            n = active[t]
            here = begin[:n] + t
            labels[here] = label[:n]
            label[:n] = back[here, label[:n]]
        return labels


def fit(found: Sequences, gold: np.ndarray, steps: int = TRAINING_STEPS, rate: float = 1.0, ridge: float = 3e-4) -> Crf:
    """Maximum conditional likelihood by gradient ascent with momentum, from forward and backward sums."""
    begin = np.flatnonzero(np.concatenate([[True], found.of[1:] != found.of[:-1]]))
    long = np.diff(np.concatenate([begin, [len(found.of)]]))
    width = int(long.max())
    at = begin[:, None] + np.minimum(np.arange(width), long[:, None] - 1)
    real = (np.arange(width) < long[:, None]).astype(float)
    seen, join = found.seen[at], np.eye(2)[found.joined[at]]
    onehot = np.eye(2)[gold[at]] * real[..., None]
    bits = _BITS[seen] * real[..., None]
    state, transition = np.zeros((2, 4)), np.zeros((2, 2, 2))
    pace, turn = np.zeros_like(state), np.zeros_like(transition)
    count = real.sum()
    wanted_state = np.einsum("stl,stf->lf", onehot, bits)
    wanted_move = np.einsum("sti,stj,stk->kij", onehot[:, :-1], onehot[:, 1:], join[:, 1:])
    for _ in range(steps):
        local = np.exp(_BITS @ state.T)[seen] * real[..., None] + (1 - real[..., None])
        move = np.exp(transition)[found.joined[at]]
        forward, backward = np.zeros(local.shape), np.ones(local.shape)
        forward[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            step = np.matmul(forward[:, t - 1, None], move[:, t])[:, 0] * local[:, t]
            forward[:, t] = np.where(real[:, t, None] > 0, step / step.sum(1, keepdims=True), forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = np.matmul(move[:, t + 1], (backward[:, t + 1] * local[:, t + 1])[..., None])[..., 0]
            backward[:, t] = np.where(real[:, t + 1, None] > 0, step / step.sum(1, keepdims=True), 1)
        node = forward * backward
        node /= node.sum(2, keepdims=True)
        pair = forward[:, :-1, :, None] * move[:, 1:] * (local[:, 1:] * backward[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        pace = 0.95 * pace + rate * ((wanted_state - np.einsum("stl,stf->lf", node * real[..., None], bits)) / count - ridge * state)
        turn = 0.95 * turn + rate * ((wanted_move - np.einsum("stij,stk,st->kij", pair, join[:, 1:], real[:, 1:])) / count - ridge * transition)
        state, transition = state + pace, transition + turn
    return Crf(state, transition)


def planted_texts(count: int, seed: int) -> tuple[Sequences, np.ndarray]:
    """Made-up texts and their gold labels.

    Fresh words are interrupted by passages from earlier in the text, whole or with words changed, lost or put in, by
    single words said again, and by lines said again. A unit is repeated when it was copied with at least a wording's
    weight of neighbours that stood beside it in the original too. What coincides by chance is noise and counts as content.
    """
    pick = random.Random(seed)
    texts, gold = [], []
    for _ in range(count):
        weight, number = pick.choice((1, 2)), 0
        least = -(-LEAST_WEIGHT // weight)
        common = [f"c{k}" for k in range(30)]
        units: list[str] = []
        labels: list[int] = []
        breaks: set[int] = set()
        for _ in range(pick.randint(2, 4)):
            for _ in range(pick.randint(1, 5)):
                number += 1
                units.append(pick.choice(common) if pick.random() < 0.4 else f"w{number}")
                labels.append(0)
            if pick.random() < 0.4:
                breaks.add(len(units))
            if pick.random() < 0.7:
                a = pick.randrange(len(units))
                passage = units[a : a + pick.randint(1, 9)]
                run = 0
                changed = pick.random() < 0.5
                for unit in [*passage, None]:
                    new = unit is None or (changed and pick.random() < 0.15)
                    if not new:
                        units.append(unit)
                        labels.append(0)
                        run += 1
                        continue
                    if run >= least:
                        labels[-run:] = [1] * run
                    run = 0
                    if unit is not None:
                        number += 1
                        units.append(f"w{number}")
                        labels.append(0)
                if pick.random() < 0.4:
                    breaks.add(len(units))
        edges = sorted({0, *breaks, len(units)})
        texts.append([[(u, weight) for u in units[a:b]] for a, b in zip(edges, edges[1:])])
        gold += labels
    return observe(texts), np.array(gold)


@lru_cache(maxsize=1)
def field() -> Crf:
    """The fitted field; the same numbers in every process."""
    return fit(*planted_texts(TRAINING_TEXTS, 7))


def lines_of(text: str) -> list[list[tuple[str, int]]]:
    """The lines of a text that have units, each as its units with their weights."""
    return [units for line in text.split("\n") if (units := units_of(line))]


def repeated_letters(texts: Sequence[str | None], crf: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its letters, and those labelled repeated. Null texts and texts without letters have none of either."""
    found = observe([lines_of(text) if text else [] for text in texts])
    labels = crf.decode(found)
    return np.bincount(found.of, found.letters, len(texts)).astype(np.int64), np.bincount(found.of, found.letters * labels, len(texts)).astype(np.int64)


def _measured(state: list, transition: list, fields: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(np.array(state), np.array(transition))
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(a, ROWS_AT_ONCE)
                columns, names = [batch.column("check_id")], ["check_id"]
                for name in fields:
                    values = batch.column(name).to_pylist()
                    if pa.types.is_list(batch.schema.field(name).type):
                        values = [None if v is None else "\n".join(x for x in v if x) for v in values]
                    letters, repeated = repeated_letters(values, crf)
                    columns += [pa.array(letters), pa.array(repeated)]
                    names += [f"{name}_letters", f"{name}_repeated"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repetition(checks: DataFrame) -> DataFrame:
    """``check_id``, and of ``transcript`` and ``reasons``: letters, repeated letters, their share, and ``retained``.

    One row for each row of ``checks``; rows delivered twice stay two rows. Null or empty fields have share 0 and are
    retained. A list of reasons is one text, in order; its null entries are left out.
    """
    crf = field()
    schema = "check_id long, transcript_letters long, transcript_repeated long, reasons_letters long, reasons_repeated long"
    out = checks.select("check_id", "transcript", "reasons").mapInArrow(_measured(crf.state.tolist(), crf.transition.tolist(), ["transcript", "reasons"]), schema)
    up, down = REPEATED_SHARE
    repeated = F.lit(False)
    for name in ("transcript", "reasons"):
        part, whole = F.col(f"{name}_repeated"), F.col(f"{name}_letters")
        out = out.withColumn(f"{name}_share", F.when(whole > 0, part / whole).otherwise(0.0))
        repeated = repeated | ((whole > 0) & (part * down >= whole * up))
    return out.withColumn("retained", ~repeated)
