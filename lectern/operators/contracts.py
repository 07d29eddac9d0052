"""Places for models that this package does not hold: speech, transcription, stress marks, editing.

Each takes a factory that is called once in every Python worker and returns the function that does the work. The
factory is pickled, so it must load its model by itself. What is computed here is only how rows go in and out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import arrays, stress
from lectern.functions import text as T
from lectern.operators import structure

SEED_STEP = 1000
ASR_RATE, ASR_PAD_SECONDS = 16_000, 0.3


def _mapped(df: DataFrame, columns: list[str], added: str, factory: Callable[[], Callable], row: Callable) -> DataFrame:
    kept = df.drop(*(c.split(" ")[0] for c in added.split(", ")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), added])
    names = [c.split(" ")[0] for c in added.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            found = [row(model, *values) for values in zip(*(frame[c] for c in columns))]
            yield frame.assign(**{name: [f[k] for f in found] for k, name in enumerate(names)})

    return kept.mapInPandas(run, schema)


def synthesise(chunks: DataFrame, factory: Callable[[], Callable[[str, str, int], tuple[np.ndarray, int]]], retries: int = 2, seed: int = 0) -> DataFrame:
    """Adds ``attempt, audio, sample_rate`` to chunks of ``text, lang``, one row for each attempt with its own seed.

    The function takes text, language and seed; samples that are no number are replaced by 0 in every attempt.
    """
    attempts = chunks.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(retries + 1))))

    def row(model: Callable, text: str, lang: str, attempt: int) -> tuple:
        audio, rate = model(text, lang, seed + SEED_STEP * (attempt - 1))
        return np.nan_to_num(np.asarray(audio, float), nan=0.0, posinf=0.0, neginf=0.0).tolist(), rate

    return _mapped(attempts, ["text", "lang", "attempt"], "audio array<double>, sample_rate int", factory, row)


def transcribe(renders: DataFrame, factory: Callable[[], Callable[[np.ndarray, int, str], str]]) -> DataFrame:
    """Adds ``heard`` to renders of ``audio, sample_rate, lang``: resampled to 16 kHz, with silence at both ends.

    Renders shorter than a hundredth of a second are not sent to the model and have a null transcript.
    """

    def row(model: Callable, audio: list | None, rate: int, lang: str) -> tuple:
        if audio is None or len(audio) < max(1, rate // 100):
            return (None,)
        pad = np.zeros(int(ASR_RATE * ASR_PAD_SECONDS))
        return (model(np.concatenate([pad, arrays.resample(np.asarray(audio, float), rate, ASR_RATE), pad]), ASR_RATE, lang),)

    return _mapped(renders, ["audio", "sample_rate", "lang"], "heard string", factory, row)


def mark(texts: DataFrame, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds ``marked`` to rows of ``text``; texts that carry marks of their own are kept, null stays null."""

    def row(model: Callable, text: str | None) -> tuple:
        return (text if text is None or "+" in text or "\u0301" in text else model(text),)

    return _mapped(texts, ["text"], "marked string", factory, row)


def mark_stress(texts: DataFrame, factory: Callable[[], tuple[Callable[[str], str], Callable[[str], str]]]) -> DataFrame:
    """Adds ``marked`` to rows of ``text``: :func:`stress.marked` with a tagger of texts and a guesser of words."""

    def row(models: tuple, text: str | None) -> tuple:
        return (None if text is None else stress.marked(text, *models),)

    return _mapped(texts, ["text"], "marked string", factory, row)


def mark_acute(texts: DataFrame, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds ``marked`` to rows of ``text``: acutes only where they tell something, those set by hand kept."""

    def row(model: Callable, text: str | None) -> tuple:
        return (None if text is None else stress.keep_hand_marks(text, model),)

    found = _mapped(texts, ["text"], "marked string", factory, row)
    return found.withColumn("marked", T.to_acute_sparse(F.col("marked")))


#: What a phonemiser is given: words with marks and hyphens, and the punctuation that carries a pause.
_PHONEME_TOKEN = r"(?iu)(\+?[а-яё][+а-яё]*(?:-[+а-яё]+)*|\.\.\.|[—–]|-(?=\s)|[,.!?;:…])"


def phoneme_tokens(text: str | F.Column) -> F.Column:
    """The tokens of a text that are pronounced or carry a pause, in order; an ellipsis is one, dashes are one dash."""
    tokens = F.regexp_extract_all(text, F.lit(_PHONEME_TOKEN), F.lit(1))
    return F.transform(tokens, lambda t: F.when(t == "...", "…").when(t.isin("–", "-"), "—").otherwise(t))


def phonemise(texts: DataFrame, factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds ``phonemes`` to rows of ``text``: the sounds of each word by the model, pauses as they are, with spaces
    between words. Null stays null; a word the model cannot say is left out."""
    kept = texts.withColumn("_tokens", phoneme_tokens(F.col("text")))

    def row(model: Callable, tokens: list | None) -> tuple:
        if tokens is None:
            return (None,)
        out = ""
        for token in tokens:
            if token in ",.!?;:…—":
                out += token
            elif said := model(token):
                out += f" {said}"
        return (out.strip(),)

    return _mapped(kept, ["_tokens"], "phonemes string", factory, row).drop("_tokens")


def assemble(pieces: DataFrame, group: str, order: str, sample_rate: int) -> DataFrame:
    """``group, audio, seconds, clamped`` and the figures of :func:`arrays.normalised`: the pieces ``audio, pause_ms`` of
    each group in order, each trimmed and followed by its pause, between lead and tail, at the target level.

    Pieces are prepared one by one, by all tasks; only joining them is by group, and a group, a chapter, is one array.
    Null and silent pieces have no pause either. ``order`` must be unique within a group.
    """

    def row(_model: None, audio: list | None) -> tuple:
        x = np.asarray(audio if audio is not None else [], float)
        top, limit = np.abs(x).max(initial=0), arrays.db_to_lin(arrays.CEILING)
        x, cut = arrays.clamp_silence(arrays.trim_silence(x * (limit / top) if top > limit else x, sample_rate), sample_rate)
        return x.tolist(), cut

    made = _mapped(pieces.select(group, order, "audio", "pause_ms"), ["audio"], "piece array<double>, cut int", lambda: None, row)
    quiet = lambda ms: arrays.silence(ms, F.lit(sample_rate))
    part = F.when(F.size("piece") > 0, F.concat("piece", quiet(F.coalesce("pause_ms", F.lit(0))))).otherwise(F.array().cast("array<double>"))
    joined = made.groupBy(group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x["p"])).alias("parts"), F.sum("cut").alias("clamped"))
    whole = joined.select(group, F.concat(quiet(F.lit(arrays.LEAD_MS)), "parts", quiet(F.lit(arrays.TAIL_MS))).alias("whole"), "clamped")
    found = whole.withColumn("n", arrays.normalised(F.col("whole")))
    return found.select(group, (F.size("whole") / sample_rate).alias("seconds"), "clamped", "n.*")


def edit(chunks: DataFrame, group: str, order: str, factory: Callable[[], Callable[[list[tuple[int, str]]], list[tuple[int, str, str | None]]]], size: int = 20) -> DataFrame:
    """``group, order, edit_i, text, pause, failed`` of an editor that takes batches of ``(order, text)``.

    A batch is one call; a call that raises gives one row with ``failed`` set and no edit, so that a later run can
    tell complete groups from others. Batches are small, so no task holds a whole group.
    """
    batched = structure.batches(chunks, group, order, size)
    rows = batched.groupBy(group, "batch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("i"), F.col("text").alias("text")))).alias("rows"))
    kind = chunks.schema[group].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            out: list[tuple] = []
            for name, batch in zip(frame[group], frame["rows"]):
                try:
                    edits = model([(r["i"], r["text"]) for r in batch])
                except Exception:  # noqa: BLE001  any failure of the model is a failed batch
                    out.append((name, None, None, None, None, True))
                    continue
                out += [(name, i, k, text, pause, False) for k, (i, text, pause) in enumerate(edits)]
            yield pd.DataFrame(out, columns=[group, order, "edit_i", "text", "pause", "failed"])

    return rows.mapInPandas(run, f"`{group}` {kind}, `{order}` long, edit_i long, text string, pause string, failed boolean")
