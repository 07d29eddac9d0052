"""Verification of renderings against transcripts, over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import compare

RATE_DEFAULT, RATE_WINDOW, RATE_LEAST = 15.0, 400, 12


def verdicts(pairs: DataFrame) -> DataFrame:
    """Adds ``ok, cer, reasons`` to ``text, heard, lang`` (and ``signal_reasons array<string>``, if it is there).

    Null text counts as empty; a null transcript has no error rate and only the reasons of the signal. Columns of the
    input with the names of the results are replaced.
    """
    plain = pairs.drop("ok", "cer", "reasons")
    has_signal = "signal_reasons" in plain.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            signal = frame["signal_reasons"] if has_signal else [()] * len(frame)
            found = [compare.verdict(t or "", None if h is None or h != h else h, lang or "", list(s) if s is not None else []) for t, h, lang, s in zip(frame["text"], frame["heard"], frame["lang"], signal)]
            yield frame.assign(ok=[v.ok for v in found], cer=[v.cer for v in found], reasons=[v.reasons for v in found])

    return plain.mapInPandas(run, f"{schema}, ok boolean, cer double, reasons array<string>")


def cer_simple(pairs: DataFrame) -> DataFrame:
    """Adds ``cer`` to ``text, heard`` with built-in expressions; exact where canonical forms are (see canon_simple)."""
    return pairs.withColumn("cer", compare.cer_column(compare.canon_simple(F.coalesce("text", F.lit(""))), compare.canon_simple(F.coalesce("heard", F.lit("")))))


def missing_words(pairs: DataFrame) -> DataFrame:
    """Adds ``missing``: words of ``text`` with no close word in ``heard``, in order, with built-in expressions.

    Null counts as empty on both sides. Both lists of words are made once for a row, before they are compared.
    """
    words = lambda c, least: F.filter(F.split(compare.canon_simple(F.coalesce(c, F.lit(""))), " "), lambda w: F.length(w) >= least)
    split = pairs.drop("missing").withColumn("_w", F.array(F.struct(words("text", compare.LONG_WORD).alias("a"), words("heard", 1).alias("b"))))
    joined = F.transform("_w", lambda p: F.struct(F.array_except(p["a"], p["b"]).alias("open"), p["a"].alias("a"), p["b"].alias("b"), F.array_join(p["b"], "").alias("j")))
    # Words that were heard as they are need no comparison.
    lost = lambda p: F.filter(p["open"], lambda w: ~(F.exists(p["b"], lambda h: compare.close_column(w, h)) | ((F.length(w) >= 5) & F.contains(p["j"], w))))
    found = F.transform(joined, lambda p: F.transform(F.array(F.struct(p["a"].alias("a"), lost(p).alias("l"))), lambda q: F.filter(q["a"], lambda w: F.array_contains(q["l"], w)))[0])
    return split.withColumn("missing", found[0]).drop("_w")


def _said(heard: pd.Series) -> list[str | None]:
    return [None if h is None or h != h else h for h in heard]


def cer(pairs: DataFrame) -> DataFrame:
    """Adds ``cer`` to ``text, heard, lang``, of any script: :func:`compare.cer`, with the distance as a built-in expression.

    Null text counts as empty; a null transcript has no error rate.
    """

    @F.pandas_udf("reference string, said string")
    def canonical(texts: pd.Series, heard: pd.Series, langs: pd.Series) -> pd.DataFrame:
        found = [(compare.canon(t, lang or ""), None if h is None else compare.canon(h, lang or "")) for t, h, lang in zip(_said(texts), _said(heard), langs)]
        return pd.DataFrame(found, columns=["reference", "said"])

    both = pairs.withColumn("_canon", canonical("text", "heard", "lang"))
    return both.withColumn("cer", F.when(F.col("heard").isNotNull(), compare.cer_column(F.col("_canon.reference"), F.col("_canon.said")))).drop("_canon")


def lost_words(pairs: DataFrame) -> DataFrame:
    """Adds ``numbers, words`` to ``text, heard, lang``, of any script: the two lists of :func:`compare.missing_words`.

    Null text counts as empty; a null transcript has no lists.
    """

    @F.pandas_udf("numbers array<string>, words array<string>")
    def lost(texts: pd.Series, heard: pd.Series, langs: pd.Series) -> pd.DataFrame:
        found = [(None, None) if h is None else compare.missing_words(t or "", h, lang or "") for t, h, lang in zip(_said(texts), _said(heard), langs)]
        return pd.DataFrame(found, columns=["numbers", "words"])

    return pairs.withColumn("_lost", lost("text", "heard", "lang")).withColumn("numbers", F.col("_lost.numbers")).withColumn("words", F.col("_lost.words")).drop("_lost")


def classify_attempts(attempts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, n, outcome`` of ``key, ok, cer``: ok; text that no transcript fits, where no attempt is ok but at least
    two error rates are nearly equal; or failure. Null ``ok`` counts as not ok; partial aggregation needs no sort."""
    found = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any_ok"), F.count("cer").alias("scored"), (F.max("cer") - F.min("cer")).alias("spread"))
    outcome = F.when(F.col("any_ok"), "ok").when((F.col("scored") >= 2) & (F.col("spread") < compare.SPREAD), "unverifiable_text").otherwise("synthesis_failure")
    return found.select(key, "n", outcome.alias("outcome"))


def kept_attempt(attempts: DataFrame, key: str = "chunk_id", retries: int = 2) -> DataFrame:
    """``key, attempt, ok``: the first good attempt among the first ``retries + 1``, or the last of them."""
    within = attempts.filter(F.col("attempt") <= retries + 1)
    found = within.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("good"), F.max("attempt").alias("last"))
    return found.select(key, F.coalesce("good", "last").alias("attempt"), F.col("good").isNotNull().alias("ok"))


def rate_calibration(rendered: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``rate``: what is known of the speaking rate before each row of ``chars, seconds``, by group in order.

    The median of the last ``RATE_WINDOW`` qualifying rows (at least 40 characters and 0.05 seconds), or the default
    while fewer than ``RATE_LEAST`` have been seen. The window is over the qualifying rows alone; every other row has the
    value that the next qualifying one has. ``order`` must be unique within a group. A column ``rate`` is replaced.
    """
    fits = F.coalesce((F.col("seconds") > 0.05) & (F.col("chars") >= 40), F.lit(False))
    by = W.partitionBy(group).orderBy(*order)
    # The number of qualifying rows before a row: rows between two qualifying ones share it, with the second of them.
    rows = rendered.withColumn("_fits", fits).withColumn("_n", F.count_if("_fits").over(by.rowsBetween(W.unboundedPreceding, -1)))
    good = rows.filter("_fits").select(*(F.col(c).alias(f"_{c}") for c in (group, "chars", "seconds")), F.col("_n").alias("_k"))
    before = W.partitionBy(f"_{group}").orderBy("_k").rangeBetween(-RATE_WINDOW, -1)
    # One row more than there are qualifying ones, for what comes after the last of them.
    end = good.groupBy(f"_{group}").agg((F.max("_k") + 1).alias("_k")).select(f"_{group}", F.lit(None).cast(good.schema["_chars"].dataType).alias("_chars"), F.lit(None).cast(good.schema["_seconds"].dataType).alias("_seconds"), "_k")
    median = F.expr("percentile(_chars / _seconds, 0.5)").over(before)
    rated = good.unionByName(end).select(f"_{group}", "_k", F.when(F.col("_k") >= RATE_LEAST, median).otherwise(RATE_DEFAULT).alias("rate"))
    joined = rows.drop("rate").join(rated, F.col(group).eqNullSafe(F.col(f"_{group}")) & (F.col("_n") == F.col("_k")), "left")
    return joined.withColumn("rate", F.coalesce("rate", F.lit(RATE_DEFAULT))).drop("_fits", "_n", "_k", f"_{group}")
