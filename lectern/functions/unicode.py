"""Unicode normalization and case folding as Arrow UDFs; Spark has no built-in for them. Null stays null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column, form: str = "NFC") -> Column:
    """Text in one of the forms NFC, NFD, NFKC and NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no such form: {form}")

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    # Plain ASCII is normal in every form and stays in the JVM.
    plain = text.rlike("^[\\x00-\\x7f]*$")
    return F.when(plain, text).otherwise(convert(F.when(~plain, text)))


def casefolded(text: Column) -> Column:
    """Text without case, also where folding changes its length (ß)."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(str.casefold, na_action="ignore")

    return convert(text)
