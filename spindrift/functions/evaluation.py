"""Text comparison of the evaluation: normal forms, and how well an answer supports a claim."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def fold(text: str) -> str:
    """Compatibility form, lower case, no white space."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).lower())


def windows(text: str) -> list[str]:
    """The sentences of a text and each pair of neighbours; the text itself if it has none."""
    parts = [p.strip() for p in re.split(r"[。！？；;!?\n\r]+", text)]
    parts = [p for p in parts if p]
    return parts + [a + b for a, b in zip(parts, parts[1:])] or [text]


def supported(claim: str, answer: str) -> float:
    """1 if a window of the answer holds the claim, else the best likeness of a window or the whole: matching runs or shared characters."""
    claim, whole = fold(claim), fold(answer)
    if not claim or not whole:
        return 0.0
    letters, best = set(claim), 0.0
    for part in [whole, *filter(None, map(fold, windows(answer)))]:
        if part is not whole and claim in part:
            return 1.0
        best = max(best, len(letters & set(part)) / len(letters))
        if best < 1:
            best = max(best, SequenceMatcher(None, claim, part).ratio())
    return best


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(fold)


@F.pandas_udf(StringType())
def _signs_out(texts: pd.Series) -> pd.Series:
    return texts.fillna("").str.replace(r"\W+", "", regex=True)


@F.pandas_udf(DoubleType())
def _supported(claims: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([supported(c or "", a or "") for c, a in zip(claims, answers, strict=True)], dtype="float64")


def normalised(text: Column) -> Column:
    """``fold`` as a column; null is empty."""
    return _fold(text)


def signs_out(loose: Column) -> Column:
    """Letters, digits and underscores alone."""
    return _signs_out(loose)


def support(claim: Column, answer: Column) -> Column:
    """``supported`` as a column; null is empty."""
    return _supported(claim, answer)
