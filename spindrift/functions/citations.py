"""Citation marks in answers: ##n$$, with n a place in the list of cited chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How answers misspell a citation mark, in the order in which they are mended; "n" is the cited place.
MISSPELT = (
    r"#\s*ID\s*#\s*\d{1,4}\s*##\s*(?P<n>\d{1,4})\s*(?:\$\s*){2,}",
    r"#\s*ID\s*#\s*(?P<n>\d{1,4})\s*={2,}",
    r"\(\s*ID:\s*(?P<n>\d{1,4})\s*\)",
    r"ID[: ]+(?P<n>\d{1,4})",
    r"\$\$\s*(?P<n>\d{1,4})\s*\$\$",
    r"\$\[(?P<n>\d{1,4})\]\$",
    r"\$\$\s*(?P<n>\d{1,4})\s*\$+",
    r"\$(?P<n>\d{1,4})\$",
    r"#{2,}\s*(?P<n>\d{1,4})\s*(?:\$\s*){2,}",
    r"#{2,}\s*(?P<n>\d{1,4})\s*(?:#{1,}\s*)+",
    r"##\s*(?P<n>\d{1,4})\s*#{2,}",
    r"【(?P<n>\d{1,4})】",
    r"(?i:ref)\s*(?P<n>\d{1,4})",
    r"(?<!\w)(?P<n>\d{1,4})\s*={2,}(?=\s|$|[)\]】,，。.!?:;；：])",
)
MARK = r"##(\d+)\$\$"
#: What is left of a mark that could not be mended, and where marks get a space, with what stands there then.
LEFTOVER = r"(?i)#\s*ID\s*#"
SPACED = (
    (r"\$\$(?=##\d+\$\$)", "$$ "),
    (r"(##\d+\$\$)(?=[A-Za-z\u4e00-\u9fff])", r"\1 "),
    (r"(?<=[A-Za-z\u4e00-\u9fff])(?=##\d+\$\$)", " "),
)

_MISSPELT = [re.compile(p) for p in MISSPELT]
_SPACES = [(re.compile(p), to) for p, to in SPACED]


def mend(answer: str, chunks: int) -> str:
    """The answer with each misspelt mark as ##n$$, or gone if fewer than n + 1 chunks were given; marks stand apart from letters."""

    def mark(found: re.Match) -> str:
        n = int(found["n"])
        return f"##{n}$$" if n < chunks else ""

    for pattern in _MISSPELT:
        answer = pattern.sub(mark, answer)
    answer = re.sub(LEFTOVER, "", answer)
    for pattern, to in _SPACES:
        answer = pattern.sub(to, answer)
    return answer


@F.pandas_udf(StringType())
def _mend(answers: pd.Series, chunks: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else mend(a, int(n)) for a, n in zip(answers, chunks.fillna(0), strict=True)], dtype=object)


def mend_citations(answer: Column, chunks: Column) -> Column:
    """``mend`` as a column; a null answer stays null, a null count is 0."""
    return _mend(answer, chunks)


def cited_places(answer: Column) -> Column:
    """The different places that an answer cites, in order of their first mark."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)), lambda n: n.cast("int")))
