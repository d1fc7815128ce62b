"""Porter's suffix stripping for English words (1980), and width folding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what they become, by step, as Porter gives them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """The stem's letters as v and c; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _suffix(word: str, among) -> str:
    """The longest suffix of ``word`` among the given ones; empty if there is none."""
    return max((s for s in among if word.endswith(s)), key=len, default="")


def porter(word: str) -> str:
    """The stem of a lower-case ASCII word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    end = _suffix(word, ("sses", "ies", "ss", "s"))
    word = word[: len(word) - {"sses": 2, "ies": 2, "s": 1}.get(end, 0)]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _suffix(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _suffix(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _suffix(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _ends_cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem(words: Column | str) -> Column:
    """``porter`` of words of ASCII letters; others, and null, as they are. Meant for different words: join the stems back."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: porter(w) if w and re.fullmatch("[a-z]+", w) else w)

    return stems(words)


#: Full-width signs, which lie at a fixed distance from ASCII, and the wide space.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def fold_width(text: Column) -> Column:
    """Full-width characters as their half-width ones."""
    return F.translate(text, _WIDE, _NARROW)
