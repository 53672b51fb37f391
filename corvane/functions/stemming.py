"""The published Porter stemmer (1980), applied to distinct words only.

Differences from extended variants of other libraries: no special cases beyond
the paper, so e.g. words of one or two letters stay as they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffix tables of the paper.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replace(w: str, table: tuple[tuple[str, str], ...], least: int) -> str:
    """The longest suffix of ``table`` that ``w`` ends in decides; it is replaced if the stem's measure is over ``least``."""
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > least else w
    return w


def porter(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    # 1a
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    # 1c
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP2, 0), STEP3, 0)
    # 4
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    # 5
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def _stems(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else porter(w) for w in words.to_pylist()], pa.string())


def porter_terms(tokens: DataFrame, word_col: str = "word") -> DataFrame:
    """``tokens`` with a column ``stem``; each distinct word is stemmed once, then joined back. A null word has a null stem."""
    distinct = tokens.select(F.col(word_col).alias("__w")).where("__w is not null").distinct()
    stems = distinct.withColumn("stem", F.arrow_udf(_stems, "string")("__w"))
    return tokens.join(stems, F.col(word_col) == F.col("__w"), "left").drop("__w")
