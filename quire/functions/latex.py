"""LaTeX source as plain text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accent commands and the marks they stand for; letter commands.
ACCENTS = {"'": "́", "`": "̀", '"': "̈", "^": "̂", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "u": "̆", "H": "̋", "r": "̊", "k": "̨", "d": "̣", "b": "̱"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "i", "j": "j"}
_SIGN = re.compile(r"\\(['`\"^~=.])\s*(?:\{\s*(\\[ij]|[A-Za-z])\s*\}|(\\[ij]|[A-Za-z]))")
_WORD = re.compile(r"\\([cvuHrkdb])\s*(?:\{\s*(\\[ij]|[A-Za-z])\s*\}|\s(\\[ij]|[A-Za-z]))")
_LETTER = re.compile(r"\\(" + "|".join(sorted(LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])\s?(?:\{\})?")


def text_of(source: str | None) -> str | None:
    """Accents composed, letters and dashes replaced, commands and braces dropped."""
    if source is None:
        return None

    def mark(m: re.Match) -> str:
        letter = (m.group(2) or m.group(3)).lstrip("\\")
        return unicodedata.normalize("NFC", letter + ACCENTS[m.group(1)])

    out = _WORD.sub(mark, _SIGN.sub(mark, source))
    out = _LETTER.sub(lambda m: LETTERS[m.group(1)], out)
    out = out.replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("~", " ")
    out = re.sub(r"\\([&%$#_{}])", r"\1", out)
    out = re.sub(r"\\[A-Za-z]+\*?\s*", "", out)
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", out)).strip()


def latex_text(source: Column) -> Column:
    """``text_of`` as a column, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(text_of)

    return run(source)
