"""Shared text steps of the name and record matchers (plain Python, per value)."""

from __future__ import annotations

import functools
import re
import unicodedata

from quire.llm.lookalike import HIDDEN, LOOKALIKES

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in HIDDEN} | {ord(k): v for k, v in {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "þ": "th", "ð": "d"}.items()}
_GAPS = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Lower case without accents and look-alikes; words of another script stay."""
    if text.isascii():
        return text.lower()
    return " ".join(w.lower() if w.isascii() else _folded_word(w) for w in text.split(" "))


@functools.lru_cache(1 << 16)
def _folded_word(word: str) -> str:
    flat = unicodedata.normalize("NFKD", word)
    parts = [w if _is_foreign(w) else w.translate(_FOLD) for w in re.split(r"(\s+)", flat)]
    return "".join(c for c in unicodedata.normalize("NFKD", "".join(parts)) if not unicodedata.combining(c)).casefold()


def _is_foreign(word: str) -> bool:
    """Whether a word is wholly of another script."""
    letters = [c for c in word if c.isalpha() and c not in HIDDEN]
    return bool(letters) and not any("LATIN" in unicodedata.name(c, "") for c in letters)


def compact(text: str | None) -> str:
    """Letters and digits of the folded text."""
    return _GAPS.sub("", folded(text)) if text else ""


def words(text: str | None) -> list[str]:
    """Words of the folded text."""
    return re.findall(r"[^\W_]+", folded(text)) if text else []
