"""Names of persons, compared part by part."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Short forms of common given names.
SHORT = [
    ("tom", "thomas"), ("bill", "william"), ("will", "william"), ("bob", "robert"), ("rob", "robert"), ("jim", "james"), ("mike", "michael"), ("dan", "daniel"),
    ("dave", "david"), ("chris", "christopher"), ("alex", "alexander"), ("alex", "alexandra"), ("sam", "samuel"), ("sam", "samantha"), ("ben", "benjamin"), ("joe", "joseph"),
    ("matt", "matthew"), ("nick", "nicholas"), ("tony", "anthony"), ("andy", "andrew"), ("jon", "jonathan"), ("kate", "katherine"), ("katie", "katherine"), ("liz", "elizabeth"),
    ("beth", "elizabeth"), ("jen", "jennifer"), ("jenny", "jennifer"), ("steve", "stephen"), ("steve", "steven"), ("greg", "gregory"), ("jeff", "jeffrey"), ("pete", "peter"),
    ("rick", "richard"), ("dick", "richard"), ("ed", "edward"), ("ted", "edward"), ("ken", "kenneth"), ("ron", "ronald"), ("don", "donald"), ("tim", "timothy"),
    ("fred", "frederick"), ("vicky", "victoria"), ("sue", "susan"), ("nate", "nathan"), ("nate", "nathaniel"), ("zach", "zachary"), ("josh", "joshua"), ("abby", "abigail"),
]
_ALIKE = {pair for a, b in SHORT for pair in ((a, b), (b, a))}
_SUFFIX = {"jr", "sr", "ii", "iii", "iv"}


@dataclass(frozen=True)
class Person:
    surname: str
    given: tuple[str, ...]


def split_name(name: str) -> Person | None:
    """Surname and given names or initials; None for marks such as et al."""
    text = re.sub(r"\b\d{4}\b|[*†‡]", "", re.sub(r"(?i)^\s*and\s+", "", name)).strip()
    if not text or re.match(r"(?i)(et\.?\s*al|others)\b", text):
        return None
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    last, comma, first = flat.partition(",")
    words = lambda s: [w for w in re.findall(r"[^\W\d_]+", s) if w.lower() not in _SUFFIX]
    if comma and words(first):
        surname, given = words(last), words(first)
    else:
        parts = words(flat)
        surname, given = parts[-1:], parts[:-1]
    spread = [c for g in given for c in (g if len(g) <= 3 and g.isupper() else [g])]
    return Person("".join(surname).lower(), tuple(g.lower() for g in spread))


def given_compatible(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two lists of given names can be one person's: place by place equal, an
    initial, a short form, or the start of the other."""
    for x, y in zip(a, b, strict=False):
        if x == y or (min(len(x), len(y)) == 1 and x[0] == y[0]) or (x, y) in _ALIKE:
            continue
        if min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)):
            continue
        return False
    return True
