"""Variant spellings of names typed by people (problem 1).

Each distinct string is read once: as an organisation (its own name, kind and
field) or as a person (surname, given name, initials).  Which of two words is
the given name is settled by the corpus: a word that stands first beside many
surnames is one, so both token orders are tried.

Trie join: the distinct keys (surnames, organisations) are sharded by their
halves (two strings within one change share a half), every shard is a trie, and
every key walks it as a Levenshtein automaton with swaps, one row of the edit
table a node, leaving subtrees beyond the bound.  A rare spelling follows its
most frequent neighbour; the strings of such a family are then told apart by
given names: equal, a short form, one change from a usual one, an initial with
its middle initials.  A person of three words or more without a comma or initials
may stand in any order: of the readings (each end as the surname, one word or all
but one) the one whose surname is surest elsewhere is taken.  A string that could
be two persons is the one that stands under the same titles, if the titles tell,
else it is linked to neither.

Defined results: null and blank names and marks such as ``et al.`` are no
names; strings that differ at all are different strings; a string in many rows is
one; a malformed JSON list has no names; very long strings are compared like
others; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.names_text import folded
from quire.session import landed, scattered

#: Changes (insert, delete, replace, swap) between spellings of one key.
BOUND = 1
#: Surnames beside which a word stands first before it counts as a usual given name.
USUAL = 3
#: A word one change from another beside so many times as many surnames is a misspelling of it, beside however many it stands.
OFTEN = 10

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "becky": "rebecca", "bella": "isabella", "ben": "benjamin",
    "beppe": "giuseppe", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert", "bobby": "robert", "chris": "christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "drew": "andrew",
    "ed": "edward", "fran": "francisco", "paco": "francisco", "fred": "frederick", "gabi": "gabriela", "greg": "gregory", "hannes": "johannes",
    "jen": "jennifer", "jenny": "jennifer", "jim": "james", "joe": "joseph", "jon": "jonathan", "josh": "joshua", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "leo": "leonard", "lena": "helene", "liz": "elizabeth", "maggie": "margaret",
    "matt": "matthew", "meg": "margaret", "mike": "michael", "misha": "mikhail", "nate": "nathaniel", "nick": "nicholas", "pat": "patricia", "peggy": "margaret", "pete": "peter",
    "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sasha": "alexander",
    "steve": "stephen", "sue": "susan", "ted": "theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tony": "anthony", "trish": "patricia", "vicky": "victoria",
    "vince": "vincent", "will": "william", "zach": "zachary",
}
# Further given names that a short form may stand for.
ALSO = {
    "al": ("alan", "alfred"), "alex": ("alexandra",), "chris": ("christina", "christine"), "dan": ("danilo",), "ed": ("edwin", "edmund"), "fran": ("frances",),
    "jen": ("jenna",), "kate": ("catherine",), "kathy": ("catherine", "kathleen"), "lena": ("magdalena",), "leo": ("leonardo", "leopold"), "nick": ("nicolas",),
    "pat": ("patrick",), "sam": ("samantha",), "sasha": ("alexandra",), "steve": ("steven",), "ted": ("edward",),
}
# Kinds of organisation and their short forms.
KINDS = {
    "university": "university", "univ": "university", "institute": "institute", "inst": "institute", "laboratory": "laboratory", "lab": "laboratory",
    "labs": "laboratory", "centre": "centre", "center": "centre", "ctr": "centre", "consortium": "consortium", "cons": "consortium",
    "collaboration": "collaboration", "collab": "collaboration", "department": "department", "dept": "department", "school": "school",
    "college": "college", "society": "society", "association": "association", "assoc": "association", "foundation": "foundation", "group": "group",
}
_SMALL = {"the", "of", "for", "and", "in", "at"}
_SUFFIX = {"jr", "sr", "ii", "iii", "iv", "phd", "dr", "prof", "mr", "mrs", "ms"}
_MARK = re.compile(r"\W*(?:et\.?\s*al|and\s+others|others|u\.?\s*a|etc)\.?\W*\Z", re.I)
_SPACING = str.maketrans("", "", "´`¨^~¸ˆ˜˙˚")

PARSED = "name string, n long, kind string, key string, first string, mids string, swapped boolean, sure boolean, turns array<string>, fields array<string>"


def is_name(name: str | None) -> bool:
    """Whether a string is a name at all."""
    return name is not None and any(c.isalpha() for c in name) and not _MARK.match(name)


def _tokens(text: str) -> list[str]:
    """Parts of a name in their own case, without marks and footnote digits."""
    return [t for t in (re.sub(r"[\W\d_]+", "", p) for p in re.split(r"[\s.]+", text)) if t]


def _own(text: str) -> list[str]:
    """The tokens of a person without titles and suffixes; two capitals beside a single word (Doe JR) are initials."""
    toks = _tokens(text)
    own = [t for t in toks if folded(t) not in _SUFFIX]
    return own if len(own) != 1 else [t for t in toks if t in own or (len(t) == 2 and t.isupper())]


def _spelled(name: str) -> str:
    """A name in plain letters, its words still in their own case."""
    text = name.translate(_SPACING)
    if any("Ā" <= c or c in "\xa0\xad" for c in text):
        text = " ".join(folded(w).upper() if w.isupper() else folded(w).capitalize() if w[:1].isupper() else folded(w) for w in text.split())
    return text


def organisation(text: str) -> tuple[str, str, list[str]] | None:
    """(own name, kind, words of its field) of an organisation; none of a person."""
    plain = [folded(t) for t in _tokens(text)]
    if len(plain) < 3 or not any(t in KINDS for t in plain):
        return None
    head, _, tail = text.rpartition(",")
    own = [folded(t) for t in _tokens(tail)] if head else []
    rest = [folded(t) for t in _tokens(head)] if head else plain
    rest = [t for t in rest if t not in _SMALL]
    if not own and rest:
        own, rest = rest[:1], rest[1:]
    return "".join(own), next((KINDS[t] for t in rest if t in KINDS), ""), [t for t in rest if t not in KINDS]


def parse(name: str) -> tuple[str, str, str, str]:
    """(kind, key, first, mids): 'o' with its key, or 'p' with surname, first given name or initial, middle initials."""
    text = _spelled(name)
    found = organisation(text)
    if found:
        own, kind, field = found
        return "o", f"{own} {kind} {' '.join(t[:3] for t in field)}", "", ""
    parts = [p for p in text.split(",") if _tokens(p) and folded(_tokens(p)[0]) not in _SUFFIX]
    if len(parts) >= 2:
        surname, given = _tokens(parts[0]), _tokens(parts[1])
        if all(_is_initials(t) for t in surname) and not any(_is_initials(t) for t in given):
            surname, given = given, surname
    else:
        toks = _own(text)
        if len(toks) >= 2 and _is_initials(toks[-1]) and not _is_initials(toks[0]):
            k = len(toks)
            while k > 1 and _is_initials(toks[k - 1]):
                k -= 1
            surname, given = toks[:k], toks[k:]
        else:
            k = 0
            while k < len(toks) - 1 and (k == 0 or _is_initials(toks[k])):
                k += 1
            given, surname = toks[:k], toks[k:]
    flat: list[str] = []
    for t in given:
        flat += list(folded(t)) if _is_initials(t) and len(t) > 1 else [folded(t)]
    first = flat[0] if flat else ""
    mids = "".join(t[0] for t in flat[1:] if t)
    return "p", "".join(folded(t) for t in surname), first, mids


def _is_initials(token: str) -> bool:
    """One letter, or two capitals written together."""
    return len(token) == 1 or (len(token) == 2 and token.isupper())


def _step(row: list[int], before: list[int], word: str, depth: int, c: str, last: str, bound: int) -> list[int]:
    """The next row of the edit table for a letter ``c`` read at ``depth``: only the
    ``2 bound + 1`` cells about the diagonal, so long words cost no more a letter."""
    new: list[int] = []
    far = bound + 1
    for k in range(2 * bound + 1):
        j = depth + 1 + k - bound
        if j < 0 or j > len(word):
            new.append(far)
            continue
        d = far
        if k < 2 * bound:
            d = row[k + 1] + 1
        if k and new[k - 1] + 1 < d:
            d = new[k - 1] + 1
        if j:
            same = row[k] + (c != word[j - 1])
            d = min(d, same)
            if j > 1 and before and c == word[j - 2] and last == word[j - 1]:
                d = min(d, before[k] + 1)
        new.append(min(d, far))
    return new


def _first_row(word: str, bound: int) -> list[int]:
    return [k - bound if 0 <= k - bound <= len(word) else bound + 1 for k in range(2 * bound + 1)]


def distance(a: str, b: str, bound: int = BOUND) -> int:
    """Edit distance with swaps of neighbours, bound + 1 where it is more."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    before: list[int] = []
    row, last = _first_row(b, bound), ""
    for i, x in enumerate(a):
        row, before = _step(row, before, b, i, x, last, bound), row
        last = x
        if min(row) > bound:
            return bound + 1
    return min(row[len(b) - len(a) + bound], bound + 1)


class Trie:
    """A trie whose neighbours of a word are enumerated by a Levenshtein automaton."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, bound: int = BOUND) -> Iterator[str]:
        """The words within the bound; a branch is left when its whole row is beyond it."""
        stack = [(self.root, _first_row(word, bound), [], "", 0)]
        while stack:
            node, row, before, last, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    k = len(word) - depth + bound
                    if 0 <= k <= 2 * bound and row[k] <= bound:
                        yield child
                    continue
                new = _step(row, before, word, depth, c, last, bound)
                if min(new) <= bound:
                    stack.append((child, new, row, c, depth + 1))


def shards(key: str) -> list[str]:
    """The halves under which a key meets every key within one change."""
    n = len(key)
    out = {f"{side}{part}" for h in {(n - 1) // 2, n // 2} for side, part in (("p", key[:h]), ("s", key[n - h :]))}
    return sorted(out)


def stream_groups(columns: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]):
    """A mapInPandas function that calls ``work`` on each run of equal columns of sorted rows."""

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the parts of the last group so far
        at: tuple | None = None
        for pdf in parts:
            if not len(pdf):
                continue
            ids = pdf[columns]
            cuts = [*(ids.ne(ids.shift()).any(axis=1).to_numpy().nonzero()[0]), len(pdf)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(ids.iloc[a])
                if key != at and held:
                    out.append(work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]))
                    held = []
                at = key
                held.append(pdf.iloc[a:b])
            out = [o for o in out if o is not None]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            last = work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
            if last is not None:
                yield last

    return op


def _shard_pairs(pdf: pd.DataFrame) -> pd.DataFrame | None:
    words = pdf["k"].tolist()
    if len(words) < 2:
        return None
    trie = Trie(words)
    rows = [(a, b) for a in words for b in trie.near(a) if a < b]
    return pd.DataFrame(rows, columns=["a", "b"]) if rows else None


def trie_join(keys: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct keys (column ``k``) within one change, a < b.

    A shard holds the keys of one half; a half is as rare as half a key, so
    that no shard grows with the rows."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(s, k) for k in pdf["k"] for s in shards(k)]
            yield pd.DataFrame(rows, columns=["shard", "k"])

    wide = keys.select("k").distinct().mapInPandas(spread, "shard string, k string")
    ready = scattered(wide, "shard").sortWithinPartitions("shard")
    return ready.mapInPandas(stream_groups(["shard"], _shard_pairs), "a string, b string").distinct()


def turns(name: str) -> list[str]:
    """The readings (surname, first given name, middle initials, set apart by spaces) of a person's words in
    other orders; none where a comma or initials tell, or where there are two words only."""
    if "," in name:
        return []
    toks = [t for t in _tokens(name.translate(_SPACING)) if folded(t) not in _SUFFIX]
    if len(toks) < 3 or any(_is_initials(t) for t in toks):
        return []
    ws = [folded(t) for t in toks]
    initials = lambda rest: "".join(w[0] for w in rest)
    return [f"{s} {f} {initials(rest)}" for s, f, rest in ((ws[-1], ws[0], ws[1:-1]), (ws[0], ws[1], ws[2:]), ("".join(ws[:-1]), ws[-1], []), ("".join(ws[1:]), ws[0], []))]


def _is_sure(name: str, kind: str) -> bool:
    """Whether a person's surname can be told from the string alone."""
    toks = _tokens(name.translate(_SPACING))
    return kind == "p" and len(toks) > 1 and ("," in name or any(_is_initials(t) for t in toks))


def parsed(names: DataFrame) -> DataFrame:
    """One row per distinct name (name, n) with its reading; ``swapped``: a
    person of two words, which might stand the other way round."""

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, n in zip(pdf["name"], pdf["n"], strict=True):
                if is_name(name):
                    kind, key, first, mids = parse(name)
                    if key:
                        is_person = kind == "p"
                        rows.append((name, n, kind, key, first, mids, is_person and len(first) > 1 and not mids, _is_sure(name, kind), turns(name) if is_person else [], [] if is_person else organisation(_spelled(name))[2]))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in PARSED.split(", ")])

    read = landed(names.groupBy("name").agg(F.sum("n").alias("n")).mapInPandas(op, PARSED), "names")
    read = _turned(_mended(read))
    usual = read.filter("kind = 'p' AND length(first) > 1").groupBy(F.col("first").alias("w")).agg(F.countDistinct("key").alias("u"))
    usual = landed(usual.filter(F.col("u") >= USUAL), "names-usual")
    usual = usual.join(_slips(usual), "w", "left")
    columns = lambda c: usual.select(F.col("w").alias(c), F.col("u").alias(f"as_{c}"), F.when(F.col("right").isNotNull(), 0).otherwise(F.col("u")).alias(f"of_{c}"))
    both = read.join(columns("first"), "first", "left").join(columns("key"), "key", "left")
    turn = F.col("swapped") & F.col("as_key").isNotNull() & F.col("as_first").isNull()
    return both.select(
        "name",
        "n",
        "kind",
        F.when(turn, F.col("first")).otherwise(F.col("key")).alias("key"),
        F.when(turn, F.col("key")).otherwise(F.col("first")).alias("first"),
        "mids",
        F.coalesce(F.when(turn, F.col("of_key")).otherwise(F.col("of_first")), F.lit(0)).alias("usual"),
    )


def _slips(usual: DataFrame) -> DataFrame:
    """(w, right): the words (w, u) that are misspellings of a far more usual one. Misspellings stand beside more and more names as
    the tables grow, but always beside a small share of those of the right word."""
    near = trie_join(usual.select(F.col("w").alias("k")))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own, other = usual.select(F.col("w").alias("a"), F.col("u").alias("na")), usual.select(F.col("w").alias("b"), F.col("u").alias("nb"))
    far = both.join(own, "a").join(other, "b").filter(F.col("nb") >= OFTEN * F.col("na"))
    return far.groupBy(F.col("a").alias("w")).agg(F.max_by("b", F.struct("nb", "b")).alias("right"))


def _mended(read: DataFrame) -> DataFrame:
    """``read`` with the keys of organisations made of the right words of their fields, where these are misspelled in the letters that the key keeps."""
    part = lambda i: F.split_part("key", F.lit(" "), F.lit(i))
    named = read.filter("kind = 'o'")
    words = named.select("name", part(1).alias("own"), F.posexplode("fields").alias("i", "w"))
    usual = landed(words.groupBy("w").agg(F.countDistinct("own").alias("u")), "names-fields")
    heads = words.join(_slips(usual), "w", "left").select("name", F.struct("i", F.substring(F.coalesce("right", "w"), 1, 3).alias("h")).alias("h"))
    heads = heads.groupBy("name").agg(F.concat_ws(" ", F.array_sort(F.collect_list("h"))["h"]).alias("heads"))
    key = F.when(F.col("heads").isNotNull(), F.concat_ws(" ", part(1), part(2), "heads")).otherwise(F.col("key"))
    columns = [c for c in read.columns if c != "fields"]
    mended = named.join(heads, "name", "left").withColumn("key", key)
    return read.filter("kind = 'p'").select(columns).unionByName(mended.select(columns))


def _turned(read: DataFrame) -> DataFrame:
    """``read`` with the persons of many words in the order whose surname is surest (a double one that other names show, else the one they have most often)."""
    sure = read.filter("sure").groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("n_sure"))
    many = read.filter("size(turns) > 0").select("name", F.posexplode("turns").alias("i", "t"))
    parts = F.split("t", " ")
    ways = many.select("name", "i", parts[0].alias("k"), parts[1].alias("f"), parts[2].alias("m")).join(sure, "k")
    best = ways.groupBy("name").agg(F.max_by(F.struct("k", "f", "m"), F.struct(F.col("i") >= 2, "n_sure", -F.col("i"))).alias("b"))
    both = read.drop("turns", "sure").join(best, "name", "left")
    is_turned = F.col("b").isNotNull()
    new = lambda c, x: F.when(is_turned, F.col(f"b.{x}")).otherwise(F.col(c)).alias(c)
    return both.select("name", "n", "kind", new("key", "k"), new("first", "f"), new("mids", "m"), (F.col("swapped") & ~is_turned).alias("swapped"))


def families(read: DataFrame) -> DataFrame:
    """(kind, key, family): the key each spelling follows, by its most frequent neighbour and that one's and
    so on, or itself. A surname of under five letters and its neighbour are linked only if a full given name
    stands beside both; short organisations, and short surnames with initials alone, are not."""
    counts = landed(read.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.concat("kind", F.lit(":"), "key").alias("k"), "n"), "keys")
    near = landed(trie_join(counts), "near")
    given = read.filter("kind = 'p' AND length(first) > 1").select(F.concat(F.lit("p:"), "key").alias("k"), "first").distinct()
    short = (F.length("a") < 7) | (F.length("b") < 7)
    agreed = near.filter(short).join(given.withColumnRenamed("k", "a"), "a").join(given.withColumnRenamed("k", "b"), ["b", "first"]).select("a", "b").distinct()
    near = near.filter(~short).unionByName(agreed)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own, other = counts.select(F.col("k").alias("a"), F.col("n").alias("na")), counts.select(F.col("k").alias("b"), F.col("n").alias("nb"))
    up = both.join(own, "a").join(other, "b").filter("nb > na OR (nb = na AND b < a)")
    best = up.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("b"))
    family = landed(counts.join(best.withColumnRenamed("a", "k"), "k", "left").select("k", F.coalesce("b", "k").alias("family")), "spellings")
    # each step doubles the part of a chain that is followed; chains end, for each link leads to a greater key
    while True:
        step = landed(family.join(family.select(F.col("k").alias("family"), F.col("family").alias("next")), "family").select("k", F.col("next").alias("family"), (F.col("next") != F.col("family")).alias("moved")), "families")
        family = step.select("k", "family")
        if step.filter("moved").isEmpty():
            return family


def _deleted(word: str) -> list[str]:
    """A word and what deleting one of its letters leaves."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def _in_full(given: str, others: Container[str]) -> str:
    """The given name that a short form stands for: of several the first that stands in the family."""
    if given not in NICKNAMES:
        return given
    return next((o for o in (NICKNAMES[given], *ALSO.get(given, ())) if o in others), NICKNAMES[given])


def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """(name, entity, initial) of one family's strings (name, n, kind, key, first, mids, usual); ``initial`` where
    the string could be several persons, else null."""
    rows = list(pdf[["name", "n", "kind", "key", "first", "mids", "usual"]].itertuples(index=False))
    label = pdf["family"].iloc[0]
    if rows[0].kind == "o":
        return pd.DataFrame({"name": [r.name for r in rows], "entity": label, "initial": None})
    weight: Counter[str] = Counter()
    usual: dict[str, int] = {}
    for r in rows:
        if len(r.first) > 1:
            weight[r.first] += r.n
            usual[r.first] = max(usual.get(r.first, 0), r.usual)
    plain = {g: _in_full(g, weight) for g in weight}
    whole: Counter[str] = Counter()
    for g, w in weight.items():
        whole[plain[g]] += w
    given: dict[str, str] = {}
    # two names within one change or swap leave one string when a letter is deleted
    left: dict[str, set[str]] = defaultdict(set)
    for o in whole:
        for d in _deleted(o):
            left[d].add(o)
    common_name = {plain[g]: usual[g] >= USUAL or g in NICKNAMES for g in sorted(usual, key=lambda g: usual[g])}
    rank = lambda o: (common_name.get(o, False), whole[o], o)
    for g in weight:
        c = plain[g]
        if g not in NICKNAMES and usual[g] < USUAL:
            near = [(rank(o), o) for o in set().union(*[left[d] for d in _deleted(c)]) if o != c and rank(o) > rank(c) and distance(c, o) <= 1]
            short = [(rank(NICKNAMES[k]), NICKNAMES[k]) for k in NICKNAMES if NICKNAMES[k] in whole and len(k) > 3 and NICKNAMES[k] != c and distance(c, k) <= 1]
            if near or short:
                c = max(near or short)[1]
        given[g] = c
    # a spelling with two given names or more, not all of them the common spelling's, is a family of its own
    own: dict[str, set[str]] = defaultdict(set)
    for r in rows:
        if len(r.first) > 1:
            own[r.key].add(given[r.first])
    common = label.partition(":")[2]
    base = {k: k if len(gs) > 1 and not gs <= own.get(common, set()) else common for k, gs in own.items()}
    people: dict[tuple[str, str], dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        if len(r.first) > 1:
            people[base[r.key], given[r.first]][r.mids].append(r)
    entity: dict[str, str] = {}
    persons: list[tuple[str, str, str, set[str]]] = []  # family, given, middle, initials it may show
    for (k, g), by in people.items():
        full = sorted({m for m in by if m})
        longest = [m for m in full if not any(o != m and o.startswith(m) for o in full)]
        groups = {m: [m] for m in longest} if len(longest) > 1 else {(longest or [""])[0]: [*full, ""]}
        if len(longest) > 1 and "" in by:
            groups[""] = [""]
        for m, forms in groups.items():
            persons.append((k, g, m, {g[0]}))
            for f in forms if len(longest) > 1 else list(by):
                for r in by.get(f, []):
                    entity[r.name] = f"{k}|{g}|{m}"
    loose: dict[str, list] = defaultdict(list)
    by_initial: dict[str, list] = defaultdict(list)
    for p in persons:
        by_initial[p[1][0]].append(p)
    memo: dict[tuple[str, str, str], list] = {}

    def fitting(key: str, first: str, mids: str) -> list:
        """The persons that a surname with initials may stand for."""
        fits = [p for p in by_initial[first] if p[0] in (key, common, base.get(key, common)) and (not mids or not p[2] or p[2].startswith(mids) or mids.startswith(p[2]))] if first else []
        if mids and len(fits) > 1:
            fits = [p for p in fits if p[2].startswith(mids)] or fits
        if len(fits) > 1 and any(p[0] == key for p in fits):
            fits = [p for p in fits if p[0] == key]
        if not mids and len(fits) > 1 and len({p[1] for p in fits}) == 1:
            fits = [p for p in fits if not p[2]]
        return fits

    unsure: dict[str, str] = {}
    for r in rows:
        if len(r.first) > 1:
            continue
        asked = (r.key, r.first, r.mids)
        if asked not in memo:
            memo[asked] = fitting(*asked)
        fits = memo[asked]
        if len(fits) == 1:
            k, g, m, _ = fits[0]
            entity[r.name] = f"{k}|{g}|{m}"
        elif fits:
            entity[r.name] = f"?{r.name}"
            unsure[r.name] = r.first
        else:
            loose[r.first].append(r)
    for i, forms in loose.items():
        mids = sorted({r.mids for r in forms if r.mids})
        for r in forms:
            entity[r.name] = f"{common}|{i}.|{(r.mids if len(mids) > 1 else '')}"
    return pd.DataFrame({"name": list(entity), "entity": [f"p:{common}:{e}" for e in entity.values()], "initial": [unsure.get(n) for n in entity]})


def entities(names: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(name, entity) of the distinct names (name, n).

    ``titles`` (name, h): the titles under which each name stands, as hashes. A string that could be several
    persons is the one whose strings share most titles with it, if one person has more than the others."""
    read = landed(parsed(names), "names-read")
    fam = families(read)
    joined = read.withColumn("k", F.concat("kind", F.lit(":"), "key")).join(fam, "k").drop("k")
    ready = scattered(joined, "family").sortWithinPartitions("family")
    found = ready.mapInPandas(stream_groups(["family"], resolve), "name string, entity string, initial string")
    if titles is None:
        return found.select("name", "entity")
    found = landed(found, "entities-first")
    family = F.substring_index("entity", ":", 2).alias("family")
    unsure = found.filter("initial IS NOT NULL").select("name", family, "initial")
    sure = found.filter("initial IS NULL AND entity LIKE 'p:%'").select(F.col("name").alias("other"), family, F.substring(F.split_part("entity", F.lit("|"), F.lit(2)), 1, 1).alias("initial"), "entity")
    asked = landed(unsure.join(titles, "name").select("name", "family", "initial", "h").distinct(), "names-asked")
    beside = titles.join(asked.select("h").distinct(), "h").select(F.col("name").alias("other"), "h").distinct().join(sure, "other")
    met = asked.join(beside, ["h", "family", "initial"]).groupBy("name", "entity").agg(F.countDistinct("h").alias("n"))
    most = Window.partitionBy("name").orderBy(F.desc("n"))
    best = met.withColumn("rank", F.rank().over(most)).filter("rank = 1").groupBy("name").agg(F.min("entity").alias("told"), F.count("*").alias("of")).filter("of = 1")
    return found.join(best, "name", "left").select("name", F.coalesce("told", "entity").alias("entity"))


def titled(df: DataFrame, column: str, title: str) -> DataFrame:
    """(name, h) of a column of author lists: the hash of the title's letters and digits under which each name stands."""
    authors = F.col(column)
    if dict(df.dtypes)[column] == "string":
        authors = F.from_json(authors, "array<string>")
    plain = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "")
    return df.filter(F.length(plain) >= 8).select(F.explode(authors).alias("name"), F.xxhash64(plain).alias("h")).filter("name IS NOT NULL").distinct()


def pairs(names: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(name_a, name_b): every two strings of one entity."""
    e = landed(entities(names, titles), "entities")
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()


def groups(names: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(name, entity, n_names): each string with the smallest string of its entity and their number."""
    e = landed(entities(names, titles), "entities")
    w = Window.partitionBy("entity")
    return e.select("name", F.min("name").over(w).alias("entity"), F.count("*").over(w).alias("n_names"))


def listed(df: DataFrame, column: str) -> DataFrame:
    """(name, n) of a column of author lists, an array or its JSON text."""
    authors = F.col(column)
    if dict(df.dtypes)[column] == "string":
        authors = F.from_json(authors, "array<string>")
    return df.select(F.explode(authors).alias("name")).filter(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
