"""Look-alike forms against a brute-force version and on dirty rows."""

import re
import unicodedata

import pytest

from quire.llm.lookalike import HIDDEN, LOOKALIKES, found, normalise

TEXTS = [
    "plain ascii", "Ｆｕｌｌ ｗｉｄｔｈ１２％", "café ậ", "ậ", "ze​ro⁠", "no break　x", "Vеrifіcаtion", "проверки о а",
    "Λ-column", "𝖲𝗍𝗎𝖽𝗒 ﬁne", "“quoted” – dash", "ends with soft­", "in­side", "", None, "ɡroup", "漢字，好", "naïve Ö", "x" * 50_000 + "ｙ", "Τοp", "2² ½",
]


def brute(text):
    """The form by plain loops over one text."""
    if text is None:
        return None
    out = []
    for i, ch in enumerate(text):
        kind = unicodedata.decomposition(ch).partition(" ")[0]
        if ch == "­" and i == len(text.rstrip()) - 1 and i:
            out.append(ch)
        elif ch in HIDDEN:
            continue
        elif unicodedata.category(ch) == "Zs":
            out.append(" ")
        elif kind in ("<wide>", "<narrow>", "<font>", "<noBreak>") or "ﬀ" <= ch <= "ﬆ":
            out.append(unicodedata.normalize("NFKD", ch))
        else:
            out.append(unicodedata.normalize("NFD", ch) if kind and kind[0] != "<" else ch)
    words = re.split(r"([^\W\d_](?:[^\W\d_]|[̀-ͯ])*)", "".join(out))
    for i in range(1, len(words), 2):
        if any("LATIN" in unicodedata.name(c, "") for c in words[i]):
            words[i] = "".join(LOOKALIKES.get(c, c) for c in words[i])
    return unicodedata.normalize("NFC", "".join(words))


def test_forms_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id int, text string, h1 string")
    got = {r.id: r.form for r in normalise(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    again = normalise(normalise(df).select("id", "form"), "form", "twice").filter("NOT (form <=> twice)")
    assert again.count() == 0


@pytest.mark.parametrize("text", ["Ｆｕｌｌ", "café", "ze​ro", "no break", "Vеrifіcаtion", "𝖲𝗍𝗎𝖽𝗒", "ﬁne", "in­side", "ɡroup"])
def test_odd(spark, text):
    assert found(spark.createDataFrame([("t", "1", text), ("t", "1", text)], "tbl string, row_key string, text string")).count() == 1


def test_not_odd(spark):
    rows = [("t", str(i), t) for i, t in enumerate(["ok", "Λ-column", "“q” –", "проверки о", "soft­", "naïve", "漢字，好", "", None])]
    assert found(spark.createDataFrame(rows, "tbl string, row_key string, text string")).collect() == []
    assert found(spark.createDataFrame([], "tbl string, row_key string, text string")).count() == 0
