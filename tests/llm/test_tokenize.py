"""The transducer against the plain merges, a public encoder, and exact round trips."""

from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.tokenize import PATTERN, BpeTransducer, count_tokens, default_path, encode_corpus, read_ranks

tiktoken = pytest.importorskip("tiktoken")
RANKS = read_ranks(default_path())
MACHINE = BpeTransducer(RANKS)
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_public_encoder_and_round_trips(text):
    ids = MACHINE.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    assert "".join(MACHINE.decode([ids[i : i + 2] for i in range(0, len(ids), 2)])) == text
    assert MACHINE.count(text) == len(ids)


@given(st.text(alphabet="aeinrst ", min_size=1, max_size=24))
@settings(max_examples=200, deadline=None)
def test_machine_equals_merges_on_one_piece(text):
    raw = text.encode()
    assert MACHINE.run(raw) == MACHINE.merge(raw)


def test_long_piece_and_forgetting():
    text = "a" * 50_000
    ids = MACHINE.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    MACHINE._forget()
    assert MACHINE.encode("forgotten words") == PUBLIC.encode_ordinary("forgotten words")


def test_broken_utf8_decodes_to_replacement():
    half = [RANKS[b"\xe6"]]
    assert "".join(MACHINE.decode([half])) == "�"


def test_corpus_defined_results(spark):
    rows = [(1, "The cat <|endoftext|>", "x"), (2, "", "y"), (3, None, None), (4, "  \n", "z"), (4, "  \n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == [(1, PUBLIC.encode_ordinary("The cat <|endoftext|>")), (2, []), (3, []), (4, PUBLIC.encode_ordinary("  \n")), (4, PUBLIC.encode_ordinary("  \n"))]
    n = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert n == {1: len(got[0][1]), 2: 0, 3: 0, 4: len(got[3][1])}
    assert encode_corpus(df.filter("doc_id < 0")).count() == 0


def test_encode_into_appends():
    out = array("i", [7])
    MACHINE.encode_into("ab", out)
    assert out.tolist()[0] == 7 and out.tolist()[1:] == PUBLIC.encode_ordinary("ab")
