"""The token automaton against the tokenizer's own library, and its round trip."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import tokens

PATH = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def automaton():
    return tokens.TokenAutomaton.load(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abehlnort '\n\t-=19éÄ的।<|>\x1c\xa0"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_library_s(automaton, library, text):
    ids = tokens.Encoder(automaton)(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert automaton.decode(ids) == text.encode()


def test_long_runs(automaton, library):
    for text in ("a" * 5000, " " * 5000, "\n" * 333 + "x", "<|endoftext|>" * 3, "ab" * 999):
        assert tokens.Encoder(automaton)(text) == library.encode(text, add_special_tokens=False).ids


def test_table(spark, automaton):
    rows = spark.createDataFrame([(1, "Grind it.", "x"), (2, None, "y"), (3, "", None), (3, "", None)], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokens.encode_texts(rows).orderBy("doc_id").collect()]
    assert got == [(1, tokens.Encoder(automaton)("Grind it.")), (2, []), (3, []), (3, [])]
    assert tokens.encode_texts(rows.where("false")).collect() == []
    back = tokens.decode_ids(tokens.encode_texts(rows)).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["Grind it.", "", "", ""]
