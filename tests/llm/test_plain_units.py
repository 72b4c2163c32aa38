from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_tokens import ODD, WORDS, ids_of, library_ids
from xrel.llm.token_files import TextEncoder

ENCODER = TextEncoder(WORDS)
LATIN = [chr(c) for c in range(0xA0, 0x180)]
TEXT = st.lists(st.sampled_from([*LATIN, *"aZ9 .,$\n'|<", "́", "̧", "Å", "ﬁ", "</w>", "日"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_letters_beyond_ascii(texts):
    assert ids_of(ENCODER, texts) == [library_ids(t) for t in texts]


def test_every_letter():
    texts = [f"{c} a{c}b, {c}{c}9{c}. {c}́ x{c}" for c in LATIN]
    assert ids_of(ENCODER, texts) == [library_ids(t) for t in texts]


def test_words_are_units():
    """Words with such letters are units without the marks beside them, so fewer go to the library."""
    encoder = TextEncoder(WORDS)
    texts = [f"{word}{mark}" for word in ("été", "Über", "ÜBER", "schön", "niño") for mark in ("", ",", ".", "!!", "$$$")]
    assert ids_of(encoder, texts) == [library_ids(t) for t in texts]
    assert encoder.table.count == 8


def test_tokenizers_without_marked_ends():
    encoder = TextEncoder(WORDS)
    encoder.ends[:] = False
    texts = [*ODD, "Été à l'école, 12 ÷ 5 × 3"]
    assert ids_of(encoder, texts) == [library_ids(t) for t in texts]
