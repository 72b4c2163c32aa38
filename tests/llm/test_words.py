from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from xrel.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text("aB \n\té.0x", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_hashes(texts, limit):
    seen, at = {}, 0
    for lo, hi, data, offsets in W.text_slices(pa.array(texts, pa.string()), limit):
        assert lo == at
        at = hi
        found = W.scan(data.translate(W.LOWER), offsets, W.BETWEEN_SPACES)
        hashes = found.hashes()
        for i in range(lo, hi):
            low = (texts[i] or "").encode().translate(W.LOWER).decode()
            want = re.findall(r"[^\x20\x09-\x0D]+", low)
            a, b = found.first[i - lo], found.first[i - lo + 1]
            assert [found.text(k) for k in range(a, b)] == want
            for word, h in zip(want, hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_shingles_stay_in_rows():
    found = W.scan(b"a b ca b c", np.array([0, 5, 10]), W.BETWEEN_SPACES)
    places, hashes = W.shingles(found.hashes(), found.row, 2)
    assert places.tolist() == [0, 1, 3, 4] and hashes[0] == hashes[2]
    assert W.joined_hash(found.hashes()[:2]) == hashes[0]
